import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pairwright.functions import normalize as nz
from pairwright.functions.naming import numbered_name, safe_filename, suffix

#: Values by the rule that decides how they are read.
NUMBERS = {
    # nothing there, or no number at all
    None: "", "": "", " \t ": "", "tba": "TBA", "-": "-", ".": ".", ";": ";", "( )": "( )",
    "7-8": "7-8", "6e2": "6E2", "3x4": "3X4", "(7": "(7", "7)": "7)", "++4": "++4",
    # spaces around, leading zeros, no more than six decimals
    "\t81 ": "81", "0042": "42", "3.10": "3.1", "2.7182818": "2.718282", "-0.00": "0",
    "-0.0000004": "0", "8.": "8", ".25": "0.25",
    # one kind of separator: groups if it repeats; a lone comma before three digits is a group
    "62,5": "62.5", "62,50": "62.5", "62,500": "62500", "62,5000": "62.5", "0,875": "875",
    "9,062,500": "9062500", "9.062.500": "9062500", "62.500": "62.5", ",75": "75",
    # both kinds: the last one is the decimal point, and stands once
    "9,062.75": "9062.75", "9.062,75": "9062.75", "9.062.500,25": "9062500.25",
    "9,062,500.25": "9062500.25", "9.062,500": "9062.5", "9,0.6,2": "9,0.6,2",
    # spaces and apostrophes group
    "9 062.75": "9062.75", "9'062.75": "9062.75", "9’062": "9062",
    # signs in front, behind and as brackets
    "+17": "17", "-17": "-17", "17-": "-17", "17 -": "-17", "17+": "17", "(17)": "-17",
    "( 17.50 )": "-17.5", "(-17)": "-17", "-(17)": "-(17)", "17+-": "-17", "17-+": "17",
    "17.-": "-17", "17.+-": "17.+-", "17\n-": "17",
    # words and currencies at either end are no part of it
    "CHF 9,062.75": "9062.75", "9,062.75 CHF": "9062.75", "£17": "17", "17%": "17",
    "CHF -17": "-17", "-CHF 17": "-CHF 17", "17 CHF-": "-17", "17DR": "17", "17 CR": "17",
    "CHF (17)": "CHF (17)", "(CHF 17)": "-17", "No.17": "0.17", "w2.0": "2", "4f": "4",
    "17. CHF": "17. CHF", "٣7": "٣7",
}

#: Dates read day first, by the kind of spelling.
DAY_FIRST_DATES = {
    None: "", "": "", "soon": "SOON", "tomorrow  12": "TOMORROW 12",
    # year first
    "2024-07-09": "2024-07-09", "2024/7/9": "2024-07-09", "2024.07.09": "2024-07-09",
    "20240709": "2024-07-09", "2024-07- 9": "2024-07-09", "2024-7/9": "2024-7/9",
    "202479": "2024-07-09", "2024-07-009": "2024-07-009", "0000-07-09": "0000-07-09",
    # months by name, in any case, with two or four digits of the year
    "9-Jul-2024": "2024-07-09", "09 jul 2024": "2024-07-09", "9 July 2024": "2024-07-09",
    "9-JULY-2024": "2024-07-09", "Jul 9, 2024": "2024-07-09", "July 9, 2024": "2024-07-09",
    "9-Jul-24": "2024-07-09", "jul 9, 24": "2024-07-09", "9-July-24": "9-JULY-24",
    "July 9, 24": "JULY 9, 24", "Juli 9, 2024": "JULI 9, 2024", "2024-jul-9": "2024-JUL-9",
    # two digits from 69 on are of the last century
    "9-Jul-69": "1969-07-09", "9-Jul-68": "2068-07-09", "24-07-09": "2009-07-24",
    # numbers alone: the other order is tried where the first cannot be
    "09/07/2024": "2024-07-09", "9.7.2024": "2024-07-09", "9-7-2024": "2024-07-09",
    "9/7/24": "2024-07-09", "9.7.24": "9.7.24", "07/21/2024": "2024-07-21",
    "21/07/2024": "2024-07-21", " 7/ 9/2024": "2024-07-09", "009/07/2024": "009/07/2024",
    # days there are not
    "30/02/2024": "30/02/2024", "29/02/2023": "29/02/2023", "31.06.2024": "31.06.2024",
    "00/07/2024": "00/07/2024", "29/02/2028": "2028-02-29",
    # a time at midnight is no time
    "2024-07-09 00:00:00": "2024-07-09", "2024-07-09 11:30:00": "2024-07-09 11:30:00",
    "09 Jul 2024 00:00:00": "09 JUL 2024 00:00:00",
}


def apply(spark, values, build):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", build(F.col("v")).alias("r"))
    return [r.r for r in df.orderBy("i").collect()]


@pytest.mark.parametrize(
    ("build", "table"),
    [(nz.norm_number, NUMBERS), (nz.norm_date, DAY_FIRST_DATES)],
    ids=["numbers", "dates"],
)
def test_value_tables(spark, build, table):
    got = apply(spark, table, build)
    assert dict(zip(table, got, strict=True)) == table


def test_month_first_reading(spark):
    values = ["07/09/2024", "7-9-24", "21/07/2024", "2024-09-07"]
    assert apply(spark, values, lambda c: nz.norm_date(c, "month_first")) == [
        "2024-07-09", "2024-07-09", "2024-07-21", "2024-09-07"]
    assert apply(spark, values, lambda c: nz.norm_date(c, F.lit("day_first"))) == [
        "2024-09-07", "2024-09-07", "2024-07-21", "2024-09-07"]


def test_text_quantity_mask(spark):
    assert apply(spark, ["  alpha   widget\n", None, "a  b", "straße"],
                 nz.norm_text) == ["ALPHA WIDGET", "", "A B", "STRASSE"]
    assert apply(spark, ["12", "12.0", "v1x3.0"], nz.norm_quantity) == ["12", "12", "V1X3"]
    assert apply(spark, ["ABC-123 xy"], nz.mask_shape) == ["AAA-999 aa"]
    assert apply(spark, [" x "], lambda c: nz.canonical("anything else", c)) == ["X"]


def test_typed_values(spark):
    df = spark.createDataFrame(
        [(dt.date(2026, 3, 2), 1234.5, True), (None, None, None)], "d date, n double, b boolean"
    )
    got = df.select(nz.norm_date_value("d"), nz.norm_numeric("n"), nz.norm_boolean("b")).collect()
    assert [tuple(r) for r in got] == [("2026-03-02", "1234.5", "TRUE"), ("", "", "")]


def test_however_a_number_is_written_it_reads_the_same(spark):
    rng = random.Random(3)
    values, expected = [], []
    for _ in range(400):
        cents = rng.randrange(100, 10**9)
        plain = f"{cents // 100}.{cents % 100:02d}"
        canonical = plain.rstrip("0").rstrip(".")
        grouped = f"{cents // 100:,}.{cents % 100:02d}"
        european = grouped.translate(str.maketrans(",.", ".,"))
        for text, sign in (
            (plain, ""), (grouped, ""), (european, ""), (grouped.replace(",", " "), ""),
            (f"({grouped})", "-"), (f"{european}-", "-"), (f"GBP {european}", ""),
            (f"{grouped} €", ""), (f"-{plain}", "-"),
        ):
            values.append(text)
            expected.append(sign + canonical)
    assert apply(spark, values, nz.norm_number) == expected


def test_totals_take_numbers_only(spark):
    values = ["1.5", "N/A", "NAN", "INF", "1E3", "1_000", "1E5D", "", "-2", "1" + "0" * 30]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    exact, big = df.agg(F.sum(nz.total_value("v")), F.sum(nz.total_overflow("v"))).first()
    assert float(exact) == 1999.5 and big == 1e30


def test_names(spark):
    assert apply(spark, ["a/b:c*d.pdf", "   ", None, " ..x. "], safe_filename) == [
        "a_b_c_d.pdf", "attachment", "attachment", "x"]
    assert apply(spark, ["A.PDF", ".bashrc", "a.", "a.tar.gz", "none"], suffix) == [
        ".pdf", "", "", ".gz", ""]
    assert apply(spark, ["a.pdf", "none"], lambda c: numbered_name(c, F.lit(2))) == [
        "a (2).pdf", "none (2)"]


def test_numbers_whose_form_is_in_their_text(spark):
    shown = {
        "0": "0", "-17": "-17", "17.0": "17", "1,234.50": "1234.5", "EUR 12,345.67": "12345.67",
        "-0": "0", "-0.00": "0", "007": "7", "100.": "100", "12.5000000000": "12.5", "0.50 €": "0.5",
        "1,2340": "1.234", "123456789012345": "123456789012345",
    }
    rows = spark.createDataFrame(list(shown.items()), "v string, wanted string")
    got = rows.select("v", nz.norm_number("v").alias("n")).collect()
    assert {r.v: r.n for r in got} == shown
    quick = rows.select("v", F.rlike("v", F.lit(nz._EXACT_NUMBER)).alias("q"))
    assert {r.v for r in quick.filter("q").collect()} == {
        "0", "-17", "17.0", "1,234.50", "EUR 12,345.67", "0.50 €"}
