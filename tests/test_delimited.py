import csv
import random

import pytest
from pyspark.sql import functions as F

from pairwright.sources.delimited import (
    header_cells,
    read_exports,
    resolve_errors,
    resolve_headers,
    rows_to_records,
    run_of_path,
    scan_delimited,
    too_wide_errors,
)
from pairwright.specs import Config, Source

COLUMNS = {"date": 40, "description": 110, "quantity": 300, "amount": 380}
CONFIG = Config(
    sources=[
        Source(
            name="S",
            columns=COLUMNS,
            aliases={
                "date": ["Date", "Value Date"],
                "description": ["Description"],
                "quantity": ["Quantity"],
                "amount": ["Amount", "Total"],
            },
            match_key=["date", "description", "amount"],
        )
    ]
)


def put(root, day, name, text):
    folder = root / "source=S" / f"run_date={day}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8", newline="")


def read(spark, root, suffix=".csv"):
    rows = scan_delimited(spark, str(root), suffix)
    headers = header_cells(rows)
    resolved = resolve_headers(headers, CONFIG)
    return rows, headers, resolved


def test_values_stay_text_and_rows_are_numbered(spark, tmp_path):
    put(tmp_path, "2026-03-02", "a.csv",
        "﻿Date,Description,Quantity,Amount\r\n2026-03-02,ALPHA,007,1234.50\r\n\r\n"
        ",,,\r\n2026-03-02,\"B, \"\"x\"\"\",NA,\" 5 \"\r\n")
    rows, _, resolved = read(spark, tmp_path)
    got = rows_to_records(rows, resolved).orderBy("ordinal").collect()
    assert [r.locator for r in got] == ["row 2", "row 4"]
    assert got[0].quantity == "007" and got[0].amount == "1234.50"
    assert got[1].description == 'B, "x"' and got[1].quantity == "" and got[1].amount == " 5 "
    assert got[0].reference is None


def test_header_aliases_case_padding_and_order(spark, tmp_path):
    put(tmp_path, "2026-03-02", "a.csv", "  date  ,description,QUANTITY,Total,Amount\n1,2,3,4,5\n")
    put(tmp_path, "2026-03-03", "b.csv", "Amount,Value Date,Description,Quantity,amount\n5,1,2,3,6\n")
    rows, _, resolved = read(spark, tmp_path)
    got = {str(r.run_date): r for r in rows_to_records(rows, resolved).collect()}
    assert (got["2026-03-02"].date, got["2026-03-02"].amount) == ("1", "5")
    assert (got["2026-03-03"].date, got["2026-03-03"].amount) == ("1", "6")


def test_missing_column_is_an_error_row_and_other_files_go_on(spark, tmp_path):
    put(tmp_path, "2026-03-02", "a.csv", "Booking Day,Description,Quantity,Amount\n1,2,3,4\n")
    put(tmp_path, "2026-03-03", "b.csv", "Date,Description,Quantity,Amount\n1,2,3,4\n")
    rows, headers, resolved = read(spark, tmp_path)
    errors = resolve_errors(resolved, headers, CONFIG).collect()
    assert [(str(e.run_date), e.field) for e in errors] == [("2026-03-02", "date")]
    assert "Booking Day" in errors[0].error and "Date, Value Date" in errors[0].error
    assert [str(r.run_date) for r in rows_to_records(rows, resolved).collect()] == ["2026-03-03"]


def test_row_wider_than_header_is_reported(spark, tmp_path):
    put(tmp_path, "2026-03-02", "a.csv", "Date,Description,Quantity,Amount\n1,2,3,4,5\n")
    rows, _, _ = read(spark, tmp_path)
    assert [e.error for e in too_wide_errors(rows).collect()] == ["Expected 4 fields, saw 5"]


def test_tab_separated(spark, tmp_path):
    put(tmp_path, "2026-03-02", "a.tsv", 'Date\tDescription\tQuantity\tAmount\n1\t"a\tb"\t3\t4,5\n')
    rows, _, resolved = read(spark, tmp_path, ".tsv")
    got = rows_to_records(rows, resolved).collect()
    assert got[0].description == "a\tb" and got[0].amount == "4,5"


@pytest.mark.parametrize("split_bytes", ["48", "1000000"])
def test_split_files_read_like_whole_ones(spark, tmp_path, split_bytes):
    """Quoted line breaks, stray quotes and blank lines, across any split boundary."""
    rng = random.Random(7)
    pieces = ["a", "b c", 'say ""hi""', "x\ny", "\n\nz", "p,q", ""]
    text = "Date,Description,Quantity,Amount\n"
    for i in range(120):
        cells = []
        for _ in range(4):
            kind = rng.random()
            if kind < 0.5:
                cells.append(rng.choice(["1", "22", 'in 5" pipe', "it's", ""]))
            else:
                cells.append('"' + rng.choice(pieces) + '"' + rng.choice(["", "", "tail"]))
        text += f"{i}," + ",".join(cells[1:]) + "\n" + rng.choice(["", "", "\n", "  \n"])
    put(tmp_path, "2026-03-02", "a.csv", text)
    expected = [
        r for r in csv.reader(text.splitlines(keepends=True))
        if len(r) > 1 or (r and r[0].strip())
    ]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    open_cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = scan_delimited(spark, str(tmp_path))
        got = rows.orderBy("row").select("row", "cells").collect()
        if split_bytes == "48":
            assert rows.select("split_start").distinct().count() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
    assert [r.row for r in got] == list(range(1, len(expected) + 1))
    assert [r.cells for r in got] == expected


def test_run_from_folder_name(spark):
    df = spark.createDataFrame([("file:/r/ACME/ACME 2026.03.02/a.csv",), ("/x/y.csv",)], "p string")
    source, day = run_of_path(F.col("p"))
    got = df.select(source.alias("s"), day.cast("string").alias("d")).collect()
    assert [tuple(r) for r in got] == [("ACME", "2026-03-02"), (None, None)]


def test_one_bad_file_hides_none_of_the_others(spark, tmp_path):
    head = "Date,Description,Quantity,Amount\n"
    put(tmp_path, "2026-03-02", "ok.csv", head + "1,2,3,4\n5,6,7,8\n")
    put(tmp_path, "2026-03-03", "wide.csv", head + "1,2,3,4\n1,2,3,4,5\n")
    put(tmp_path, "2026-03-04", "open.csv", head + '1,2,3,4\n1,"2,3,4\n')
    put(tmp_path, "2026-03-05", "missing.csv", "Date,Quantity,Amount\n1,2,3\n")
    records, errors = read_exports(spark, str(tmp_path), CONFIG)
    assert {(str(r.run_date), r.locator) for r in records.collect()} == {
        ("2026-03-02", "row 2"), ("2026-03-02", "row 3")}
    found = {str(e.run_date): e.error for e in errors.collect()}
    assert found["2026-03-03"] == "Expected 4 fields, saw 5"
    assert found["2026-03-04"].startswith("unexpected end of data")
    assert "no header for description" in found["2026-03-05"] and len(found) == 3


def test_every_data_file_gives_records_or_an_error(spark, tmp_path):
    head = "Date,Description,Quantity,Amount\n"
    put(tmp_path, "2026-03-02", "A.CSV", head + "1,2,3,4\n")
    put(tmp_path, "2026-03-03", "b.tsv", head.replace(",", "\t") + "1\t2\t3\t4,5\n")
    put(tmp_path, "2026-03-04", "empty.csv", "")
    put(tmp_path, "2026-03-05", "blank.csv", "\n  \n\n")
    put(tmp_path, "2026-03-06", "book.xlsx", "x")
    put(tmp_path, "2026-03-06", "notes.txt", "x")
    strange = tmp_path / "source=T" / "run_date=2026-03-07"
    strange.mkdir(parents=True)
    (strange / "t.csv").write_text(head + "1,2,3,4\n")
    arrivals = spark.createDataFrame(
        [("S", "2026-03-04", "empty.csv"), ("S", "2026-03-02", "A.CSV")],
        "source string, run_date string, filename string",
    ).withColumn("run_date", F.to_date("run_date"))
    records, errors = read_exports(spark, str(tmp_path), CONFIG, arrivals=arrivals)
    got = {(str(r.run_date), r.amount) for r in records.collect()}
    assert got == {("2026-03-02", "4"), ("2026-03-03", "4,5")}
    found = {(r.source, str(r.run_date)): r.error for r in errors.collect()}
    assert found == {
        ("S", "2026-03-04"): "empty.csv: no header row",
        ("S", "2026-03-05"): "blank.csv: no header row",
        ("S", "2026-03-06"): "book.xlsx: this format is not read here",
        ("T", "2026-03-07"): "t.csv: unknown source",
    }


def test_bytes_that_are_no_text_are_an_error(spark, tmp_path):
    text = "Date,Description,Quantity,Amount\n" + "1,Käse,3,4\n" * 3
    put(tmp_path, "2026-03-02", "good.csv", text)
    for day, encoding in (("2026-03-03", "latin-1"), ("2026-03-04", "utf-16")):
        put(tmp_path, day, "bad.csv", "")
        (tmp_path / "source=S" / f"run_date={day}" / "bad.csv").write_bytes(text.encode(encoding))
    records, errors = read_exports(spark, str(tmp_path), CONFIG)
    assert {(str(r.run_date), r.description) for r in records.collect()} == {("2026-03-02", "Käse")}
    found = {(str(e.run_date), e.error) for e in errors.collect()}
    for day in ("2026-03-03", "2026-03-04"):
        assert (day, "the file is not UTF-8 text") in found
    assert all(day != "2026-03-02" for day, _ in found)


def test_separators_are_taken_literally(spark, tmp_path):
    put(tmp_path, "2026-03-02", "a.csv", 'Date|Description|Quantity|Amount\n1|"b|c"|3|4\n')
    rows = scan_delimited(spark, str(tmp_path), sep="|").orderBy("row").collect()
    assert rows[1].cells == ["1", "b|c", "3", "4"]
    with pytest.raises(ValueError, match="one character"):
        scan_delimited(spark, str(tmp_path), sep="||")


def test_a_stray_quote_gathers_nothing(spark, tmp_path):
    head = "Date,Description,Quantity,Amount\n"
    body = "".join(f"1,x{i},3,4\n" for i in range(200_000))
    put(tmp_path, "2026-03-02", "a.csv", head + '1,"open,3,4\n' + body)
    records, errors = read_exports(spark, str(tmp_path), CONFIG)
    assert records.count() == 0
    assert [e.error for e in errors.collect()] == ["unexpected end of data inside a quoted value"]
