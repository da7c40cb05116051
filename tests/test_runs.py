import datetime as dt

import pytest
from helpers import BY_ID, DAY, WORD, golden_sheet, golden_words
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pairwright.operators import runs as rn
from pairwright.operators.calendar import expected_runs, first_weekdays, weekdays_between
from pairwright.operators.pairing import RUN, differences_worklist, one_sided
from pairwright.plans.reconcile import Inputs, compute_again, reconcile_range, reconcile_run
from pairwright.session import Stages, shared_dir
from pairwright.sources.files import (
    drop_old_versions,
    list_files,
    read_report,
    report_tables,
    write_overview,
    write_report,
)
from pairwright.specs import Config, Source, SpecError

NEXT = DAY + dt.timedelta(days=1)
NAME = "ACME_SUPPLIES"
ARRIVAL = "source string, run_date date, filename string"


def days(spark, *values):
    return spark.createDataFrame([(d,) for d in values], "run_date date")


def inputs(spark, arrivals, errors=None, shift=()):
    words = golden_words()
    for day in shift:
        words += [(s, day, *rest) for s, _, *rest in golden_words()]
    sheets = golden_sheet(spark)
    for day in shift:
        sheets = sheets.unionByName(golden_sheet(spark, day))
    return Inputs(
        words=spark.createDataFrame(words, WORD),
        sheet_records=sheets,
        arrivals=spark.createDataFrame(arrivals, ARRIVAL),
        errors=None if errors is None else spark.createDataFrame(
            errors, "source string, run_date date, error string"),
    )


BOTH = [(NAME, DAY, "statement.pdf"), (NAME, DAY, "ledger.csv")]


def test_golden_run(spark):
    out = reconcile_run(inputs(spark, BOTH), BY_ID, NAME.lower(), DAY, stage=compute_again)
    r = out.results.first()
    assert (r.matched, r.differing, r.one_sided, r.unread) == (2, 1, 2, 0)
    assert r.verdict == "DIFFERENCES FOUND" and r.reason == "1 differing, 2 one-sided"
    d = differences_worklist(out.pairs).collect()
    assert [(x.identifier, x.field) for x in d] == [("INV-4472", "amount")]
    alone = one_sided(out.pairs, BY_ID).collect()
    assert {(x.reference, x.side) for x in alone} == {
        ("INV-4474", "document"), ("INV-4480", "spreadsheet")}
    with pytest.raises(ValueError, match="no source named"):
        reconcile_run(inputs(spark, BOTH), BY_ID, "absent", DAY)


def test_range_shows_every_day_and_why(spark):
    week = [DAY + dt.timedelta(days=i) for i in range(5)]
    arrivals = BOTH + [
        (NAME, week[1], "statement.pdf"), (NAME, week[1], "reconciliation_report.xlsx"),
        (NAME, week[2], "statement.pdf"), (NAME, week[2], "again.PDF"), (NAME, week[2], "l.csv"),
        (NAME, week[3], "statement.pdf"), (NAME, week[3], "ledger.csv"),
    ]
    data = inputs(spark, arrivals, [(NAME, week[3], "not a PDF")], shift=week[1:4])
    out = reconcile_range(data, BY_ID, days(spark, *week))
    got = [(r.status, r.why) for r in out.overview.orderBy("run_date").collect()]
    assert got == [
        ("DIFFERENCES", "1 differing, 2 one-sided"),
        ("INCOMPLETE", "missing spreadsheet"),
        ("FAILED", "2 PDF files found"),
        ("FAILED", "not a PDF"),
        ("INCOMPLETE", "folder does not exist"),
    ]
    first, second = out.overview.orderBy("run_date").take(2)
    assert first.matched == 2 and second.matched is None
    assert first.folder == "/statements/ACME_SUPPLIES/ACME_SUPPLIES 2026.03.02"
    tally = {r.status: r.runs for r in rn.status_tally(out.overview).collect()}
    assert tally == {"RECONCILED": 0, "DIFFERENCES": 1, "INCOMPLETE": 2, "FAILED": 2}
    assert reconcile_range(data, BY_ID, days(spark, DAY), only="ABSENT").overview.count() == 0


def test_a_document_nobody_could_read_is_never_clean(spark):
    data = inputs(spark, BOTH)
    empty = Inputs(data.words.filter("false"), data.sheet_records.filter("false"), data.arrivals)
    r = reconcile_run(empty, BY_ID, NAME, DAY, stage=compute_again).results.first()
    assert not r.reconciled and r.warning and r.reason == "nothing read from document"


def test_conflicting_files_are_listed(spark):
    arrivals = spark.createDataFrame(
        BOTH + [(NAME, DAY, "b.pdf"), (NAME, NEXT, "x.pdf"), (NAME, NEXT, "y.csv")], ARRIVAL)
    names = {r.filename for r in rn.conflicting_files(arrivals, BY_ID).collect()}
    assert names == {"statement.pdf", "b.pdf"}


def test_a_rerun_replaces_only_its_own_runs(spark, tmp_path):
    root = str(tmp_path / "report")
    arrivals = BOTH + [(NAME, NEXT, "s.pdf"), (NAME, NEXT, "l.csv")]
    data = inputs(spark, arrivals, shift=[NEXT])

    def report(data, calendar, report_id):
        out = reconcile_range(data, BY_ID, calendar)
        tables = report_tables(out.results, out.pairs, out.unread, out.records, BY_ID)
        write_report(tables, root, report_id)

    report(data, days(spark, DAY, NEXT), "first")
    assert read_report(spark, root, "differences").count() == 2
    # the second time both sides of the first day are the same, so it has no differences left
    clean = data.sheet_records.withColumn("side", F.lit("spreadsheet")).withColumn(
        "amount", F.when((F.col("run_date") == DAY) & (F.col("reference") == "INV-4472"), "899")
        .otherwise(F.col("amount")))
    report(Inputs(data.words, clean, data.arrivals), days(spark, DAY), "second")
    left = read_report(spark, root, "differences").collect()
    assert [r.run_date for r in left] == [NEXT]
    assert read_report(spark, root, "matched").groupBy(*RUN).count().count() == 2
    files = list_files(spark, root)
    assert "content" not in files.columns
    assert files.filter("suffix = '.parquet'").count() > 0


def test_a_report_that_fails_midway_leaves_the_old_one(spark, tmp_path):
    root = str(tmp_path / "report")
    out = reconcile_range(inputs(spark, BOTH), BY_ID, days(spark, DAY))
    tables = report_tables(out.results, out.pairs, out.unread, out.records, BY_ID)
    with pytest.raises(FileNotFoundError, match="no report"):
        read_report(spark, root, "summary")
    write_report(tables, root, "first")

    def shown():
        return {n: read_report(spark, root, n).orderBy(*tables[n].columns).collect()
                for n in ("summary", "lines", "matched", "differences", "unmatched")}

    before = shown()
    assert all(before.values())
    broken = {
        "summary": tables["summary"].withColumn("matched", F.lit(99).cast("long")),
        "differences": tables["differences"].limit(0),
        "matched": tables["matched"].withColumn("date", F.raise_error(F.lit("disk full"))),
    }
    with pytest.raises(Exception, match="disk full"):
        write_report(broken, root, "second")
    assert shown() == before
    write_report({**tables, "summary": broken["summary"]}, root, "third")
    assert [r.matched for r in read_report(spark, root, "summary").collect()] == [99]
    # the folders of the first report, and those the second one had begun
    assert drop_old_versions(spark, root) >= 7
    assert shown() == before | {"summary": read_report(spark, root, "summary").collect()}


def test_weekdays(spark):
    friday = F.lit(dt.date(2026, 3, 6))
    got = spark.range(1).select(first_weekdays(friday, 3), weekdays_between(friday, friday)).first()
    assert [d.isoformat() for d in got[0]] == ["2026-03-06", "2026-03-09", "2026-03-10"]
    assert len(got[1]) == 1
    assert expected_runs(days(spark, DAY, NEXT), BY_ID, "acme_supplies").count() == 2
    assert expected_runs(days(spark, DAY), BY_ID, "other").count() == 0


def test_folder_templates(spark):
    source = BY_ID.sources[0]
    config = Config(sources=[source], root="/r/", folder_template="{date:%Y-%W}/{source}_{date}")
    df = days(spark, DAY, dt.date(2026, 1, 1)).withColumn("source", F.lit("A"))
    got = [r[0] for r in df.select(config.run_path("source", "run_date")).collect()]
    assert got == [f"/r/{d.strftime('%Y-%W')}/A_{d}" for d in (DAY, dt.date(2026, 1, 1))]
    with pytest.raises(SpecError):
        Config(sources=[source], folder_template="{day}").run_path("source", "run_date")


def test_source_from_path(spark):
    config = Config(sources=[
        Source(**{**BY_ID.sources[0].__dict__, "name": n}) for n in ("Mill", "Windmill", "qx", "a b")
    ])
    expected = {
        "/in/MILL 2024/x": "Mill", "/in/old qx": "qx", "/in/A B/c": "a b", "/in/windmill/x": None,
        "/in/qx/mill": None, "/in/mil/l": None, "/qx/qx": "qx", "/": None, None: None, "q/x": None,
    }
    df = spark.createDataFrame([(p,) for p in expected] * 2, "path string")
    got = rn.infer_source(df, config).collect()
    assert len(got) == 2 * len(expected) and {r.path: r.source for r in got} == expected
    assert {r.source for r in rn.infer_source(df, BY_ID).collect()} == {NAME}


def test_stages_go_when_their_work_is_done(spark, tmp_path):
    with Stages(spark) as stages:
        out = reconcile_range(inputs(spark, BOTH), BY_ID, days(spark, DAY), stage=stages)
        write_overview(out.overview, str(tmp_path / "overview"))
        assert list_files(spark, stages.root).filter("suffix = '.parquet'").count() > 0
    assert spark.read.parquet(str(tmp_path / "overview")).first().status == "DIFFERENCES"
    with pytest.raises(AnalysisException):
        spark.read.parquet(stages.root + "/001-lines")


def test_stage_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
