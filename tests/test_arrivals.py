import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pairwright.operators import arrivals as ar
from pairwright.specs import Config, Source

COLUMNS = {"reference": 1.0, "date": 2.0}
ALIASES = {f: [f] for f in COLUMNS}


def source(name, **rules):
    return Source(name=name, columns=COLUMNS, aliases=ALIASES, match_on="reference", **rules)


CONFIG = Config(
    sources=[
        source("S", subject_all=("Ledger", "Weekly"), attachment_contains=("ledger-week",)),
        source("T", attachment_contains=("ledger",)),
    ],
    root="/out",
)
MESSAGE = (
    "msg_id long, subject string, received timestamp_ntz, "
    "attachments array<struct<pos:int,filename:string,size:long,content_hash:string>>"
)


def messages(spark, *rows):
    """(subject, day, [(file name, size, content)])"""
    made = []
    for i, (subject, day, files) in enumerate(rows, start=1):
        when = dt.datetime(2026, 3, day, 8, 0) + dt.timedelta(minutes=i)
        made.append((i, subject, when, [(p, n, s, c) for p, (n, s, c) in enumerate(files)]))
    return spark.createDataFrame(made, MESSAGE)


def test_first_matching_rule_wins(spark):
    m = messages(
        spark,
        ("weekly LEDGER of branch 4", 2, []),
        ("re: as promised", 2, [("x.txt", 1, "a"), ("LEDGER-Week-11.pdf", 9, "a")]),
        (None, 2, [("ledger.pdf", 9, "a")]),
        ("ledger", 2, [(None, 9, "a")]),
        ("Parking", 2, [("map.pdf", 9, "a")]),
    )
    got = ar.classify(m, CONFIG).orderBy("msg_id").collect()
    assert [r.source for r in got] == ["S", "S", "T", None, None]
    assert ar.classified(m, CONFIG, only="t").count() == 1


def test_thousands_of_sources_like_a_loop(spark):
    rng = random.Random(9)

    def word(size):
        return "".join(rng.choices("abcdE", k=size))

    sources = [
        source(
            f"s{k}",
            subject_all=tuple(word(rng.randint(1, 6)) for _ in range(rng.choice([0, 2, 3]))),
            attachment_contains=(word(rng.randint(4, 9)),),
        )
        for k in range(5000)
    ]
    m = [
        (f"{word(5)} {word(rng.randint(0, 12))}", 2, [(word(rng.randint(0, 12)), 1, "a")] * 2)
        for _ in range(200)
    ] + [("", 2, [("", 1, "a")]), ("xyz", 2, [("xyz", 1, "a")])]
    expected = []
    for subject, _, files in m:
        subject, name = subject.lower(), files[0][0].lower()
        expected.append(next((
            s.name for s in sources
            if (s.subject_all and all(f.lower() in subject for f in s.subject_all))
            or any(f.lower() in name for f in s.attachment_contains)), None))
    got = ar.classify(messages(spark, *m), Config(sources=sources)).orderBy("msg_id").collect()
    assert [r.source for r in got] == expected
    assert 10 < len(set(expected)) and None in expected


def test_range_includes_the_last_day(spark):
    m = messages(spark, ("a", 2, []), ("b", 3, []), ("c", 4, []))
    assert ar.received_in_range(m, "2026-03-02", "2026-03-03").count() == 2
    with pytest.raises(ValueError, match="before start date"):
        ar.received_in_range(m, "2026-03-05", "2026-03-02")


def test_filing_plan(spark):
    big = 20000
    m = messages(
        spark,
        ("Weekly Ledger", 2, [("wk.pdf", big, "a"), ("stamp.png", 300, "l")]),
        ("Weekly Ledger", 2, [("wk.pdf", big, "b"), ("d.csv", 50, "c")]),
        ("again: Weekly Ledger", 3, [("copy.pdf", big, "a")]),
        ("re", 2, [("ledger.pdf", big, "a")]),
        ("Parking", 2, [("map.pdf", big, "z")]),
    )
    plan = ar.filing_plan(m, CONFIG)
    rows = {(r.msg_id, r.pos): r for r in plan.collect()}
    day2 = "/out/S/S 2026.03.02"
    assert {k: (r.written, r.path) for k, r in rows.items() if r.written} == {
        (1, 0): (True, f"{day2}/wk.pdf"),
        (2, 0): (True, f"{day2}/wk (2).pdf"),
        (2, 1): (True, f"{day2}/d.csv"),
        (4, 0): (True, "/out/T/T 2026.03.02/ledger.pdf"),
    }
    assert rows[1, 1].skipped_reason == "under the least size (300 bytes)"
    assert rows[3, 0].skipped_reason == "same content as an earlier file"
    assert rows[3, 0].duplicate_of == f"{day2}/wk.pdf"
    s = ar.fetch_summary(m, plan, CONFIG).first()
    assert s.summary == "4 of 5 messages matched; saved 4 file(s), skipped 2."


def test_files_already_filed_come_first(spark):
    m = messages(spark, ("Weekly Ledger", 2, [("wk.pdf", 20000, "a"), ("n.pdf", 20000, "n")]))
    filed = spark.createDataFrame(
        [("/out/S", "/out/S/S 2026.03.02", "n.pdf", "q", "/out/S/S 2026.03.02/n.pdf"),
         ("/out/S", "/out/S/old", "o.pdf", "a", "/out/S/old/o.pdf")],
        "root string, folder string, filename string, content_hash string, path string",
    )
    rows = {r.filename: r for r in ar.filing_plan(m, CONFIG, filed=filed).collect()}
    assert rows["wk.pdf"].duplicate_of == "/out/S/old/o.pdf" and not rows["wk.pdf"].written
    assert rows["n.pdf"].path == "/out/S/S 2026.03.02/n (2).pdf"


def test_the_archive_is_narrowed_before_it_is_shuffled(spark, monkeypatch):
    new = spark.createDataFrame([("/out/S", "a"), ("/out/S", "b")], "root string, content_hash string")
    archive = spark.range(1000).selectExpr(
        "'/out/S' AS root", "if(id % 500 = 0, 'a', cast(id AS string)) AS content_hash", "id")
    small = ar.narrowed(archive, new, ["root", "content_hash"])
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r.id for r in small.collect()) == [0, 500]
    # beyond the bound the keys are not sent around, and the rows are the same
    monkeypatch.setattr(ar, "FEW_KEYS", 1)
    assert sorted(r.id for r in ar.narrowed(archive, new, ["root", "content_hash"]).collect()) == [0, 500]


def test_unknown_content_equals_nothing(spark):
    files = [("x.pdf", 20000, None), ("y.pdf", None, None), ("z.pdf", None, "a"), ("w.pdf", 9000, "a")]
    m = messages(spark, ("Weekly Ledger", 2, files))
    written = {r.filename: r.written for r in ar.filing_plan(m, CONFIG).collect()}
    assert written == {"x.pdf": True, "y.pdf": True, "z.pdf": True, "w.pdf": False}
