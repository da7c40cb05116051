import random

import pytest
from helpers import DAY, WORD, words_of
from pyspark.sql import functions as F

from pairwright.operators import layout as ly
from pairwright.specs import Config, Source

COLUMNS = {"date": 40.0, "description": 110.0, "quantity": 300.0, "amount": 380.0}


def config(**markers):
    return Config(
        sources=[
            Source(
                name="S",
                columns=COLUMNS,
                aliases={f: [f] for f in COLUMNS},
                match_key=("date", "amount"),
                **markers,
            )
        ]
    )


def read(spark, rows, **markers):
    return ly.read_lines(spark.createDataFrame(rows, WORD), config(**markers))


def test_words_become_lines_left_to_right(spark):
    rows = [("S", DAY, "d", 1, i, t, x, y) for i, (t, x, y) in enumerate(
        [("B", 60.0, 100.4), ("A", 20.0, 100.0), ("C", 20.0, 130.0)])]
    lines = ly.number_lines(ly.group_lines(spark.createDataFrame(rows, WORD))).orderBy("line")
    assert [(r.line, r.text) for r in lines.collect()] == [(1, "A B"), (2, "C")]


def test_words_fall_into_columns(spark):
    rows = words_of(
        [
            [("2026-03-02", 40), ("ALPHA", 110), ("WIDGET", 150), ("99.00", 380)],
            [("10", 298.5)],
            [("*", 5)],
        ],
        source="S",
    )
    got = read(spark, rows).orderBy("line").collect()
    assert (got[0].date, got[0].description, got[0].quantity, got[0].amount) == (
        "2026-03-02", "ALPHA WIDGET", "", "99.00")
    assert got[0].reference is None and got[1].quantity == "10"
    assert [r.is_record for r in got] == [True, True, False]
    unread = ly.unread_lines(read(spark, rows)).collect()
    assert [r.unread_line for r in unread] == ["page 1, line 3: *"]
    records = ly.document_records(read(spark, rows)).orderBy("ordinal").collect()
    assert [r.locator for r in records] == ["page 1, line 1", "page 1, line 2"]


@pytest.mark.parametrize("start", [("OPEN",), ()])
def test_sections_like_a_loop(spark, monkeypatch, start):
    monkeypatch.setattr(ly, "PAGE_BLOCK_BITS", 1)
    rng = random.Random(11)
    texts = ["row"] * 6 + ["open", "Close", "open close", "skip row"]
    rows, expected = [], []
    inside = not start
    for page in range(1, 40):
        lines = [rng.choice(texts) for _ in range(rng.randrange(0, 6))]
        rows += words_of([[(t, 110)] for t in lines], source="S", page=page)
        for number, text in enumerate(lines, start=1):
            opens, closes = bool(start) and "open" in text, "close" in text.lower()
            if not inside:
                inside = opens
                continue
            if closes:
                inside = False
                continue
            if "skip" in text or opens:
                continue
            expected.append(f"page {page}, line {number}")
    got = read(
        spark, rows, start_markers=start, stop_markers=("CLOSE",), skip_markers=("skip",)
    ).orderBy("ordinal")
    assert [r.locator for r in got.collect()] == expected


def test_probe_can_hide_the_values(spark):
    words = spark.createDataFrame(words_of([[("ALPHA", 40.4), ("x1", 110)]], source="S"), WORD)
    assert ly.layout_probe(words).first().shown == "ALPHA@40  x1@110"
    assert ly.layout_probe(words, mask=True).first().shown == "AAAAA@40  a9@110"
    assert ly.layout_probe(words, page=1).count() == ly.layout_probe(words).count()
    with pytest.raises(ValueError, match="no document has a page 9"):
        ly.layout_probe(words, page=9)


def test_unmarked_statement_is_read_from_the_first_line(spark):
    rows = words_of([[("x", 110)]] * 3, source="S")
    assert read(spark, rows).filter(F.col("is_record")).count() == 3


def test_columns_are_proposed_where_words_start(spark):
    lines = [[("x", 40 + k % 3), ("y", 110.4), ("z", 300 if k else 215)] for k in range(60)]
    lines[0].append(("stray", 500))
    words = spark.createDataFrame(words_of(lines, source="S"), WORD)
    got = sorted(tuple(r) for r in ly.propose_columns(words).collect())
    assert got == [("S", 40, 42, 60, 1000), ("S", 110, 110, 60, 1000), ("S", 300, 300, 59, 983)]
    assert ly.propose_columns(words.limit(0)).count() == 0


def test_records_and_unread_lines_read_the_words_once(spark):
    from pairwright.plans.catalog import QUERIES

    plan = QUERIES["records_vs_unread"](spark, "/root/testdata/sf0.001")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "orders.parquet" not in text


def test_values_are_put_together_once(spark):
    lines = [[("2026-03-02", 41), ("ALPHA", 110), ("x", 150), (" ", 300), ("5.00", 381)],
             [("~", 5), ("note", 12)], [("~", 5), (" ", 110), (" ", 400)]]
    rows = read(spark, words_of(lines, source="S"))
    plan = ly.document_records(rows)._jdf.queryExecution().optimizedPlan().toString()
    # the filter on lines that give a value does not put the values together again
    assert 0 < plan.count("array_join(filter(") <= len(COLUMNS) + 2
    got = {r.line: (r.is_record, r.date, r.description, r.quantity, r.amount, r.account)
           for r in rows.collect()}
    assert got == {1: (True, "2026-03-02", "ALPHA x", " ", "5.00", None),
                   2: (False, "", "", "", "", None), 3: (False, "", " ", "", " ", None)}
