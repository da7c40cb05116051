import random

import pytest
from helpers import BY_ID, DAY, KEYED, inv, rec, records
from pyspark.sql import functions as F

from pairwright.operators import blocks
from pairwright.operators import pairing as pg
from pairwright.operators import runs as rn
from pairwright.specs import Config, Source, SpecError


def pairs_of(spark, documents, sheets, config=KEYED):
    name = config.sources[0].name
    return pg.pair_records(
        pg.normalize_records(records(spark, documents, sheets, name), config), config
    )


def result_of(spark, documents, sheets, config=KEYED, unread=None):
    runs = spark.createDataFrame(
        [(config.sources[0].name, DAY)], "source string, run_date date"
    )
    return rn.run_results(runs, pairs_of(spark, documents, sheets, config), config, unread).first()


@pytest.mark.parametrize(
    ("documents", "sheets", "matched", "one_sided", "reason"),
    [
        ([rec()], [rec()], 1, 0, ""),
        ([rec(date="02-Mar-2026", amount="1,234.50")], [rec(amount="1234.5")], 1, 0, ""),
        ([rec(), rec(description="BETA")], [rec()], 1, 1, "1 one-sided"),
        ([rec(amount="100.00")], [rec(amount="101.00")], 0, 2, "2 one-sided"),
        ([rec(), rec()], [rec(), rec()], 2, 0, ""),
        ([rec(), rec(), rec()], [rec(), rec()], 2, 1, "1 one-sided"),
        ([rec(account="A")], [rec(account="B")], 1, 0, ""),
        ([rec("", "", "", "")], [rec("", "", "", "")], 1, 0, ""),
        ([], [], 0, 0, "nothing read from document"),
    ],
)
def test_pairing_by_key(spark, documents, sheets, matched, one_sided, reason):
    r = result_of(spark, documents, sheets)
    assert (r.matched, r.one_sided, r.reason) == (matched, one_sided, reason)
    assert r.verdict == ("FULLY RECONCILED" if not reason else "DIFFERENCES FOUND")
    assert r.document_count == len(documents) and r.spreadsheet_count == len(sheets)


def test_repeated_keys_show_the_spreadsheet_count_when_both_repeat(spark):
    rows = records(spark, [rec()] * 2 + [rec(description="B")] * 2, [rec()] * 3, "S")
    normalised = pg.normalize_records(rows, KEYED)
    assert sorted(r.shown for r in pg.repeated_keys(normalised).collect()) == [
        "2026-03-02 | ALPHA | 100 | 1 (x3)", "2026-03-02 | B | 100 | 1 (x2)"]
    assert result_of(spark, [rec()] * 2, [rec()] * 2).reconciled


def random_sides(seed, count=120):
    rng = random.Random(seed)
    return [
        [rec(description=rng.choice("AAABC"), quantity=str(rng.randrange(4))) for _ in range(count)]
        for _ in range(2)
    ]


def test_counts_of_keys_say_what_pairs_say(spark):
    documents, sheets = random_sides(4)
    rows = records(spark, documents[:90], sheets, "S")
    normalised = pg.normalize_records(rows, KEYED)
    by_pairs = rn.side_counts(rn.parts_of_pairs(pg.pair_records(normalised, KEYED))).first()
    by_keys = rn.side_counts(rn.parts_of_keys(pg.key_counts(normalised))).first()
    assert by_pairs == by_keys and by_keys.repeated > 1 and by_keys.one_sided >= 30
    runs = rows.select(*pg.RUN).distinct()
    assert rn.run_results_by_key(runs, normalised, KEYED).first() == rn.run_results(
        runs, pg.pair_records(normalised, KEYED), KEYED).first()
    plan = rn.run_results_by_key(runs, normalised, KEYED)._jdf.queryExecution().executedPlan()
    assert "Window" not in plan.toString()


def test_large_runs_are_numbered_by_blocks(spark, monkeypatch):
    documents, sheets = random_sides(5)
    rows = records(spark, documents, sheets, "S")
    small = records(spark, documents[:3], sheets[:3], "S").withColumn(
        "run_date", F.lit("2026-05-05").cast("date"))
    normalised = pg.normalize_records(rows.unionByName(small), KEYED)

    def paired():
        return {
            (r.run_date, r.pair_key, r.n, r.document and r.document.ordinal,
             r.spreadsheet and r.spreadsheet.ordinal)
            for r in pg.pair_records(normalised, KEYED).collect()
        }

    whole, calls = paired(), []
    monkeypatch.setattr(blocks, "BLOCK_BITS", 3)
    by_blocks = pg._number_by_blocks
    monkeypatch.setattr(
        pg, "_number_by_blocks", lambda df, stage: calls.append(df) or by_blocks(df, stage))
    assert pg.large_runs(normalised).count() == 1
    assert paired() == whole and len(calls) == 1
    numbers = pg.number_occurrences(normalised).collect()
    assert len(numbers) == 246 and {r.n for r in numbers} >= {1, 2, 3, 9}


def test_records_are_normalised_once(spark):
    rows = records(spark, [rec()] * 2, [rec()], "S")
    plan = pg.pair_records(pg.normalize_records(rows, KEYED), KEYED)
    text = plan._jdf.queryExecution().executedPlan().toString()
    # the branch of pairable records reads the rows once and shuffles them once
    assert text.count("Window [") == 1
    assert text.count("Exchange hashpartitioning(source") == 1


def test_totals_skip_what_is_no_number(spark):
    rows = records(spark, [rec(amount="1,000.00"), rec(amount="n/a")], [rec(amount="1000")], "S")
    t = rn.side_totals(pg.normalize_records(rows, KEYED)).first()
    assert (t.document_amount, t.spreadsheet_amount, t.amount_difference) == (1000.0, 1000.0, 0.0)


@pytest.mark.parametrize(
    ("documents", "sheets", "expected"),
    [
        ([inv()], [inv("inv-001 ")], (1, 0, 0, 0)),
        ([inv(amount="1,234.50")], [inv(amount="1,243.50")], (0, 1, 0, 0)),
        ([inv()], [inv(description="BETA", amount="101")], (0, 1, 0, 0)),
        ([inv(), inv("INV-002")], [inv()], (1, 0, 1, 0)),
        ([inv("")], [inv("  ")], (0, 0, 2, 0)),
        ([inv(), inv()], [inv(), inv()], (2, 0, 0, 1)),
        ([inv()], [inv(), inv()], (1, 0, 1, 1)),
    ],
)
def test_pairing_by_identifier(spark, documents, sheets, expected):
    r = result_of(spark, documents, sheets, BY_ID)
    assert (r.matched, r.differing, r.one_sided, r.ambiguous) == expected
    assert r.reconciled == (expected[1:] == (0, 0, 0))


def test_differences_name_the_field_and_show_what_was_read(spark):
    pairs = pairs_of(spark, [inv(amount="1,234.50")], [inv(amount="1,243.50", date="03-Mar-2026")],
                     BY_ID)
    got = pg.differences_worklist(pairs).orderBy("field").collect()
    assert [(r.field, r.document_value, r.spreadsheet_value) for r in got] == [
        ("amount", "1,234.50", "1,243.50"), ("date", "2026-03-02", "03-Mar-2026")]
    assert [d.field for d in pairs.first().differences] == ["date", "amount"]


def test_first_in_first_out_like_a_loop(spark, monkeypatch):
    """Which copy goes with which, and the order of leftovers, with tiny blocks."""
    monkeypatch.setattr(blocks, "BLOCK_BITS", 2)
    monkeypatch.setattr(pg, "block_of", lambda c: blocks.block_of(c, 2))
    rng = random.Random(5)
    documents = [inv(rng.choice(["", "A", "B", "C"]), amount=str(i)) for i in range(90)]
    sheets = [inv(rng.choice(["", "A", "A", "D"]), amount=str(i)) for i in range(80)]
    waiting, together, alone = {}, [], []
    for i, s in enumerate(sheets, start=1):
        if s["reference"]:
            waiting.setdefault(s["reference"], []).append(i)
        else:
            alone.append(("spreadsheet", i))
    for i, d in enumerate(documents, start=1):
        queue = waiting.get(d["reference"])
        if queue:
            together.append((i, queue.pop(0)))
        else:
            alone.append(("document", i))
    for queue in waiting.values():
        alone.extend(("spreadsheet", i) for i in queue)

    normalised = pg.normalize_records(
        records(spark, documents, sheets, "ACME_SUPPLIES"), BY_ID
    )
    pairs = pg.pair_records(normalised, BY_ID)
    got = pairs.filter("outcome <> 'one_sided'").select(
        F.col("document.ordinal"), F.col("spreadsheet.ordinal")
    )
    assert sorted(tuple(r) for r in got.collect()) == sorted(together)
    ordered = pg.order_one_sided(pg.one_sided(pairs, BY_ID), pairs).orderBy(
        "group_pos", "first_seen", "ordinal"
    )
    assert [(r.side, r.ordinal) for r in ordered.collect()] == alone


def test_swapping_the_sides_mirrors_the_result(spark):
    documents = [inv(), inv("X"), inv("Y", amount="5")]
    sheets = [inv(), inv("Y", amount="6")]
    a, b = result_of(spark, documents, sheets, BY_ID), result_of(spark, sheets, documents, BY_ID)
    assert (a.matched, a.differing, a.one_sided) == (b.matched, b.differing, b.one_sided)
    assert (a.document_count, a.spreadsheet_count) == (b.spreadsheet_count, b.document_count)


def test_one_sided_rows_name_both_sides(spark):
    labelled = Config(
        sources=[
            Source(
                name="S",
                columns=KEYED.sources[0].columns,
                aliases=KEYED.sources[0].aliases,
                match_key=("date", "amount"),
                labels={"document": "Broker statement"},
            )
        ]
    )
    rows = pg.one_sided(pairs_of(spark, [rec()], [rec(amount="1")], labelled), labelled).collect()
    assert {(r.present_in, r.missing_from) for r in rows} == {
        ("Broker statement", "spreadsheet"), ("spreadsheet", "Broker statement")}


def test_fields_in_play_start_with_the_key(spark):
    got = pg.fields_in_play(pairs_of(spark, [inv(account="x")], [inv()], BY_ID), BY_ID).first()
    assert got.fields == ["reference", "date", "description", "quantity", "amount", "account"]


@pytest.mark.parametrize(
    "bad",
    [
        {},
        {"match_on": "reference", "match_key": ("date",)},
        {"match_on": "account"},
        {"match_on": "reference", "date_order": "year_first"},
    ],
)
def test_unusable_sources_are_refused(bad):
    fields = {"reference": 1.0, "date": 2.0}
    with pytest.raises(SpecError):
        Source(name="S", columns=fields, aliases={f: [f] for f in fields}, **bad)


def test_only_large_keys_are_numbered_by_blocks(spark, monkeypatch):
    """A large run whose keys are of ordinary size is shuffled once, and nothing of it is staged."""
    monkeypatch.setattr(blocks, "BLOCK_BITS", 3)
    unlike = [rec(description=f"T{i}", quantity=str(i)) for i in range(60)]
    same = [rec(description="SAME")] * 20

    def paired(documents, sheets):
        staged = []
        normalised = pg.normalize_records(records(spark, documents, sheets, "S"), KEYED)
        pairs = pg.pair_records(
            normalised, KEYED, lambda df, label: staged.append(label) or df, carry=())
        got = sorted(
            (r.pair_key, r.n, r.outcome, r.document and r.document.ordinal,
             r.spreadsheet and r.spreadsheet.ordinal) for r in pairs.collect())
        return got, staged, pairs.schema["document"].dataType.names

    got, staged, held = paired(unlike, unlike[:50])
    assert staged == [] and held == ["ordinal", "locator"]
    assert [o for _, _, o, _, _ in got].count("matched") == 50 and len(got) == 60
    got, staged, _ = paired(unlike + same, unlike + same[:15])
    assert staged == ["blocks"] and len(got) == 80
    large = [r for r in got if "SAME" in r[0]]
    assert [(n, d, s) for _, n, _, d, s in large] == [
        (n, 60 + n, 60 + n if n <= 15 else None) for n in range(1, 21)]


def test_outcomes_need_no_carried_values(spark):
    rows = records(
        spark, [inv(), inv("X", amount="5"), inv("")], [inv(), inv("X", amount="6")],
        "ACME_SUPPLIES")
    normalised = pg.normalize_records(rows, BY_ID)
    whole, bare = pg.pair_records(normalised, BY_ID), pg.pair_records(normalised, BY_ID, carry=())
    shown = [*pg.RUN, "pair_key", "n", "outcome", "document.locator", "spreadsheet.locator"]
    assert "differences" not in bare.columns
    assert sorted(map(str, bare.select(*shown).collect())) == sorted(
        map(str, whole.select(*shown).collect()))


def test_leftovers_meet_one_row_of_their_key(spark, monkeypatch):
    """Keys without leftovers are dropped before the join, and no window runs over a key."""
    monkeypatch.setattr(blocks, "BLOCK_BITS", 2)
    normalised = pg.normalize_records(records(spark, [rec("B")] * 3, [rec()] * 9 + [rec("B")]), KEYED)
    pairs = pg.pair_records(normalised, KEYED, carry=()).localCheckpoint()
    ordered = pg.order_one_sided(pg.one_sided(pairs, KEYED), pairs)
    assert sorted((r.group_pos, r.first_seen or 0, r.ordinal) for r in ordered.collect()) == [
        (1, 0, 2), (1, 0, 3), *[(2, 1, i) for i in range(1, 10)]]
    assert "Window" not in ordered._jdf.queryExecution().executedPlan().toString()


def test_values_nobody_pairs_by_are_not_read(spark):
    short = Source(name="A", columns=KEYED.sources[0].columns, aliases=KEYED.sources[0].aliases,
                   match_key=("description", "quantity"))
    config = Config(sources=[short, KEYED.sources[0]])
    rows = records(spark, [rec()], [rec()], "A").unionByName(records(spark, [rec()], [rec()], "S"))
    every = pg.normalize_records(rows, config)
    some = pg.normalize_records(rows, config, every=False)
    columns = ["source", "side", "pair_key"]
    assert sorted(some.select(columns).collect()) == sorted(every.select(columns).collect())
    read = {r.source: (r.n_date, r.n_amount, r.n_quantity) for r in some.collect()}
    assert read == {"A": (None, None, "1"), "S": ("2026-03-02", "100", "1")}
    assert pg.pair_records(some, config).filter("outcome = 'matched'").count() == 2


def test_records_are_sorted_by_a_number_first(spark):
    documents, sheets = random_sides(9)
    pairs = pairs_of(spark, documents, sheets)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line]
    assert sorts and all(f"Sort [{pg.KEY_NUMBER}" in line for line in sorts)
    assert pg.KEY_NUMBER not in pairs.columns


def test_large_tables_are_read_without_a_shuffle(spark, tmp_path, monkeypatch):
    from pairwright.plans import derived_inputs as di

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))

    def shuffled():
        rows = di.table(spark, str(tmp_path), "t")
        assert rows.count() == 100
        return "Exchange" in rows._jdf.queryExecution().executedPlan().toString()

    assert shuffled()
    monkeypatch.setattr(di, "SPLIT_BYTES", 1)
    assert not shuffled()
