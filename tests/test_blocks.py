import random

import pytest
from pyspark.sql import functions as F

from pairwright.operators.blocks import (
    attach_group_value,
    block_of,
    occurrence_number,
    running_state,
    running_total,
    salt_of,
)


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_occurrences_and_totals_like_a_loop(spark, levels):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), i, rng.randrange(5)) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long").withColumns(
        {"b1": block_of("i", 3), "b2": block_of("i", 5)}
    )
    blocks = ["b1", "b2"][:levels]
    numbered = occurrence_number(df, ["k"], ["i"], blocks)
    got = running_total(numbered, ["k"], ["i"], F.col("v"), blocks, "t").collect()
    seen, total, expected = {}, {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        total[k] = total.get(k, 0) + v
        expected[i] = (seen[k], total[k])
    assert {r.i: (r.n, r.t) for r in got} == expected


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_state_like_a_loop(spark, levels):
    rng = random.Random(2)
    rows, expected = [], {}
    for doc, initial in (("x", 0), ("y", 1), ("z", 0)):
        state = initial
        for i in range(250):
            off, on = rng.choice([(0, 1)] * 6 + [(1, 1), (0, 0), (1, 0)])
            rows.append((doc, i, off, on, initial))
            expected[doc, i] = state
            state = on if state else off
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "d string, i long, off int, on int, init int").withColumns(
        {"b1": block_of("i", 3), "b2": block_of("i", 5)}
    )
    got = running_state(
        df, ["d"], ["i"], F.col("off"), F.col("on"), F.col("init"), ["b1", "b2"][:levels]
    ).collect()
    assert {(r.d, r.i): r.state_in for r in got} == expected


def test_group_value_reaches_every_row(spark):
    df = spark.range(500).withColumn("k", F.col("id") % 3)
    got = attach_group_value(df, ["k"], salt_of("id"), F.col("id"), "low").collect()
    assert len(got) == 500 and all(r.low == r.k for r in got)
