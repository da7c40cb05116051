import datetime as dt
import random

import pytest

from pairwright.operators import file_names as fn

FILE = "folder string, filename string, received timestamp_ntz, msg_id long, pos int"


def loop(files, there, last=5000):
    """Store the files one after the other."""
    taken, stored = set(there), {}
    for folder, name, _, key, _ in sorted(files, key=lambda f: (f[2], f[3], f[4])):
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, dot + ext) if stem else (name, "")
        tries = [name, *[f"{stem} ({n}){ext}" for n in range(2, last + 1)]]
        free = next((t for t in tries if (folder, t) not in taken), None)
        if free:
            taken.add((folder, free))
        stored[key] = free
    return stored


@pytest.mark.parametrize("with_filed", [False, True])
def test_like_storing_one_by_one(spark, with_filed):
    rng = random.Random(17 + with_filed)
    names = ["a.csv", "a.csv", "a (2).csv", "a (3).csv", "a (2) (2).csv", "a (2) (2) (3).csv",
             "a (4).csv", "b", "b (2)", "c (7).csv", "c (2) (2).csv"]
    files = []
    for i in range(400):
        when = dt.datetime(2026, 3, 2) + dt.timedelta(seconds=rng.randrange(100000))
        files.append((f"f{rng.randrange(24)}", rng.choice(names), when, i, 0))
    there = set()
    if with_filed:
        there = {(f"f{rng.randrange(24)}", rng.choice(names)) for _ in range(40)}
    filed = spark.createDataFrame(sorted(there), "folder string, filename string") if there else None
    got = fn.number_names(spark.createDataFrame(files, FILE), filed).collect()
    assert {r.msg_id: r.stored_name for r in got} == loop(files, there)


def test_counting_never_ends(spark):
    """1,002 files of one name in the same second, two of its numbers taken by other files."""
    when = dt.datetime(2026, 3, 2)
    files = [("f", "a.csv", when, i, 0) for i in range(1002)]
    files.append(("f", "a (1000).csv", when, 500, 0))
    files.append(("f", "a (3).csv", when, 2000, 0))
    files = [(f, n, w, 10 * k + (n != "a.csv"), p) for f, n, w, k, p in files]
    got = fn.number_names(spark.createDataFrame(files, FILE)).collect()
    assert {r.msg_id: r.stored_name for r in got} == loop(files, set())
    assert len({r.stored_name for r in got}) == 1004
