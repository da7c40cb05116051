"""Periodic runs against a plain search of every period and place."""

import hashlib
import random
import zlib

import corpus
import pytest

from pairwright.llm.periodic_runs import collapse, find_runs, mark_runs
from pairwright.llm.queries import QUERIES


def plain_runs(words, least=12):
    """Every maximal stretch of every period, kept when no smaller one fits all of it."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(least, 2 * q):
                inside = words[start:j]
                smaller = (
                    p for p in range(1, q) if all(inside[k] == inside[k - p] for k in range(p, length))
                )
                if next(smaller, None) is None:
                    out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [w for k, w in enumerate(words) if k not in gone]


def sequences(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        n, letters = rng.randint(0, 70), rng.choice([1, 2, 3, 5])
        words = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = rng.randint(1, 1 + (n - a) // 2)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        yield words, rng.choice([12, 12, 5, 2, 1])


def test_random_sequences():
    for words, least in sequences(1500, 4):
        runs = find_runs(words, least)
        assert runs == plain_runs(words, least), (words, least)
        assert collapse(words, runs) == plain_collapsed(words, runs)


def test_overlapping_runs_and_multiples():
    # a run of period 2 and the one of period 3 that begins inside it
    words = list("abababababab") + list("cabcabcabcabc")
    assert find_runs(words) == [(0, 12, 2), (10, 15, 3)]
    # six times the same word is no run; twelve times is one, not also one of period 2 or 3
    assert find_runs(["x"] * 11) == []
    assert find_runs(["x"] * 12) == [(0, 12, 1)]
    assert find_runs(list("abcdefg") * 2) == [(0, 14, 7)]
    assert find_runs(list("abcdefg") * 2, least=15) == []


def test_long_texts():
    assert find_runs(["a"] * 30_000) == [(0, 30_000, 1)]
    words = [f"w{k}" for k in range(5_000)]
    assert find_runs(words * 3) == [(0, 15_000, 5_000)]
    assert collapse(words * 3, find_runs(words * 3)) == words


def test_columns_and_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 8), (4, "a b " * 8), (None, "one")]
    docs = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "'x' AS REPEATS")
    got = mark_runs(docs).select("id", "repeats.*").collect()
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [
        (0, [], ""), (0, [], ""), (0, [], ""), (16, [(0, 16, 2)], "a b"), (16, [(0, 16, 2)], "a b"),
        (1, [], "one"),
    ]
    assert mark_runs(docs.limit(0)).collect() == []


@pytest.fixture(scope="module")
def prose(spark, tmp_path_factory):
    rows, _ = corpus.documents(seed=11, count=150)
    rows += [(10**9 + k, f"a b{' a b' * (k % 17)} c", "en", "s", 1) for k in range(60)]
    return corpus.write_tables(spark, tmp_path_factory.mktemp("prose"), rows), rows


def test_query_against_plain_python(spark, prose):
    root, rows = prose
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, root).collect()}
    assert len(got) == len(rows)
    damaged = 0
    for doc_id, text, *_ in rows:
        words = corpus.WORD.findall(text)
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            damaged += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        row = got[doc_id]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        kept = " ".join(plain_collapsed(words, runs))
        assert row.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert damaged > 10
