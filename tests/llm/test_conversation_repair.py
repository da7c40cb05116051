"""Repairs against a search over all ways, on conversations inside and across partitions."""

import hashlib
import random
import re
import zlib

import corpus
import pytest
from pyspark.sql import functions as F

from pairwright.llm.conversation_repair import (
    audit,
    find_faults,
    repair_rows,
    repaired_messages,
)
from pairwright.llm.queries import QUERIES

BLANK = re.compile(r"[\x20\x09-\x0D]*")
ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
TEXTS = ["Yes.", "Go on", "What?", " ", "", None, "Yes.  ", "no ", "a.b"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """(cost, audit, messages) and counts of faults, by trying every edit from every state."""
    rows = sorted(
        rows, key=lambda r: (r[1] is not None, r[1] or 0, f"{r[2]}:{r[3]}".encode(), r[2].encode())
    )
    seen, counts = set(), {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    best = {"": (0, "", [])}  # what was kept last: cheapest way so far

    def offer(table, state, way):
        if state not in table or way[:2] < table[state][:2]:
            table[state] = way

    def takes(state, initial):
        return initial == ("a" if state == "u" else "u") or (state, initial) == ("", "s")

    def inserted(table):
        table = dict(table)
        for _ in range(3):
            for state, (cost, letters, said) in list(table.items()):
                to = "a" if state == "u" else "u"
                name = {"u": "user:", "a": "assistant:"}[to]
                offer(table, to, (cost + 2, letters + "I", [*said, name]))
        return table

    previous = None
    for _, _, role, text in rows:
        blank = BLANK.fullmatch(text) is not None
        duplicate = not blank and (role, text) in seen
        cut = not blank and not duplicate and text.rstrip(" \t\n\v\f\r")[-1] not in ".!?"
        seen.add((role, text))
        for name, fault in (("blank", blank), ("duplicate", duplicate), ("truncated", cut)):
            counts[name] += fault
        initial = role[:1]
        if previous is not None and previous + initial not in ("su", "ua", "au"):
            counts["illegal"] += 1
        previous = initial
        after = {}
        for state, (cost, letters, said) in inserted(best).items():
            offer(after, state, (cost + 3, letters + "D", said))
            if blank or duplicate:
                continue
            if takes(state, initial):
                offer(after, initial, (cost + cut, letters + "K", [*said, f"{role}:{text}"]))
            for name in ("user", "assistant"):
                if takes(state, name[0]):
                    offer(after, name[0], (cost + 2 + cut, letters + "R", [*said, f"{name}:{text}"]))
        best = after
    ends = [way for state, way in inserted(best).items() if state in ("", "a")]
    return *min(ends, key=lambda w: w[:2]), counts


def conversations(seed, count, most=9, turns=12):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(count)]:
        for _ in range(rng.randint(1, most)):
            turn = rng.choice([None, *range(turns)])
            rows.append((conv, turn, rng.choice(ROLES), rng.choice(TEXTS)))
    return rows


def repaired(spark, rows, partitions):
    turns = spark.createDataFrame(rows, corpus.TURN)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = repair_rows(turns)
        said = F.struct("piece", "pos", audit().alias("audit"), "cost", "illegal", "copies", "fault")
        audits = frame.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("rows"))
        line = F.struct("piece", "pos", "place", F.concat_ws(":", "role", "text").alias("line"))
        lines = (
            repaired_messages(frame)
            .groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(line)).alias("lines"))
        )
        said = {r.conv_id: [x.line for x in r.lines] for r in lines.collect()}
        return {r.conv_id: (r.rows, said.get(r.conv_id, [])) for r in audits.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check(rows, got):
    by_conv = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        by_conv.setdefault(conv, []).append((conv, turn, role, text))
    assert set(got) == set(by_conv)
    for conv, own in by_conv.items():
        cost, letters, said, counts = plain_repair(own)
        edits, lines = got[conv]
        assert ("".join(e.audit for e in edits), sum(e.cost for e in edits)) == (letters, cost), own
        assert lines == said
        assert sum(e.illegal for e in edits) == counts["illegal"]
        assert sum(e.fault == "truncated" for e in edits) == counts["truncated"]


def test_conversations_of_a_few_rows(spark):
    rows = conversations(1, 300)
    check(rows, repaired(spark, rows, 3))


def test_long_conversations_across_partitions(spark):
    rng = random.Random(5)
    rows = conversations(6, 20)
    # one conversation has nine of ten rows, and a row of it is there a thousand times
    rows += [
        (7, rng.choice([None, *range(400)]), rng.choice(ROLES), rng.choice(TEXTS) or f"t{k}")
        for k in range(900)
    ]
    rows += [(7, 200, "user", "the same.")] * 1000
    check(rows, repaired(spark, rows, 9))


def test_copies_of_a_row_are_counted_not_listed(spark):
    rows = [(1, 0, "user", "Yes.")] * 5 + [(1, 1, "assistant", "No.")]
    faults = find_faults(spark.createDataFrame(rows, corpus.TURN)).collect()
    assert sorted((r.text, r.copies, r.forced) for r in faults) == [("No.", 1, False), ("Yes.", 5, False)]
    got = repaired(spark, rows, 2)
    assert "".join(r.audit for r in got[1][0]) == "KDDDDK"


@pytest.mark.parametrize("seed", [2, 3])
def test_query_against_plain_python(spark, tmp_path, seed):
    rows = conversations(seed, 150, turns=40)
    root = corpus.write_tables(spark, tmp_path, [], turns=rows)
    got = {r.conv_id: r for r in QUERIES["op12_conversation_repair"](spark, root).collect()}
    assert set(got) == {r[0] for r in rows}
    after = {}
    for row in damage(rows):
        after.setdefault(row[0], []).append(row)
    for conv, row in got.items():
        own = after.get(conv, [])
        cost, letters, said, counts = plain_repair(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        want = (gaps, *counts.values(), cost, letters, digest)
        assert tuple(row)[1:] == want, own


def test_conversations_that_are_dropped_whole(spark, tmp_path):
    dropped = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    rows = [(c, 0, "user", "Hello there.") for c in dropped]
    root = corpus.write_tables(spark, tmp_path, [], turns=rows)
    nothing = hashlib.sha256(b"").hexdigest()
    for row in QUERIES["op12_conversation_repair"](spark, root).collect():
        assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", nothing)
