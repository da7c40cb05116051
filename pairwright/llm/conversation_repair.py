"""The cheapest repair of conversations whose turns are lost, blank, repeated, cut off or mislabelled.

A repaired conversation is empty, or perhaps a system message and then user and assistant in turn.
Rows are kept (0), get the role user or assistant (2) or go (3; blank rows and repeats of an earlier
role and text must), and empty messages of user or assistant are put in anywhere (2); a cut-off row
that stays costs 1. Of the cheapest repairs the one whose audit, the initials of its edits in order,
comes first in ASCII order is taken.

A node is a place between two rows and what the messages kept so far end with; an arc is an edit.
The cost to the end is worked out backwards, and only the arcs on cheapest ways stay. Their nodes
are ranked by the first letter of their audit, then by the first 2, 4, 8, ... letters: the rank at
twice the length comes from a node's own rank and that of the node its doubled pointer leads to. At
each node the arc with the least letter and rank is taken, and the doubled pointers mark the nodes
on the way from the start. The conversations of a batch are ranked together.

Scale: rows that are the same in every column are one row with a count, and repeats are found by the
first turn of a group in parts, so copies without end meet in no task. Rows are put in order by a
range partitioning, which cuts a conversation of any length into pieces of the size of a partition.
Conversations inside a partition are repaired at once; of the first and last one of a partition each
piece tells what it costs from each state to each state, one short list a conversation (no more than
partitions) gives every piece the cost of what follows, and then the state it is entered in.

Order: turns ascending, rows without a turn first, rows of one turn by the written line
(``role:text``). Defined results: NULL role or text is read as one space; a NULL conversation id is
a conversation like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import SPACE
from pairwright.operators.blocks import attach_group_value, salt_of
from pairwright.session import materialize

# States: nothing kept yet, and what the last message is.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What an edit costs, and what an undeleted cut-off row costs besides.
REROLE_COST, DELETE_COST, INSERT_COST, CUT_OFF_COST = 2, 3, 2, 1
#: The edits in the order of their letters.
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)
#: Initials of roles as numbers; all others are 3.
INITIALS = "sua"
NAMES = {"u": "user", "a": "assistant"}
#: The state a message of user or assistant leads to; after user comes assistant, else user.
ANSWER = np.array([USER, USER, ASSISTANT, USER])
#: Characters of a written line that rows are dealt by; all of it orders them afterwards.
DEALT_BY = 64
NEVER = 1 << 40
#: Costs at the end of a conversation, by state.
END = (0, NEVER, NEVER, 0)
#: Rows of complete conversations that are repaired together.
TOGETHER = 20_000

INPUT = (
    "conv_key string, turn_key string, role string, text string, fault string, copies bigint, "
    "initial int, forced boolean, cut_off boolean"
)
REPAIRED = (
    f"{INPUT}, piece int, pos bigint, edit string, new_role string, before string, after string, "
    "cost bigint, illegal bigint"
)


# --------------------------------------------------------------------------------------------
# one batch of conversations, or pieces of them
# --------------------------------------------------------------------------------------------


def kept_state(initial: int, state: int) -> int:
    """The state after keeping a row, or -1 if it may not follow."""
    if initial == 0:
        return SYSTEM if state == NOTHING else -1
    if initial == 3:
        return -1
    return initial + 1 if ANSWER[state] == initial + 1 else -1


KEPT = np.array([[kept_state(i, s) for s in range(4)] for i in range(4)])
_KEPT, _ANSWER = KEPT.tolist(), ANSWER.tolist()


def with_inserts(costs: list[int]) -> list[int]:
    """Costs by state where messages may be put in first."""
    nothing, system, user, assistant = costs
    user, assistant = min(user, INSERT_COST + assistant), min(assistant, INSERT_COST + user)
    return [min(nothing, INSERT_COST + user), min(system, INSERT_COST + user), user, assistant]


def cost_to_end(initials, forced, cut_off, end, final: bool) -> list[list[int]]:
    """Costs by place and state, from the end backwards; one more place than rows."""
    here = with_inserts(list(end)) if final else list(end)
    out = [here]
    for k in range(len(initials) - 1, -1, -1):
        rest = [c + DELETE_COST for c in here]
        if not forced[k]:
            extra = CUT_OFF_COST if cut_off[k] else 0
            kept = _KEPT[initials[k]]
            for state in range(4):
                cost = REROLE_COST + extra + here[_ANSWER[state]]
                if kept[state] >= 0:
                    cost = min(cost, extra + here[kept[state]])
                if cost < rest[state]:
                    rest[state] = cost
        here = with_inserts(rest)
        out.append(here)
    out.reverse()
    return out


class Ways:
    """Cheapest ways through a batch: conversations one after the other, each with its own end."""

    def __init__(self, rows: list[tuple], ends: list[tuple[int, ...]], finals: list[bool]):
        """``rows``: initials, forced and cut off of each conversation."""
        costs: list[list[int]] = []
        initials, forced, cut_off, last = [], [], [], []
        self.first: list[int] = []  # the place each conversation starts at
        for (own, own_forced, own_cut), end, final in zip(rows, ends, finals):
            self.first.append(len(costs))
            costs += cost_to_end(own, own_forced, own_cut, end, final)
            # the place at the end has no row
            initials += [*own, 3]
            forced += [*own_forced, True]
            cut_off += [*own_cut, False]
            last += [0] * len(own) + [1 if final else 2]
        self.costs = np.array(costs, dtype=np.int64).reshape(-1, 4)
        self.follow(np.array(initials), np.array(forced), np.array(cut_off), np.array(last))

    def follow(self, initials, forced, cut_off, last) -> None:
        """Arcs on cheapest ways, ranks of nodes, pointers."""
        places, states = len(self.costs), np.arange(4)
        node = np.arange(4 * places).reshape(places, 4)
        reached = self.costs < NEVER
        inside = (last == 0)[:, None]
        later = np.vstack([self.costs[1:], np.full((1, 4), NEVER)])
        extra = np.where(cut_off, CUT_OFF_COST, 0)[:, None]
        kept = KEPT[initials]
        free = inside & ~forced[:, None]
        target = np.full((places, 4, 4), -1)
        ways = (
            (DELETE, inside, DELETE_COST + later, node + 4),
            (INSERT, (last < 2)[:, None], INSERT_COST + self.costs[:, ANSWER], node[:, ANSWER]),
            (
                KEEP,
                free & (kept >= 0),
                extra + np.take_along_axis(later, np.maximum(kept, 0), 1),
                node + 4 - states + np.maximum(kept, 0),
            ),
            (REROLE, free, REROLE_COST + extra + later[:, ANSWER], node[:, ANSWER] + 4),
        )
        for letter, allowed, cost, to in ways:
            fits = allowed & reached & (cost == self.costs)
            # an end without further cost needs no message put in
            target[:, :, letter] = np.where(fits, to, -1)
        target = target.reshape(-1, 4)
        loops = node.reshape(-1)
        ends = (target < 0).all(axis=1)
        letter = np.where(ends, 0, (target >= 0).argmax(axis=1))
        pointer = np.where(ends, loops, target[loops, letter])
        # ranks by audits of 1, 2, 4, ... letters
        rank = np.where(ends, 0, letter + 1)
        jump, jumps, steps = pointer, [pointer], (~ends).astype(np.int64)
        while not ends[jump].all():
            _, rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)
            steps = steps + steps[jump]
            jump = jump[jump]
            jumps.append(jump)
        # of the arcs of a node the one with the least letter, then the least rank of its target
        order = np.where(
            target >= 0, np.arange(4) * (len(rank) + 1) + rank[np.maximum(target, 0)], NEVER
        )
        self.letter = np.where(ends, -1, order.argmin(axis=1))
        self.pointer, self.jumps, self.steps, self.exit = pointer, jumps, steps, jump

    def path(self, starts: np.ndarray) -> np.ndarray:
        """The nodes on the ways from ``starts`` (one a conversation), in the order of the ways."""
        on = starts
        for jump in reversed(self.jumps):
            on = np.unique(np.concatenate([on, jump[on]]))
        whose = np.searchsorted(np.array(self.first), on // 4, side="right")
        return on[np.lexsort((-self.steps[on], whose))]

    def edits(self, state: int = NOTHING) -> dict[int, list]:
        """By place: letter of the row's edit, new role, initials put in before it."""
        starts = np.array(self.first) * 4 + state
        starts = starts[self.costs.reshape(-1)[starts] < NEVER]
        out: dict[int, list] = {}
        path = self.path(starts)
        for place, letter, to in zip(
            (path // 4).tolist(), self.letter[path].tolist(), (self.pointer[path] % 4).tolist()
        ):
            entry = out.setdefault(place, ["", None, ""])
            if letter == INSERT:
                entry[2] += "u" if to == USER else "a"
            elif letter >= 0:
                entry[0] = LETTERS[letter]
                if letter == REROLE:
                    entry[1] = NAMES["u" if to == USER else "a"]
        return out


def read_rows(table: pa.Table) -> tuple[list[int], list[bool], list[bool]]:
    return tuple(table[c].to_pylist() for c in ("initial", "forced", "cut_off"))


def turn_breaks(initials: list[int], copies: list[int], previous: int | None) -> list[int]:
    """By row, how many of its neighbours to the left, and of its own copies, may not be so."""
    out = []
    for initial, times in zip(initials, copies):
        fits = previous is None or (previous, initial) in ((0, 1), (1, 2), (2, 1))
        out.append(times - 1 + (0 if fits else 1))
        previous = initial
    return out


def edit_columns(table: pa.Table, edits: list[list], after: list[str]) -> dict[str, list]:
    """Columns of the result for rows in order; ``after`` is what is put in behind a row."""
    roles, cut_off = table["role"].to_pylist(), table["cut_off"].to_pylist()
    copies = table["copies"].to_pylist()
    cost = []
    for (letter, _, before), behind, cut, times in zip(edits, after, cut_off, copies):
        own = {"D": DELETE_COST, "R": REROLE_COST}.get(letter, 0)
        own += CUT_OFF_COST if cut and letter != "D" else 0
        cost.append(own + INSERT_COST * (len(before) + len(behind)) + DELETE_COST * (times - 1))
    return {
        "edit": [e[0] for e in edits],
        "new_role": [
            None if letter == "D" else new or role for (letter, new, _), role in zip(edits, roles)
        ],
        "before": [e[2] for e in edits],
        "after": after,
        "cost": cost,
    }


_ADDED = {
    "piece": pa.int32(), "pos": pa.int64(), "edit": pa.string(), "new_role": pa.string(),
    "before": pa.string(), "after": pa.string(), "cost": pa.int64(), "illegal": pa.int64(),
}


def with_columns(table: pa.Table, columns: dict[str, list]) -> pa.Table:
    for name, kind in _ADDED.items():
        values = columns.get(name, [None] * table.num_rows)
        table = table.append_column(name, pa.array(values, kind))
    return table


def runs_of(keys: list[str]) -> list[tuple[int, int]]:
    """Where each stretch of equal keys starts and ends."""
    starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
    return list(zip(starts, [*starts[1:], len(keys)]))


def repair_whole(table: pa.Table) -> dict[str, list]:
    """Columns for complete conversations, in order."""
    spans = runs_of(table["conv_key"].to_pylist())
    initials, forced, cut_off = read_rows(table)
    rows = [(initials[a:b], forced[a:b], cut_off[a:b]) for a, b in spans]
    ways = Ways(rows, [END] * len(rows), [True] * len(rows))
    found = ways.edits()
    copies = table["copies"].to_pylist()
    edits, after, illegal = [], [], []
    for place, (a, b) in zip(ways.first, spans):
        edits += [found[place + k] for k in range(b - a)]
        after += [""] * (b - a - 1) + [found.get(place + b - a, ["", None, ""])[2]]
        illegal += turn_breaks(initials[a:b], copies[a:b], None)
    return edit_columns(table, edits, after) | {"illegal": illegal}


def repair_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Complete conversations repaired; rows of the first and last one stay as they are."""
    piece, pos = TaskContext.get().partitionId(), 0
    opening, waiting = None, None

    def done(table: pa.Table, repaired: bool) -> Iterator[pa.RecordBatch]:
        nonlocal pos
        places = {"piece": [piece] * table.num_rows, "pos": range(pos, pos + table.num_rows)}
        pos += table.num_rows
        made = repair_whole(table) if repaired and table.num_rows else {}
        yield from with_columns(table, made | places).to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        keys = table["conv_key"].to_pylist()
        if not keys:
            continue
        opening = keys[0] if opening is None else opening
        spans = runs_of(keys)
        head = spans[0][1] if keys[0] == opening else 0
        tail = max(head, spans[-1][0])
        yield from done(table.slice(0, head), False)
        inside = [span for span in spans if head <= span[0] < tail]
        while inside:
            start, some = inside[0][0], 0
            while some < len(inside) and inside[some][1] - start <= TOGETHER:
                some += 1
            some = max(some, 1)
            stop = inside[some - 1][1]
            yield from done(table.slice(start, stop - start), True)
            inside = inside[some:]
        waiting = table.slice(tail)
    if waiting is not None:
        yield from done(waiting, False)


# --------------------------------------------------------------------------------------------
# conversations that partitions share
# --------------------------------------------------------------------------------------------

PIECE = "conv_key string, piece int, costs array<bigint>, first int, last int"


def price_piece(table: pa.Table) -> pa.Table:
    """What a piece costs from each state (rows) to each state (columns), and its outer initials."""
    table = table.sort_by("pos")
    rows = read_rows(table)
    to = [
        cost_to_end(*rows, [0 if s == end else NEVER for s in range(4)], False)[0]
        for end in range(4)
    ]
    costs = [to[end][state] for state in range(4) for end in range(4)]
    return pa.table({
        "conv_key": table["conv_key"].slice(0, 1),
        "piece": table["piece"].slice(0, 1),
        "costs": pa.array([costs], pa.list_(pa.int64())),
        "first": pa.array([rows[0][0]], pa.int32()),
        "last": pa.array([rows[0][-1]], pa.int32()),
    })


def costs_behind(table: pa.Table) -> pa.Table:
    """For each piece of a conversation: costs at its end, whether it is the last, what came before."""
    table = table.sort_by("piece")
    end, ends = with_inserts(list(END)), [list(END)]
    prices = table["costs"].to_pylist()
    for costs in reversed(prices[1:]):
        end = [min(costs[4 * s + t] + end[t] for t in range(4)) for s in range(4)]
        ends.append(end)
    n = table.num_rows
    return pa.table({
        "conv_key": table["conv_key"],
        "piece": table["piece"],
        "end": pa.array(ends[::-1], pa.list_(pa.int64())),
        "final": pa.array([k == n - 1 for k in range(n)]),
        "previous": pa.array([None, *table["last"].to_pylist()[:-1]], pa.int32()),
    })


CHOICE = "array<struct<edit string, new_role string, before string, after string, cost bigint>>"
OPEN = f"{INPUT}, piece int, pos bigint, illegal bigint, choices {CHOICE}, exits array<int>"


def repair_piece(table: pa.Table) -> pa.Table:
    """Each row's edits for each state the piece may be entered in, and the states it is left in."""
    table = table.sort_by("pos")
    rows = read_rows(table)
    end, final = table["end"][0].as_py(), table["final"][0].as_py()
    ways = Ways([rows], [tuple(end)], [final])
    n = table.num_rows
    variants, exits = [], []
    for state in range(4):
        exits.append(int(ways.exit[state] % 4))
        found = ways.edits(state)
        if ways.costs[0, state] >= NEVER:
            variants.append([None] * n)
            continue
        after = [""] * (n - 1) + [found.get(n, ["", None, ""])[2]]
        made = edit_columns(table, [found[k] for k in range(n)], after)
        variants.append([dict(zip(made, values)) for values in zip(*made.values())])
    kind = pa.struct([(c, _ADDED[c]) for c in ("edit", "new_role", "before", "after", "cost")])
    illegal = turn_breaks(rows[0], table["copies"].to_pylist(), table["previous"][0].as_py())
    kept = [c.split()[0] for c in INPUT.split(", ")]
    return (
        table.select([*kept, "piece", "pos"])
        .append_column("illegal", pa.array(illegal, pa.int64()))
        .append_column("choices", pa.array([list(v) for v in zip(*variants)], pa.list_(kind)))
        .append_column("exits", pa.array([exits] * n, pa.list_(pa.int32())))
    )


def entry_states(table: pa.Table) -> pa.Table:
    """The state each piece of a conversation is entered in."""
    table = table.sort_by("piece")
    state, states = NOTHING, []
    for exits in table["exits"].to_pylist():
        states.append(state)
        state = exits[state]
    return table.select(["conv_key", "piece"]).append_column("entry", pa.array(states, pa.int32()))


def repair_shared(rows: DataFrame) -> DataFrame:
    """Rows of conversations that lie in several partitions, or might."""
    group = ["conv_key", "piece"]
    prices = rows.groupBy(*group).applyInArrow(price_piece, PIECE)
    behind = prices.groupBy("conv_key").applyInArrow(
        costs_behind, "conv_key string, piece int, end array<bigint>, final boolean, previous int"
    )
    known = rows.drop("illegal").join(behind, group)
    tried = materialize(known.groupBy(*group).applyInArrow(repair_piece, OPEN), "tried")
    exits = tried.groupBy(*group).agg(F.first("exits").alias("exits"))
    entries = exits.groupBy("conv_key").applyInArrow(
        entry_states, "conv_key string, piece int, entry int"
    )
    chosen = tried.join(entries, group).withColumn("choice", F.col("choices")[F.col("entry")])
    return chosen.select(*[c for c in tried.columns if c not in ("choices", "exits")], "choice.*")


# --------------------------------------------------------------------------------------------
# the operator
# --------------------------------------------------------------------------------------------


def key_of(value: Column) -> Column:
    """A text that tells a value and NULL apart."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def value_of(key: Column, kind) -> Column:
    return F.when(key != "", F.substr(key, F.lit(2)).cast(kind))


def find_faults(turns: DataFrame) -> DataFrame:
    """One row for each different row, with its number of copies and the first fault it has."""
    rows = (
        turns.select(
            key_of(F.col("conv_id")).alias("conv_key"),
            "turn",
            F.coalesce("role", F.lit(" ")).alias("role"),
            F.coalesce("text", F.lit(" ")).alias("text"),
        )
        .groupBy("conv_key", "turn", "role", "text")
        .agg(F.count("*").alias("copies"))
        .withColumn("said", F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
        .withColumn("at", F.struct(F.col("turn").isNotNull().alias("given"), "turn"))
    )
    rows = attach_group_value(rows, ["conv_key", "said"], salt_of("turn"), F.col("at"), "first_at")
    blank = ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    # the places compared are never NULL as a whole
    repeated = ~F.col("at").eqNullSafe(F.col("first_at"))
    cut_off = ~F.rlike("text", F.lit(rf"[.!?]{SPACE}*\z"))
    initial = F.substring("role", 1, 1)
    code = F.lit(len(INITIALS))
    for k, letter in enumerate(INITIALS):
        code = F.when(initial == letter, k).otherwise(code)
    return rows.withColumns({
        "fault": F.when(blank, "blank").when(repeated, "duplicate").when(cut_off, "truncated"),
        "initial": code,
        "forced": blank | repeated,
        "cut_off": ~blank & ~repeated & cut_off,
    })


def repair_rows(turns: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text) with what the cheapest repair does to them.

    One row for each different row, with its number of ``copies``: ``fault`` of the first copy,
    ``edit`` (D, K or R) of the first copy (all others go, right behind it), ``new_role``, the
    initials of empty messages put in ``before`` it and ``after`` it, ``cost``, ``illegal`` (breaks
    of turn with the row before and among the copies). ``piece`` and ``pos`` order the rows.
    """
    line = F.concat_ws(":", "role", "text")
    order = ["conv_key", F.col("turn").asc_nulls_first()]
    faults = find_faults(turns)
    ordered = faults.repartitionByRange(*order, F.substr(line, F.lit(1), F.lit(DEALT_BY)))
    ordered = ordered.sortWithinPartitions(*order, line, "role").withColumn(
        "turn_key", key_of(F.col("turn"))
    )
    columns = [c.split()[0] for c in INPUT.split(", ")]
    first = materialize(
        ordered.select(*columns).mapInArrow(repair_partition, REPAIRED), "repaired"
    )
    whole = first.filter("edit IS NOT NULL")
    shared = repair_shared(
        first.filter("edit IS NULL").drop("edit", "new_role", "before", "after", "cost")
    )
    kinds = dict(turns.dtypes)
    repaired = whole.unionByName(shared)
    return repaired.withColumns({
        "conv_id": value_of(F.col("conv_key"), kinds["conv_id"]),
        "turn": value_of(F.col("turn_key"), kinds["turn"]),
    }).drop("conv_key", "turn_key", "initial", "forced", "cut_off")


def audit(row: str = "") -> Column:
    """The initials of the edits at a row, in order."""
    return F.concat(
        F.repeat(F.lit("I"), F.length(f"{row}before")),
        F.col(f"{row}edit"),
        F.repeat(F.lit("D"), (F.col(f"{row}copies") - 1).cast("int")),
        F.repeat(F.lit("I"), F.length(f"{row}after")),
    )


def messages() -> Column:
    """The messages a row of the result stands for, as structs of role and text, in order."""

    def put_in(initials: str) -> Column:
        # no letters, no messages
        return F.transform(
            F.filter(F.split(initials, ""), lambda c: c != ""),
            lambda c: F.struct(
                F.when(c == "u", NAMES["u"]).otherwise(NAMES["a"]).alias("role"),
                F.lit("").alias("text"),
            ),
        )

    stays = F.array(F.struct(F.col("new_role").alias("role"), F.col("text").alias("text")))
    return F.concat(
        put_in("before"),
        F.when(F.col("edit") != "D", stays).otherwise(F.slice(stays, 1, 0)),
        put_in("after"),
    )


def repaired_messages(rows: DataFrame) -> DataFrame:
    """The repaired conversations, one row a message: conv_id, piece, pos, place, role, text."""
    return rows.select("conv_id", "piece", "pos", F.posexplode(messages()).alias("place", "m")).select(
        "conv_id", "piece", "pos", "place", "m.role", "m.text"
    )
