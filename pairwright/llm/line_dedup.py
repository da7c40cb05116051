"""Line dedup by a segment-partition edit join.

Lines within so many edits of each other are copies as ``BUDGETS`` gives for the length of the
shorter one. A line is cut into one segment more than that, so at least one segment of a copy is untouched. Segments go into an index by length of the
line, number of the segment and content; a line probes it for its own length and the lengths it may
have grown from, with the substrings at the places where the segment can stand (those reachable by
the edits to its left, and by the edits to its right). Lines that meet are verified by banded
bit-parallel edit distance, after a count of letter classes that links cannot change by much.

Equal lines are one class first, however many there are. Lines below the first length in
``BUDGETS`` are only compared for equality: there one edit turns chance words into each other (the
README has figures). Blank lines are never removed. Of each component of copies the first line, by document id and
place, stays.

Defined results: NULL and empty texts have no lines that could be removed; repeated rows share an id,
a text and a place, so both keep or lose a line together; different texts under one id are documents
of their own; rows without an id take no part and keep all
lines; an empty table gives no rows; texts of any length are cut into lines and compared whole;
columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import put
from pairwright.llm.graph import components
from pairwright.session import materialize

EDITS, LEAST_LENGTH = 2, 15
#: From how many characters on how many edits are allowed; a length must be above its edits.
Budgets = tuple[tuple[int, int], ...]
BUDGETS: Budgets = ((8, 1), (LEAST_LENGTH, EDITS), (300, 3))
#: Lines of a key compared in one piece, and classes of characters that are counted.
TILE, CLASSES = 4096, 16
#: Characters whose keys are made at a time, and the base of the hashes of substrings (odd).
AT_A_TIME, BASE = 100_000, 0xD1342543DE82EF95


def segment(
    length: np.ndarray, number: np.ndarray, edits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Start (from 0) and size of a segment of lines of these lengths; later ones may be longer."""
    base = length // (edits + 1)
    longer = length - base * (edits + 1)  # so many of the last segments have one more
    extra = np.maximum(longer - (edits - number) - 1, 0)
    return base * number + extra, base + (longer > edits - number)


def allowed(length: int, budgets: Budgets = BUDGETS) -> int:
    """The edits that a line may be apart from one as long or longer."""
    return max((edits for least, edits in budgets if length >= least), default=0)


#: What a line is looked up by: how much shorter the other line is, which of its segments, and how
#: far that has moved.
Place = tuple[int, int, int]


def index_places(edits: int) -> list[Place]:
    """The segments of a line itself."""
    return [(0, k, 0) for k in range(edits + 1)]


def probe_places(edits: int) -> list[Place]:
    """Segments of lines as long as a line or up to ``edits`` shorter, wherever they can stand."""
    found = []
    for shorter in range(edits + 1):
        for k in range(edits + 1):
            # k edits may be to the left of segment k, the rest to its right; a line that gives
            # each segment a character has room for that at either end
            low = max(-k, shorter - (edits - k))
            high = min(k, shorter + (edits - k))
            found += [(shorter, k, move) for move in range(low, high + 1)]
    return found


def spread(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def powers(base: int, count: int) -> np.ndarray:
    """The first powers of a number modulo 2^64."""
    found = np.full(count, base, np.uint64)
    found[:1] = 1
    return np.multiply.accumulate(found, out=found)


class Substrings:
    """Hashes of substrings of lines, each from two prefix sums.

    A prefix sum adds the character at place k times ``BASE`` to the k, modulo 2^64, so the
    difference of two sums divided by the power of the start depends on the substring alone.
    """

    def __init__(self, lines: list[str]):
        self.length = np.array([len(x) for x in lines], np.int64)
        self.begins = np.cumsum(self.length) - self.length
        longest = int(self.length.max(initial=0)) + 1
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        places = np.arange(len(codes)) - np.repeat(self.begins, self.length)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        values = (codes + np.uint64(1)) * powers(BASE, longest)[places]
        np.cumsum(values, out=self.sums[1:])
        self.inverse = powers(pow(BASE, -1, 2**64), longest)

    def hashes(self, which: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        length, begins = self.length[which], self.begins[which]
        start = np.clip(start, 0, length)
        end = np.minimum(start + size, length)
        return (self.sums[begins + end] - self.sums[begins + start]) * self.inverse[start]


def keys_of(
    lines: list[str], budgets: Budgets, places: Callable[[int], list[Place]], growth: bool
) -> list[tuple[np.ndarray, np.ndarray]]:
    """(line, key) for all places of the lines, or of those they may be copies of, by the edits of
    each length.

    Lines a little longer than a budget goes also probe it. Keys of lengths beyond it find nothing,
    or lines that are verified as all others.
    """
    text = Substrings(lines)
    found = []
    for (least, edits), above in zip(budgets, [*budgets[1:], None], strict=True):
        some = text.length >= least
        if above:
            some &= text.length < above[0] + (edits if growth else 0)
        which = np.flatnonzero(some)
        shorter, number, move = np.array(places(edits))[:, :, None].transpose(1, 0, 2)
        other = text.length[which] - shorter  # a row for each place, a column for each line
        start, size = segment(other, number, edits)
        kind = spread(((other << 8) + number).astype(np.uint64))
        key = spread(text.hashes(which, start + move, size) ^ kind).view(np.int64)
        found.append((np.broadcast_to(which, key.shape).ravel(), key.ravel()))
    return found


def keyed(lines: DataFrame, budgets: Budgets, places, growth: bool) -> DataFrame:
    """(number, key) of the lines, or of those they may be copies of."""

    def of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number, line = batch.number.to_numpy(), batch.line.tolist()
            ends = np.cumsum([len(x) for x in line]) // AT_A_TIME
            cuts = (np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist()
            for a, b in pairwise([0, *cuts, len(line)]):
                found = keys_of(line[a:b], budgets, places, growth)
                yield pd.DataFrame(
                    {
                        "number": np.concatenate([number[a:b][which] for which, _ in found]),
                        "key": np.concatenate([key for _, key in found]),
                    }
                )

    return lines.select("number", "line").mapInPandas(of_partition, "number long, key long")


def within(one: str, two: str, edits: int = EDITS) -> bool:
    """Whether two strings are within so many edits.

    Only the band of cells within ``edits`` of the diagonal is looked at. Its vertical steps in one
    column are two bit vectors, up and down, which move one row down with each column.
    """
    if abs(len(one) - len(two)) > edits:
        return False
    first, last = 0, min(len(one), len(two))
    while first < last and one[first] == two[first]:
        first += 1
    end = 0
    while end < last - first and one[-1 - end] == two[-1 - end]:
        end += 1
    one, two = one[first : len(one) - end], two[first : len(two) - end]
    if len(one) > len(two):
        one, two = two, one
    rows, columns = len(one), len(two)
    if rows == 0:
        return columns <= edits
    places: dict[str, int] = {}
    for k, c in enumerate(one):
        places[c] = places.get(c, 0) | 1 << k
    width = 2 * edits + 1
    full = (1 << width) - 1
    # column 0: row r has value r; bit t is row t - edits, and rows above 0 count as level
    up = full & ~((1 << edits + 1) - 1)
    down = 0
    row = min(edits, rows)  # the row whose value is followed, and the value
    value = row
    for column in range(1, columns + 1):
        up = up >> 1 | 1 << width - 1
        down >>= 1
        top = column - edits  # the row of bit 0
        match = places.get(two[column - 1], 0)
        match = (match >> top - 1 if top >= 1 else match << 1 - top) & full
        if top < 1:  # bits of row 0 and above stand for the border, which rises with the column
            border = (1 << 1 - top) - 1
            up &= ~border
            down &= ~border
        same = (((match & up) + up) ^ up | match | down) & full
        right, left = (down | ~(same | up)) & full, up & same
        if top < 1:
            right |= border
            left &= ~border
        here = row + 1 <= rows and row + 1 <= column + edits
        if here:  # down the diagonal
            row += 1
            value += 0 if same >> row - top & 1 else 1
        else:
            value += (right >> row - top & 1) - (left >> row - top & 1)
        if value > edits + (rows - row) + (columns - column):
            return False
        right = right << 1 | 1
        left <<= 1
        up = (left | ~(same | right)) & full
        down = right & same & full
    return value <= edits


def letter_counts(line: str) -> np.ndarray:
    """How often characters of each of 16 classes occur; an edit changes this by two at most."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(codes % CLASSES, minlength=CLASSES)


def links_of_tile(tile: pd.DataFrame, budgets: Budgets) -> list[tuple[int, int]]:
    """Links between index and probe lines of a tile, without those their links already imply."""
    number, line = tile.number.to_numpy(), tile.line.to_numpy()
    counts = np.array([letter_counts(x) for x in line])
    length = np.array([len(x) for x in line])
    budget = np.array([allowed(n, budgets) for n in length])
    probing = tile.probing.to_numpy()
    index, probe = np.flatnonzero(~probing), np.flatnonzero(probing)
    group = {n: n for n in number}
    found = []
    for k in index:
        edits = np.minimum(budget[probe], budget[k])  # that of the shorter line
        near = np.abs(counts[probe] - counts[k]).sum(axis=1) <= 2 * edits
        # lines of the same length probe each other: once is enough
        near &= (length[probe] > length[k]) | (number[probe] > number[k])
        for other, most in zip(probe[near], edits[near].tolist(), strict=True):
            a, b = number[k], number[other]
            if a != b and group[a] != group[b] and within(line[k], line[other], most):
                found.append((int(min(a, b)), int(max(a, b))))
                old, new = group[b], group[a]
                group = {n: new if g == old else g for n, g in group.items()}
    return found


def links_of_tiles(budgets: Budgets):
    def of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last tile of a batch may go on in the next one
        for batch in chain(batches, [None]):
            frame = held if batch is None else batch if held is None else pd.concat([held, batch])
            if frame is None:
                continue
            frame = frame.reset_index(drop=True)
            tile = frame[["key", "i", "j"]].to_numpy()
            cuts = (np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1)) + 1).tolist()
            bounds = [0, *cuts, len(frame)] if batch is None else [0, *cuts]
            found = set()
            for a, b in pairwise(bounds):
                if b - a > 1:
                    found.update(links_of_tile(frame.iloc[a:b], budgets))
            held = frame.iloc[bounds[-1] :]
            yield pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return of_partition


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, version, place, line) of all lines that are not blank; a version is a text of an id."""
    return (
        docs.filter(F.col(f"`{id_col}`").isNotNull())
        .select(
            F.col(f"`{id_col}`").alias("id"),
            F.xxhash64(F.col(f"`{text_col}`")).alias("version"),
            F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("place", "line"),
        )
        .filter(F.length(F.trim("line")) > 0)
    )


def connecting_links(
    index: DataFrame, probe: DataFrame, text: DataFrame, budgets: Budgets
) -> DataFrame:
    """Links (a, b) that connect whatever lines are within their edits.

    Lines that meet others under a key are rows of that key, not pairs. They get their text and are
    compared key by key, in tiles of bounded size, and a tile gives at most as many links as it has
    lines.
    """
    one, two = index.alias("one"), probe.alias("two")
    meets = (F.col("one.key") == F.col("two.key")) & (F.col("one.number") != F.col("two.number"))
    # the many probes travel once; of the index, which is smaller, the keys that were hit follow
    asking = materialize(two.join(one, meets, "leftsemi"), "asking")
    asked = index.join(asking.select("key").distinct(), "key", "leftsemi").select("number", "key")
    members = asking.withColumn("probing", F.lit(True)).union(
        asked.withColumn("probing", F.lit(False))
    )
    members = materialize(members, "members")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("number"), chunks).cast("int")
    tiled = (
        members.join(sizes, "key")
        .join(text, "number")
        .withColumn("own", mine)
        .withColumn("all", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select(
            "key",
            F.when(F.col("probing"), F.col("all")).otherwise(F.col("own")).alias("i"),
            F.when(F.col("probing"), F.col("own")).otherwise(F.col("all")).alias("j"),
            "probing",
            "number",
            "line",
        )
    )
    return materialize(
        tiled.repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInPandas(links_of_tiles(budgets), "a long, b long"),
        "links",
    )


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budgets: Budgets = BUDGETS
) -> DataFrame:
    """(id, version, place) of the lines to remove, each once."""
    lines = lines_of(docs, id_col, text_col)
    digest = F.unhex(F.md5("line")).alias("digest")
    hashed = lines.select("id", "version", "place", digest)
    classes = materialize(
        lines.groupBy("line")
        .agg(F.min(F.struct("id", "version", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("number", F.monotonically_increasing_id())
        .withColumn("length", F.length("line"))
        .withColumn("digest", digest),
        "lines",
    )
    long = classes.filter(F.col("length") >= budgets[0][0])
    index = keyed(long, budgets, index_places, growth=False)
    probe = keyed(long, budgets, probe_places, growth=True)
    links = connecting_links(index, probe, long.select("number", "line"), budgets)
    grouped = components(links).withColumnRenamed("node", "number")
    # from here on lines are their digests: no text is shuffled again
    named = classes.select("number", "digest", "first", "n")
    joined = named.join(grouped, "number", "left")
    joined = joined.filter("n > 1 or component is not null").withColumn(
        "component", F.coalesce("component", "number")
    )
    heads = joined.groupBy("component").agg(F.min("first").alias("head"))
    kept = joined.join(heads, "component").select("digest", "head")
    return (
        hashed.join(kept, "digest")
        .filter(F.struct("id", "version", "place") != F.col("head"))
        .select("id", "version", "place")
        .distinct()
    )


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budgets: Budgets = BUDGETS
) -> DataFrame:
    """All documents with n_lines, n_removed, removed (places from 0) and the text that stays.

    The text column holds what stays; a NULL text stays NULL.
    """
    removed = (
        repeated_lines(docs, id_col, text_col, budgets)
        .groupBy(F.col("id").alias("_line_owner"), F.col("version").alias("_line_version"))
        .agg(F.array_sort(F.collect_set("place")).alias("_line_places"))
    )
    text = F.col(f"`{text_col}`")
    lines = F.split(text, "\n")
    places = F.coalesce("_line_places", F.array().cast("array<int>"))
    stays = F.filter(lines, lambda x, k: ~F.array_contains(places, k))
    counted = put(
        docs,
        {
            "n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"),
            "_line_text": F.xxhash64(text),
        },
    )
    same = (F.col(f"`{id_col}`") == F.col("_line_owner")) & (
        F.col("_line_text") == F.col("_line_version")
    )
    joined = counted.join(removed, same, "left")
    return put(
        joined,
        {
            "n_removed": F.size(places).cast("long"),
            "removed": places,
            text_col: F.when(F.size(places) == 0, text).otherwise(F.array_join(stays, "\n")),
        },
    ).drop("_line_owner", "_line_version", "_line_text", "_line_places")
