"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct 5-word shingles, hashed to 64 bits. Of its 128 minima, groups of
four are hashed into the keys of 32 bands, and the lowest 4 bits of each minimum are kept, packed
into 64 bytes. Documents that share a band key are candidates; their similarity is estimated from
the number of equal low bits, corrected for the chance that different minima agree in them, and
links are confirmed on the full sets.

Two sets with similarity 0.75 share no band with probability (1 - 0.75^4)^32 = 5e-6, and an estimate
of 128 minima that is 0.2 too low is five standard deviations out, so estimates below threshold
minus 0.2 are dropped.

Copies are one class with one signature, so they make no pairs. Within a band key only a spanning
forest of the likeliest links is confirmed at first. Likely pairs of a key that are then still in
different components are all compared in a second step, set by set within the key, so no link
between components is lost; what comes out of a key is a forest again. A key that holds many near
copies thus gives as many rows as it has members. Keys with many members are cut into tiles of
bounded size.

Defined results: NULL, empty and blank texts have an empty set and link with nothing; a text of
fewer than five words is one shingle; copies and texts with equal sets are linked; different texts
under one id are documents of their own, and of those that are linked one is kept; equal rows get
equal results; a row without an id has no component and is kept; an empty table gives no rows; other
columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.graph import components
from pairwright.session import materialize

SHINGLE = 5
BANDS, ROWS, BITS = 32, 4, 4
PERMUTATIONS = BANDS * ROWS
#: How far an estimate may lie below the threshold.
MARGIN = 0.2
#: Members of a band key that are compared in one piece.
TILE = 2048
#: Words whose hashes a worker remembers.
REMEMBERED = 500_000

_draw = np.random.default_rng(20240501)
FACTORS = _draw.integers(0, 2**31, PERMUTATIONS, np.uint32) * 2 + 1
ADDENDS = _draw.integers(0, 2**32, PERMUTATIONS, np.uint32)
PLACES = _draw.integers(0, 2**62, SHINGLE, np.uint64) * 2 + 1
BAND_FACTORS = _draw.integers(0, 2**62, (BANDS, ROWS), np.uint64) * 2 + 1


class WordHashes(dict):
    """64-bit hashes of words, remembered while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> 30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> 27)) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> 31)


def shingles(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    values = np.array([hashes[w] for w in words], np.uint64)
    count = len(words) - size + 1
    total = values[:count] * PLACES[0]
    for k in range(1, size):
        total ^= (values[k : k + count] * PLACES[k]) + (total << 7)
    return np.unique(mixed(total))


def minima(values: np.ndarray) -> np.ndarray:
    """For each permutation the smallest image of the values."""
    low = (values >> 32).astype(np.uint32)
    best = np.full(PERMUTATIONS, 2**32 - 1, np.uint32)
    for k in range(0, len(low), 2048):
        image = low[k : k + 2048, None] * FACTORS + ADDENDS
        image ^= image >> 15
        image *= np.uint32(0x2C1B3C6D)
        image ^= image >> 12
        np.minimum(best, image.min(axis=0), out=best)
    return best


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, two to a byte."""
    low = (least & (2**BITS - 1)).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << BITS)


def band_keys(least: np.ndarray) -> np.ndarray:
    parts = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    return mixed((mixed(parts + np.uint64(1)) * BAND_FACTORS).sum(axis=2)).view(np.int64)


def similarity(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of one signature (8 words of 64 bits) with others."""
    odd = one ^ others
    odd |= odd >> 2
    odd |= odd >> 1
    odd &= np.uint64(0x1111111111111111)
    agree = 1 - np.bitwise_count(odd).sum(axis=-1) / PERMUTATIONS
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


SIGNATURE = "n_shingles bigint, digest binary, signature binary, bands array<bigint>"


def signatures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for texts in batches:
        sets = (shingles(t, hashes) for t in texts)
        sizes, digests, least = [], [], []
        for values in sets:
            sizes.append(len(values))
            digests.append(digest_of(values))
            least.append(minima(values))
        least = np.array(least, np.uint32).reshape(-1, PERMUTATIONS)
        yield pd.DataFrame(
            {
                "n_shingles": sizes,
                "digest": digests,
                "signature": [s.tobytes() for s in packed(least)],
                "bands": list(band_keys(least)),
            }
        )


def digest_of(values: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None


def shingle_sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for texts in batches:
        sets = [shingles(t, hashes) for t in texts]
        yield pd.DataFrame(
            {"digest": [digest_of(x) for x in sets], "set": [x.view(np.int64) for x in sets]}
        )


def forest(rows: np.ndarray, side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with the highest estimates, grown node by node.

    ``side`` is 0 and 1 where only pairs between the two sides count, else all 0.
    """
    n = len(rows)
    two_sided = bool(side.any())
    best, parent = np.full(n, -1.0), np.zeros(n, np.int64)
    waiting = np.ones(n, bool)
    edges = []
    node = 0
    for _ in range(n - 1):
        waiting[node] = False
        near = similarity(rows[node], rows)
        if two_sided:
            near[side == side[node]] = -1.0
        closer = near > best
        best[closer], parent[closer] = near[closer], node
        node = int(np.where(waiting, best, -2.0).argmax())
        if best[node] >= least:
            edges.append((int(parent[node]), node))
    return edges


def likely_apart(
    k: int, rows: np.ndarray, side: np.ndarray, group: np.ndarray, least: float
) -> np.ndarray:
    """The rows after row k that are in another group, and on the other side where there are two,
    with a sufficient estimate."""
    wanted = group[k + 1 :] != group[k]
    if side.any():
        wanted &= side[k + 1 :] != side[k]
    others = np.flatnonzero(wanted) + k + 1
    return others[similarity(rows[k], rows[others]) >= least]


def tile_rows(tile: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a tile, and the side of each row: 1 for the second of two chunks."""
    rows = np.frombuffer(b"".join(tile.signature), np.uint64).reshape(len(tile), -1)
    return rows, (tile.chunk.to_numpy() != tile.i.to_numpy()).astype(np.int8)


def forest_of_tile(tile: pd.DataFrame, least: float) -> pd.DataFrame:
    """First step: a spanning forest of likely pairs (a < b)."""
    reps = tile.rep.to_numpy()
    found = [(reps[a], reps[b]) for a, b in forest(*tile_rows(tile), least)]
    return pd.DataFrame([sorted(pair) for pair in found], columns=["a", "b"], dtype="int64")


def unsettled_of_tile(tile: pd.DataFrame, least: float) -> pd.DataFrame:
    """Second step: the rows that are in a likely pair across components."""
    rows, side = tile_rows(tile)
    group = tile.component.to_numpy()
    found = np.zeros(len(rows), bool)
    for k in range(len(rows) - 1):
        others = likely_apart(k, rows, side, group, least)
        found[others] = True
        found[k] |= len(others) > 0
    return tile[found]


def links_of_tile(tile: pd.DataFrame, least: float, threshold: int) -> pd.DataFrame:
    """Second step, with the sets: links across components, a spanning forest of them."""
    rows, side = tile_rows(tile)
    reps, group = tile.rep.to_numpy(), tile.component.to_numpy().copy()
    sizes = np.array([len(x) for x in tile["set"]])
    starts = np.cumsum(sizes) - sizes
    number = np.unique(np.concatenate(tile["set"].to_list()), return_inverse=True)[1]
    marked = np.zeros(int(number.max()) + 1, np.int64)
    found = []
    for k in range(len(rows) - 1):
        others = likely_apart(k, rows, side, group, least)
        if not len(others):
            continue
        own = number[starts[k] : starts[k] + sizes[k]]
        marked[own] = 1
        common = np.array([marked[number[starts[x] : starts[x] + sizes[x]]].sum() for x in others])
        marked[own] = 0
        linked = 100 * common >= threshold * (sizes[k] + sizes[others] - common)
        for x in others[linked]:
            if group[x] != group[k]:
                found.append(sorted((int(reps[k]), int(reps[x]))))
                group[group == group[x]] = group[k]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def by_tile(work):
    """Apply work to each tile (key, i, j) of partitions sorted by tile."""

    def of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last tile of a batch may go on in the next one
        for batch in batches:
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            tile = frame[["key", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist()]
            done = [
                work(frame.iloc[a:b]) for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1
            ]
            held = frame.iloc[bounds[-1] :]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held is not None and len(held) > 1:
            yield work(held)

    return of_partition


TILED = "key long, i int, j int, chunk int, rep long, signature binary, component long"


def tiles(members: DataFrame) -> DataFrame:
    """Members (key, n, rep, signature, component) dealt out by tile and sorted by it."""
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    return (
        members.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select(
            "key",
            F.least("chunk", "other").alias("i"),
            F.greatest("chunk", "other").alias("j"),
            "chunk",
            "rep",
            "signature",
            "component",
        )
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "rep")
    )


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose sets have at least ``threshold`` percent in common."""
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
        .withColumn("common", common)
        .filter(
            100 * F.col("common")
            >= threshold * (F.size("set_a") + F.size("set_b") - F.col("common"))
        )
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = 75,
    version: str | None = None,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; ids are whole numbers.

    ``threshold`` is the similarity in percent. With ``version`` there is a column of that name, a
    hash of the row's text, which with the id tells the rows of one id apart.
    """
    least = threshold / 100 - MARGIN
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed = materialize(
        texts.select(
            "id",
            F.xxhash64("text").alias("version"),
            F.pandas_udf(signatures, SIGNATURE)("text").alias("s"),
        ).select("id", "version", "s.*"),
        "signatures",
    )
    usable = signed.filter("digest is not null and id is not null")
    # equal sets are one class, whatever their ids; from here on a document is its class's number
    classes = materialize(
        usable.groupBy("digest")
        .agg(F.min(F.struct("id", "version")).alias("first"))
        .select("digest", "first", "first.id", F.monotonically_increasing_id().alias("rep")),
        "classes",
    )
    reps = materialize(
        usable.join(classes, ["digest", "id"])
        .select("rep", "signature", "bands")
        .dropDuplicates(["rep"]),
        "reps",
    )
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(
        keyed.join(shared, "key").join(reps.select("rep", "signature"), "rep"), "members"
    )
    first = materialize(
        tiles(members.withColumn("component", F.col("rep")))
        .mapInPandas(by_tile(partial(forest_of_tile, least=least)), "a long, b long")
        .distinct(),
        "pairs",
    )
    wanted = first.select(F.col("a").alias("rep")).union(first.select("b")).distinct()
    wanted = materialize(classes.join(wanted.hint("merge"), "rep", "leftsemi"), "wanted")
    # every document of a later candidate pair has a pair here as well; the ids grow with the
    # documents, so they are never broadcast, however few they are
    found = F.pandas_udf(shingle_sets, "digest binary, set array<bigint>")
    sets = materialize(
        texts.join(wanted.select("id").distinct().hint("merge"), "id", "leftsemi")
        .select("id", found("text").alias("s"))
        .select("id", "s.*")
        .join(wanted.hint("merge"), ["id", "digest"])
        .dropDuplicates(["rep"])
        .select(F.col("rep").alias("id"), "set"),
        "sets",
    )
    links = materialize(confirmed(first, sets, threshold), "links")
    grouped = components(links)
    placed = members.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    split = placed.groupBy("key").agg(
        F.min("component").alias("lowest"), F.max("component").alias("highest")
    )
    rest = placed.join(split.filter("lowest < highest").select("key"), "key", "leftsemi")
    unsettled = materialize(
        tiles(rest).mapInPandas(by_tile(partial(unsettled_of_tile, least=least)), TILED),
        "unsettled",
    )
    if not unsettled.isEmpty():
        more = materialize(
            unsettled.join(sets.withColumnRenamed("id", "rep"), "rep")
            .repartition("key", "i", "j")
            .sortWithinPartitions("key", "i", "j", "rep")
            .mapInPandas(
                by_tile(partial(links_of_tile, least=least, threshold=threshold)),
                "a long, b long",
            ),
            "links",
        )
        if not more.isEmpty():
            grouped = components(links.union(more))
    # of each component the first id, and of different texts under it the one of the least hash
    placed = classes.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    heads = placed.groupBy("component").agg(F.min("first").alias("head"))
    headed = placed.join(heads, "component").select("digest", "head")
    return signed.join(headed, "digest", "left").select(
        F.col("id").alias(id_col),
        *([F.col("version").alias(version)] if version else []),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("head.id", "id")).alias("component_id"),
        (
            F.col("id").isNull()
            | F.col("head").isNull()
            | (F.struct("id", "version") == F.col("head"))
        ).alias("kept"),
    )
