"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors of length one with cosine c are 2 - 2c apart, squared. They are rotated at random, so that
no part of the space holds more of a distance than another, and split into blocks of a few
dimensions. If two vectors are within the budget, they are within its proportional share in at least
one block. Each block is therefore joined by range: the first dimensions of the block make a grid
with cells twice as wide as the share's radius, a vector goes to its own cell and to the next ones
upwards if it is within a radius of them, and vectors that meet in a cell are compared there.

A pair is a candidate in every block where it is within the share, but counted in the first of them
only, and only in the cell where the two meet by rule, so links are counted once without listing
them. Candidates are verified with the cosine in double precision. A cell returns for each vector
the number of its links and one of the vectors it is connected with, so a group of near copies of
any size gives as many rows as it has vectors. Cells with many vectors are cut into tiles.

Equal vectors are one class, joined once, and count as links of each other.

Defined results: vectors that are NULL, zero, or hold NULL or a number that is not finite, and those
without a label, link with nothing; vectors of different lengths do not link; rows that share an id
are one node; a row without an id has no component and is kept; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.graph import components
from pairwright.session import materialize

#: Dimensions of a block, and of the grid in a block.
BLOCK, GRID = 8, 3
#: Vectors of a cell compared in one piece, and rows and pairs handled at a time.
TILE, ROWS, PAIRS = 4096, 1024, 50_000
#: Rounding of sums of squares of coordinates of at most 1.
ROUNDING = 1e-9


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix that depends on the number of dimensions alone."""
    q, r = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[slice]:
    return [slice(k, min(k + BLOCK, dims)) for k in range(0, dims, BLOCK)]


def shares(dims: int, cosine: float) -> list[float]:
    """The squared distance each block may have."""
    return [(2 - 2 * cosine) * (b.stop - b.start) / dims + ROUNDING for b in blocks_of(dims)]


def unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that very small and very large vectors keep their direction
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def home_cells(block: np.ndarray, share: float) -> np.ndarray:
    return np.floor(block[:, :GRID] / (2 * np.sqrt(share))).astype(np.int64)


def cell_number(cells: np.ndarray) -> np.ndarray:
    number = np.zeros(len(cells), np.int64)
    for k in range(cells.shape[1]):
        number = (number << 20) + cells[:, k] + (1 << 19)
    return number


def cell_finder(cosine: float):
    """For each vector the blocks and cells it takes part in."""

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[list[tuple[int, int]]] = [[] for _ in range(len(batch))]
            sizes = batch.map(len).to_numpy()
            for dims in np.unique(sizes):
                where = np.flatnonzero(sizes == dims)
                rows = unit(np.stack(batch.to_numpy()[where]).astype(float)) @ rotation(dims)
                for b, (block, share) in enumerate(
                    zip(blocks_of(dims), shares(dims, cosine), strict=True)
                ):
                    radius = np.sqrt(share)
                    home = home_cells(rows[:, block], share)
                    upper = rows[:, block][:, :GRID] + radius >= (home + 1) * 2 * radius
                    for step in np.ndindex(*[2] * home.shape[1]):
                        move = np.array(step)
                        fits = (upper | (move == 0)).all(axis=1)
                        for k, cell in zip(
                            where[fits], cell_number(home[fits] + move), strict=True
                        ):
                            out[k].append((b, int(cell)))
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(find, "array<struct<block:int,cell:bigint>>")


def links_of_tile(tile: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """For each vector of a tile with links: how many, and a vector it is connected with."""
    order = np.argsort(tile.rep.to_numpy(), kind="stable")
    reps, sizes = tile.rep.to_numpy()[order], tile["size"].to_numpy()[order]
    side = (tile.chunk.to_numpy() != tile.i.to_numpy())[order]
    two_sided = bool(side.any())
    raw = np.stack(tile.embedding.to_numpy()[order]).astype(float)
    lengths = np.sqrt((raw**2).sum(axis=1))
    plain = np.isfinite(lengths) & (lengths > 1e-150)
    units = unit(raw)
    dims = raw.shape[1]
    rows = units @ rotation(dims)
    cuts, limits = blocks_of(dims), shares(dims, cosine)
    this = int(tile.block.iloc[0])
    block = rows[:, cuts[this]]
    home = home_cells(block, limits[this])
    cell = int(tile.cell.iloc[0])
    square = (block**2).sum(axis=1)
    count = np.zeros(len(raw), np.int64)
    root = np.arange(len(raw))
    for a in range(0, len(raw), ROWS):
        for b in range(a, len(raw), ROWS):
            one, two = slice(a, a + ROWS), slice(b, b + ROWS)
            apart = square[one, None] + square[None, two] - 2 * block[one] @ block[two].T
            x, y = np.nonzero(apart <= limits[this])
            x, y = x + a, y + b
            wanted = x < y
            if two_sided:
                wanted &= side[x] != side[y]
            x, y = x[wanted], y[wanted]
            for k in range(0, len(x), PAIRS):
                p, q = x[k : k + PAIRS], y[k : k + PAIRS]
                here = cell_number(np.maximum(home[p], home[q])) == cell
                p, q = p[here], q[here]
                for earlier in range(this):
                    gap = ((rows[p, cuts[earlier]] - rows[q, cuts[earlier]]) ** 2).sum(axis=1)
                    later = gap > limits[earlier]
                    p, q = p[later], q[later]
                both = plain[p] & plain[q]
                value = np.where(
                    both,
                    (raw[p] * raw[q]).sum(axis=1) / np.where(both, lengths[p] * lengths[q], 1),
                    (units[p] * units[q]).sum(axis=1),
                )
                p, q = p[value >= cosine], q[value >= cosine]
                np.add.at(count, p, sizes[q])
                np.add.at(count, q, sizes[p])
                unite(root, p, q)
    linked = np.flatnonzero(count)
    return pd.DataFrame({"rep": reps[linked], "links": count[linked], "to": reps[root[linked]]})


def unite(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Join the groups of each pair; ``root`` holds the smallest member of each one's group."""
    while len(p):
        least = np.minimum(root[p], root[q])
        np.minimum.at(root, root[p], least)
        np.minimum.at(root, root[q], least)
        while (root[root] != root).any():
            root[:] = root[root]
        split = root[p] != root[q]
        p, q = p[split], q[split]


def tile_links(cosine: float):
    keys = ["label", "dims", "block", "cell", "i", "j"]
    nothing = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("rep", "links", "to")})

    def of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the tile at the end of a batch may go on in the next one
        for batch in batches:
            if held and (held[-1][keys].iloc[-1] == batch[keys].iloc[0]).all():
                start = (batch[keys] == batch[keys].iloc[0]).all(axis=1).to_numpy()
                size = int(np.argmin(start)) if not start.all() else len(batch)
                held.append(batch.iloc[:size])
                batch = batch.iloc[size:]
            if not len(batch):
                continue
            if held:
                yield finished(held)
            tile = batch[keys].to_numpy()
            cuts = np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist()]
            done = [links_of_tile(batch.iloc[a:b], cosine) for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1]
            if done:
                yield pd.concat(done)
            held = [batch.iloc[bounds[-1] :]]
        if held:
            yield finished(held)

    def finished(held: list[pd.DataFrame]) -> pd.DataFrame:
        tile = pd.concat(held)
        return links_of_tile(tile, cosine) if len(tile) > 1 else nothing

    return of_partition


def link_embeddings(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.93,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; ids are whole numbers."""
    rows = vectors.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{label_col}`").alias("label"),
        F.col(f"`{vector_col}`").alias("embedding"),
    )
    usable = (
        F.col("id").isNotNull()
        & F.col("label").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall(
            "embedding",
            lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
        )
        & F.exists("embedding", lambda x: x != 0)
    )
    classes = materialize(
        rows.filter(usable)
        .groupBy("label", "embedding")
        .agg(F.min("id").alias("rep"), F.countDistinct("id").alias("size"))
        .withColumn("dims", F.size("embedding"))
        .withColumn("places", cell_finder(cosine)("embedding")),
        "classes",
    )
    placed = classes.withColumn("place", F.explode("places")).select(
        "label", "dims", "place.block", "place.cell", "rep", "size", "embedding"
    )
    cell = ["label", "dims", "block", "cell"]
    full = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    tiles = (
        placed.join(full, cell)
        .withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .withColumn("i", F.least("chunk", "other"))
        .withColumn("j", F.greatest("chunk", "other"))
        .drop("n", "other")
    )
    found = materialize(
        tiles.repartition(*cell, "i", "j")
        .sortWithinPartitions(*cell, "i", "j")
        .mapInPandas(tile_links(cosine), "rep long, links long, to long"),
        "links",
    )
    grouped = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = (
        classes.select("label", "embedding", "rep", "size")
        .join(counted, "rep", "left")
        .join(grouped.withColumnRenamed("node", "rep"), "rep", "left")
    )
    joined = rows.join(per_class, ["label", "embedding"], "left")
    own = F.when(usable, F.coalesce("component", "rep")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_col),
        F.when(usable, F.coalesce("links", F.lit(0)) + F.col("size") - 1)
        .otherwise(F.lit(0))
        .cast("long")
        .alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"),
    )
