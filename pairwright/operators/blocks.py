"""Ordered and grouped computations over groups of any size.

A window over a whole key puts that key into one task. Here a key is cut into blocks of consecutive
rows (or into salts, where order does not matter); the window runs inside a block, a one-row summary
per block is combined across the key, and the result is carried back to the rows of the block. A key
holding a third of all rows is then spread over as many tasks as it has blocks.

``blocks`` lists the block columns from the finest to the coarsest; each must be a function of the
one before it and must not decrease along ``order``. Keys and blocks must not be NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a densely numbered key that share a block, as a power of two.
BLOCK_BITS = 20
#: Parts an unordered key is cut into.
SALTS = 1024

Stage = Callable[[DataFrame, str], DataFrame]


def block_of(ordinal: Column | str, bits: int | None = None) -> Column:
    """The block a row number falls into."""
    bits = BLOCK_BITS if bits is None else bits
    return F.shiftright(F.col(ordinal) if isinstance(ordinal, str) else ordinal, bits)


def salt_of(*columns: str) -> Column:
    """A stable part number derived from what tells rows of a key apart."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    amount: Column,
    blocks: Sequence[str],
    out: str,
    stage: Stage | None = None,
) -> DataFrame:
    """Sum of ``amount`` over the rows of a key up to and including this one.

    With a ``stage`` the sums inside blocks are written once, and a block's total is the last of its
    sums; what the rows are made from is then worked out once. Without one a block is added up from
    the rows, which is cheaper where they are at hand.
    """
    inside = (
        Window.partitionBy(*keys, *blocks[:1])
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = df.withColumn(out, F.sum(amount).over(inside))
    if not blocks:
        return local
    block, coarser = blocks[0], list(blocks[1:])
    if stage is None:
        rows, total = df, F.sum(amount)
    else:
        rows = local = stage(local, "blocks")
        total = F.max_by(out, F.struct(*order))
    per_block = rows.groupBy(*keys, block).agg(
        total.alias("_block_total"), *[F.first(c).alias(c) for c in coarser]
    )
    before = (
        running_total(per_block, keys, [block], F.col("_block_total"), coarser, "_through")
        .select(*keys, block, (F.col("_through") - F.col("_block_total")).alias("_before"))
        .filter("_before <> 0")
    )
    return (
        local.join(before, [*keys, block], "left")
        .withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0)))
        .drop("_before")
    )


def occurrence_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    blocks: Sequence[str],
    out: str = "n",
    stage: Stage | None = None,
) -> DataFrame:
    """1 for the first row of a key, 2 for the second, and so on."""
    return running_total(df, keys, order, F.lit(1).cast("long"), blocks, out, stage)


def running_state(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    from_off: Column,
    from_on: Column,
    initial: Column,
    blocks: Sequence[str],
    out: str = "state_in",
) -> DataFrame:
    """The on/off state (1/0) in which each row of a key is reached.

    ``from_off`` and ``from_on`` give the state *after* a row that is reached off or on. Such a row
    either sets the state, flips it or leaves it alone, so any stretch of rows acts like one row:
    the last value set, if any, and the parity of the flips since. That is what a block passes on.
    """
    stated = _prefix_in_blocks(df, keys, order, from_off, from_on, blocks)
    return stated.withColumn(out, (F.coalesce("_set", initial) + F.col("_flips")) % 2).drop(
        "_set", "_flips"
    )


def _prefix_in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    from_off: Column,
    from_on: Column,
    blocks: Sequence[str],
) -> DataFrame:
    """:func:`state_prefix` over whole keys, put together from their blocks."""
    if not blocks:
        return state_prefix(df, keys, order, from_off, from_on)
    block, coarser = blocks[0], list(blocks[1:])
    rows = state_prefix(df, [*keys, block], order, from_off, from_on)
    sets = from_off == from_on
    after = F.struct(
        F.when(sets, from_off).otherwise(F.col("_set")).cast("int").alias("set"),
        F.when(sets, F.lit(0))
        .otherwise((F.col("_flips") + F.when(from_off > from_on, 1).otherwise(0)) % 2)
        .cast("int")
        .alias("flips"),
    )
    per_block = rows.groupBy(*keys, block).agg(
        F.max_by(after, F.struct(*order)).alias("_after"),
        *[F.first(c).alias(c) for c in coarser],
    )

    def acts(start: int) -> Column:
        return (F.coalesce("_after.set", F.lit(start)) + F.col("_after.flips")) % 2

    carry = f"_carried_{len(blocks)}"
    carried = _prefix_in_blocks(per_block, keys, [block], acts(0), acts(1), coarser).select(
        *keys, block, F.struct("_set", "_flips").alias(carry)
    )
    # what came before the block, then what came before the row inside it
    return (
        rows.join(carried, [*keys, block])
        .withColumn(
            "_flips",
            F.when(F.col("_set").isNotNull(), F.col("_flips")).otherwise(
                (F.col("_flips") + F.col(f"{carry}._flips")) % 2
            ),
        )
        .withColumn("_set", F.coalesce("_set", f"{carry}._set"))
        .drop(carry)
    )


def state_prefix(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], from_off: Column, from_on: Column
) -> DataFrame:
    """What all earlier rows of the key amount to: the last value set and the flips since."""
    whole = Window.partitionBy(*keys).orderBy(*order)
    through = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    flip = F.when(from_off > from_on, 1).otherwise(0)
    return (
        df.withColumn("_all", F.sum(flip).over(through))
        .withColumn(
            "_last_set",
            F.last(
                F.when(from_off == from_on, F.struct(from_off.alias("set"), F.col("_all"))),
                ignorenulls=True,
            ).over(earlier),
        )
        .withColumn("_set", F.col("_last_set.set").cast("int"))
        .withColumn(
            "_flips",
            ((F.col("_all") - flip - F.coalesce("_last_set._all", F.lit(0))) % 2).cast("int"),
        )
        .drop("_all", "_last_set")
    )


def attach_group_value(
    df: DataFrame, keys: Sequence[str], salt: Column, value: Column, out: str, how: str = "min"
) -> DataFrame:
    """Every row gets the smallest (or largest) ``value`` of its key."""
    pick = {"min": F.min, "max": F.max}[how]
    rows = df.withColumn("_salt", salt)
    parts = rows.groupBy(*keys, "_salt").agg(pick(value).alias("_part"))
    across = Window.partitionBy(*keys)
    whole = parts.select(*keys, "_salt", pick("_part").over(across).alias(out))
    return rows.join(whole, [*keys, "_salt"]).drop("_salt")


def look_up(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys`` for rows that carry a ``_salt``.

    The table is first joined to the (key, part) combinations that exist, so rows of one key never
    all meet its entry in a single task.
    """
    spread = rows.select(*keys, "_salt").distinct().join(table, list(keys))
    return rows.join(spread, [*keys, "_salt"], "left")
