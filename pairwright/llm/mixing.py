"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target number of words. A document's key is u^(1/w), with u a number between 0
and 1 that its id alone decides and w its quality weight; documents are taken in falling order of
the key until the words of their source reach its target. A target above the size of the source is
met by complete epochs first, and only the rest is drawn.

Keys lie between 0 and 1, so each source is cut into blocks of equal key ranges: the words per block
say in which block the budget ends, and only that one block of each source has to be sorted. A
source of any size therefore never meets in one task.

Defined results: NULL and empty texts have size 0 and nothing is taken from them; a NULL source is a
source, ordered last; a NULL id is drawn like an empty one; repeated rows are drawn one by one, and
different texts under one id in the order of their digests, so reruns take the same texts; the document at the end of the budget is taken if that brings the total nearer to the target; a table
without words takes nothing; columns named like a result column are replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.frames import count_words, unit_interval
from pairwright.session import materialize

#: Key ranges a source is cut into.
BLOCKS = 8192
#: The mean length of a word that prose has, and how far off it may be.
USUAL_LENGTH, OFF_BY = 6.5, 6.5


def quality_weight(text: Column, words: Column) -> Column:
    """1 to 4: the nearer the mean length of a word is to that of prose. 1 without words."""
    mean = F.length(text).cast("double") / words
    off = F.abs(mean - USUAL_LENGTH) / OFF_BY
    return F.when(words > 0, 1.0 + 3.0 * F.greatest(1.0 - off, F.lit(0.0))).otherwise(1.0)


def source_targets(
    sizes: DataFrame, share: float = 1.5, weights: Sequence[int] = (5, 2, 1), most: int = 2
) -> DataFrame:
    """A target for each row (key, source, source_size); one row per source.

    Weights repeat over the sources in code point order, NULL last. A target stops at ``most`` times
    the size, and what is left over is shared among the others by weight. Sources reach that stop in
    the order of size per weight, so the sources that do are a prefix of that order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("nth", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(cycle, (F.col("nth") % len(weights) + 1).cast("int"))
    )
    by_stop = Window.orderBy(F.col("source_size") / F.col("weight"), "nth")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    spread = (
        weighed.withColumn("wanted", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn(
            "level",
            (F.col("wanted") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
            / F.sum("weight").over(onward),
        )
        .withColumn("full", F.col("level") * F.col("weight") >= most * F.col("source_size"))
    )
    # the first source that does not stop sets the level of all that follow
    stop = F.struct((F.col("source_size") / F.col("weight")).alias("stop"), "nth", "level")
    first = F.min(F.when(~F.col("full"), stop)).over(everything)
    return spread.withColumn("first", first).select(
        "key",
        "source_size",
        F.when(F.col("full"), (most * F.col("source_size")).cast("double"))
        .otherwise(F.col("first.level") * F.col("weight"))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    share: float = 1.5,
    source_weights: Sequence[int] = (5, 2, 1),
    most: int = 2,
    seed: str = "mix:",
    blocks: int = BLOCKS,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """All documents with size, source_size, target and taken (words, repeats counted).

    ``weight`` is a document's quality weight, 1 or more; smaller ones count as 1. ``keep`` names
    the columns of documents to return, all by default.
    """
    keep = docs.columns if keep is None else keep
    text = F.col(f"`{text_col}`")
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    named = F.col(f"`{source_col}`")
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"),
        F.coalesce(weight, F.lit(1.0)).alias("weight") if weight is not None else text.alias("text"),
        named.alias("source"),
        F.coalesce(F.concat(F.lit("="), named), F.lit("")).alias("key"),
        count_words(text).alias("size"),
        ident.alias("ident"),
        F.xxhash64(text).alias("digest"),
    )
    w = F.greatest(
        F.col("weight") if weight is not None else quality_weight(F.col("text"), F.col("size")),
        F.lit(1.0),
    )
    draw = F.pow(unit_interval(F.col("ident"), seed), F.lit(1.0) / w)
    keyed = sized.select(
        "doc", "source", "key", "size", "ident", "digest", draw.alias("draw")
    ).withColumn(
        "block", F.least(F.floor((1 - F.col("draw")) * blocks), F.lit(blocks - 1)).cast("int")
    )
    keyed = materialize(keyed, "mix")
    per_block = keyed.groupBy("key", "block").agg(
        F.sum("size").alias("words"), F.first("source").alias("source")
    )
    per_block = materialize(per_block, "mix-blocks")
    sizes = per_block.groupBy("key").agg(
        F.first("source").alias("source"), F.sum("words").alias("source_size")
    )
    targets = source_targets(sizes, share, source_weights, most)
    # at most `blocks` rows of a source meet here, whatever its size
    up_to = (
        Window.partitionBy("key")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    epochs = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(F.lit(0))
    through = per_block.withColumn("through", F.sum("words").over(up_to))
    plan = (
        through.join(targets, "key")
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .groupBy("key")
        .agg(
            F.first("source_size").alias("source_size"),
            F.first("target").alias("target"),
            F.first("epochs").alias("epochs"),
            F.first("rest").alias("rest"),
            F.min(F.when(F.col("through") > F.col("rest"), F.col("block"))).alias("last_block"),
            F.max(F.when(F.col("through") <= F.col("rest"), F.col("through"))).alias("reached"),
        )
    )
    # one row per source, stored so that Spark knows its size when it plans the join
    drawn = keyed.join(materialize(plan, "mix-plan"), "key")
    ends_here = F.col("block") == F.col("last_block")
    whole = drawn.filter(~F.coalesce(ends_here, F.lit(False))).withColumn(
        "drawn",
        F.when(F.col("last_block").isNull() | (F.col("block") < F.col("last_block")), F.col("size"))
        .otherwise(F.lit(0))
        .cast("long"),
    )
    in_block = (
        Window.partitionBy("key")
        .orderBy(F.col("draw").desc(), "ident", "size", "digest")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ahead = F.coalesce("reached", F.lit(0)) + F.sum("size").over(in_block) - F.col("size")
    partly = (
        drawn.filter(ends_here)
        .withColumn("ahead", ahead)
        .withColumn(
            "drawn",
            F.when(F.col("ahead") + F.col("size") / 2 <= F.col("rest"), F.col("size"))
            .otherwise(F.lit(0))
            .cast("long"),
        )
        .drop("ahead")
    )
    both = whole.unionByName(partly)
    flat = both.select(
        F.col("doc"),
        F.struct(
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.col("drawn")).alias("taken"),
        ).alias("mix"),
    )
    names = ("size", "source_size", "target", "taken")
    return flat.select(
        *[F.col(f"doc.`{c}`").alias(c) for c in keep if c.lower() not in names],
        *[F.col(f"mix.{name}").alias(name) for name in names],
    )
