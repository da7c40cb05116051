"""Give files that arrive in one folder under the same name names of their own.

The n-th file called ``a.csv`` is stored as ``a (n).csv``, unless that name is taken. It can only be
taken by a file that really was sent as ``a (n).csv``, so names are settled independently of each
other but for such pairs. Of those, what matters is how many files called ``a.csv`` came before the
first one sent as ``a (n).csv``: if the file that would be stored under that name is among them, it
gets the name and the other one has to look on; if not, the name is skipped.

What a name passes on to the one below it is thus a single bit, whether the lower name was used up.
Bits are put together along the chain of names (``a.csv``, ``a (2).csv``, ``a (2) (2).csv``, ...),
which is no longer than a file name allows. Files are counted block by block; the only list made for
a name holds the numbers under which other files were sent, not its own files. Counting never ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.naming import numbered_name, stem, suffix_as_is
from pairwright.operators.blocks import look_up, occurrence_number, running_total, salt_of
from pairwright.session import materialize

NAME = ["folder", "filename"]
ARRIVAL = ["received", "msg_id", "pos"]
#: Seconds of arrivals whose blocks are counted together.
BLOCK_SECONDS = 3600

#: A counter at the end of a stem. No file gets one of ten digits, so those are part of the name.
_COUNTER = r" \((?:[2-9]|[1-9][0-9]{1,8})\)"


def number_names(
    rows: DataFrame,
    filed: DataFrame | None = None,
    stage: Callable[[DataFrame, str], DataFrame] = materialize,
) -> DataFrame:
    """Add ``stored_name`` to files (``folder, filename, received, msg_id, pos``).

    ``filed`` lists the ``folder, filename`` of files that are already there. The counted files are
    written to the shared folder once, as several steps look at them.
    """
    counted = occurrence_number(_in_blocks(rows), NAME, ARRIVAL, ["_second", "_hour"], "_rank")
    ranked = stage(counted.drop("_second", "_hour"), "names")
    names = ranked.filter("_rank = 1").select(*NAME, F.struct(*ARRIVAL).alias("first"))
    if filed is None:
        names = names.withColumn("filed", F.lit(False))
    else:
        there = filed.select(*NAME).distinct().withColumn("_there", F.lit(True))
        names = names.join(there, NAME, "full_outer").select(
            *NAME, "first", F.coalesce("_there", F.lit(False)).alias("filed")
        )
    settled = _settle(names, ranked)
    special = (
        names.filter("filed")
        .select(*NAME)
        .join(settled, NAME, "full_outer")
        .select(
            *NAME,
            F.coalesce("start", F.lit(2)).alias("_start"),
            F.coalesce("skips", F.array().cast("array<bigint>")).alias("_skips"),
        )
    )
    skipped = F.size(F.filter("_skips", lambda place: place <= F.col("_rank")))
    counter = F.when(
        F.col("_start").isNotNull(), F.col("_start") - 1 + F.col("_rank") + skipped
    ).otherwise(F.col("_rank"))
    return (
        look_up(ranked.withColumn("_salt", salt_of("msg_id", "pos")), special, NAME)
        .withColumn("stored_name", numbered_name(F.col("filename"), counter))
        .drop("_start", "_skips", "_rank", "_salt")
    )


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with the blocks they are counted in; those without a time come first."""
    second = F.unix_timestamp(F.col("received").try_cast("timestamp"))
    return rows.withColumn("_second", F.coalesce(second, F.lit(-(2**40)))).withColumn(
        "_hour", F.floor(F.col("_second") / BLOCK_SECONDS)
    )


def _counters(name: Column) -> Column:
    """The counters a name ends in, as written: ``[' (2)', ' (3)']`` for 'a (2) (3).csv'."""
    return F.regexp_extract_all(
        stem(name), F.lit(f"({_COUNTER})(?=(?:{_COUNTER})*$)"), F.lit(1)
    )


def _without(name: Column, text: Column) -> Column:
    """A name without the counters ``text`` at the end of its stem."""
    kept = F.char_length(stem(name)) - F.char_length(text)
    return F.concat(F.substring(name, F.lit(1), kept), suffix_as_is(name))


def _settle(names: DataFrame, ranked: DataFrame) -> DataFrame:
    """Where counting starts, and which places skip a number, for names with such a neighbour.

    One row per name: ``start`` (1, or 2 if the name itself is used up) and ``skips``, the ranks
    from which on counters are one higher.
    """
    last = F.try_element_at("_counters", F.lit(-1))
    lower = (
        names.withColumn("_counters", _counters(F.col("filename")))
        .filter(F.size("_counters") > 0)
        .select(
            "folder",
            F.col("filename").alias("lower"),
            _without(F.col("filename"), last).alias("filename"),
            F.regexp_extract(last, "[0-9]+", 0).cast("long").alias("k"),
            F.col("first").alias("lower_first"),
            F.col("filed").alias("lower_filed"),
        )
    )
    links = lower.join(names.select(*NAME), NAME)
    involved = (
        links.select(*NAME)
        .union(links.select("folder", F.col("lower").alias("filename")))
        .distinct()
    )
    taken = (
        links.join(_arrived_before(links, ranked), [*NAME, "k"], "left")
        .groupBy(*NAME)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "k",
                        F.col("lower_filed").alias("filed"),
                        F.coalesce("before", F.lit(0).cast("long")).alias("before"),
                    )
                )
            ).alias("taken")
        )
    )
    known = (
        involved.join(taken, NAME, "left")
        .join(names.select(*NAME, "filed"), NAME)
        .withColumn("taken", F.coalesce("taken", F.array().cast(_TAKEN)))
        .withColumns({f"told_{bit}": _skips(bit + 1) for bit in (0, 1)})
    )
    passed = (
        known.select(
            *NAME,
            F.explode(F.arrays_zip(*[F.col(f"told_{b}.passed").alias(f"p{b}") for b in (0, 1)])).alias("z"),
        )
        .select(
            "folder",
            numbered_name(F.col("filename"), F.col("z.p0.k")).alias("filename"),
            F.col("z.p0.used").alias("passed_0"),
            F.col("z.p1.used").alias("passed_1"),
        )
    )
    steps = known.select(*NAME, "filed").join(passed, NAME, "left")
    chain = _counters(F.col("filename"))
    upper = involved.select(
        *NAME,
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.size(chain)),
                lambda d: _without(
                    F.col("filename"),
                    F.array_join(F.slice(chain, F.size(chain) - d + 1, d), ""),
                ),
            )
        ).alias("above", "upper"),
    )
    # a chain is no longer than a file name, so what is collected for one is small
    bits = (
        upper.join(
            steps.select(
                "folder", F.col("filename").alias("upper"), "filed", "passed_0", "passed_1"
            ),
            ["folder", "upper"],
        )
        .groupBy(*NAME)
        .agg(
            F.sort_array(
                F.collect_list(F.struct("above", "filed", "passed_0", "passed_1")), asc=False
            ).alias("steps")
        )
        .select(
            *NAME,
            F.aggregate(
                "steps",
                F.lit(False),
                lambda bit, s: s["filed"]
                | F.coalesce(F.when(bit, s["passed_1"]).otherwise(s["passed_0"]), F.lit(False)),
            ).alias("bit"),
        )
    )
    return known.join(bits, NAME).select(
        *NAME,
        (F.col("bit").cast("int") + 1).alias("start"),
        F.when(F.col("bit"), F.col("told_1.skips")).otherwise(F.col("told_0.skips")).alias("skips"),
    )


def _arrived_before(links: DataFrame, ranked: DataFrame) -> DataFrame:
    """For each number another file was sent under, how many files of the name came before it."""
    marks = links.filter("lower_first IS NOT NULL").select(
        *NAME, "lower_first.*", "k", F.lit(0).cast("long").alias("_one")
    )
    files = ranked.join(links.select(*NAME).distinct(), NAME, "left_semi").select(
        *NAME, *ARRIVAL, F.lit(None).cast("long").alias("k"), F.lit(1).cast("long").alias("_one")
    )
    together = running_total(
        _in_blocks(files.unionByName(marks)),
        NAME,
        ARRIVAL,
        F.col("_one"),
        ["_second", "_hour"],
        "before",
    )
    return together.filter("k IS NOT NULL").select(*NAME, "k", "before")


_TAKEN = "array<struct<k:bigint,filed:boolean,before:bigint>>"
_TOLD = "struct<skips:array<bigint>,passed:array<struct<k:bigint,used:boolean>>>"


def _skips(start: int) -> Column:
    """Numbers in rising order: which are skipped, and which are used before they are asked for.

    Counting begins at ``start``. With so many numbers skipped so far, the file whose turn number
    ``k`` is has the rank ``place``.
    """

    def step(told: Column, number: Column) -> Column:
        place = number["k"] - start + 1 - F.size(told["skips"])
        skip = number["filed"] | (place > number["before"])
        return F.struct(
            F.when(skip, F.concat(told["skips"], F.array(place)))
            .otherwise(told["skips"])
            .alias("skips"),
            F.concat(
                told["passed"], F.array(F.struct(number["k"].alias("k"), (~skip).alias("used")))
            ).alias("passed"),
        ).cast(_TOLD)

    none = F.struct(
        F.array().cast("array<bigint>").alias("skips"),
        F.array().cast("array<struct<k:bigint,used:boolean>>").alias("passed"),
    ).cast(_TOLD)
    return F.aggregate("taken", none, step)
