"""Small helpers the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def put(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add result columns; an input column of the same name, in any case, gives way."""
    names = {name.lower() for name in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[value.alias(name) for name, value in columns.items()])


def count_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for NULL.

    Each run becomes one mark together with the space before it, so no list of words is built.
    """
    marks = F.regexp_replace(text, f"{SPACE}*+{SPACED_WORD}+", "x")
    return F.coalesce(F.length(F.regexp_replace(marks, f"{SPACE}+", "")), F.lit(0)).cast("long")


def unit_interval(key: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 that depends on a text key and a seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def fold(name: str, folds: int) -> Column:
    """The part of the rows a row belongs to; a row without an id belongs to part 0."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(0)) % folds
