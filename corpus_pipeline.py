"""From raw documents to shards of training text, one stage after the other.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again
as the next one's documents. Toxic documents go; of near copies one stays; contaminated documents
go; sources are mixed to their targets, so a document comes out as often as the mix takes it; the
rest is dealt into shards. All stages but the last return the columns of documents. Documents that
are clean and no copies pass the filters as they are, also those with a NULL text or id.

Toxicity and the near copies of whole tables are beyond SQL, so the pipeline has no SQL equivalent;
tests/llm compares it with plain Python on a small table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import decontamination, mixing, near_duplicates, sharding, toxicity
from pairwright.llm.frames import fold, fresh, table
from pairwright.session import materialize

SHARDS = 16
#: Scores from which a document is toxic.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)
    model = toxicity.learn(docs, labels)
    score = fresh(docs, "score")
    scored = toxicity.score_documents(docs, model, out=score)
    return scored.filter(F.col(score) < TOXIC).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is an id with its text; of rows equal in both the least one stays."""
    version = fresh(docs, "version")
    judged = near_duplicates.near_duplicates(docs, version=version)
    gone = judged.filter(~F.col("kept")).select("doc_id", version).distinct()
    rest = docs.withColumn(version, F.xxhash64("text")).join(gone, ["doc_id", version], "leftanti")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    named = rest.filter("doc_id is not null").groupBy("doc_id", version).agg(
        F.min(whole).alias("doc")
    )
    return named.select("doc.*").unionByName(rest.filter("doc_id is null").select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = fresh(docs, "hits")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), out=hits)
    return found.filter(~decontamination.contaminated(hits)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    mixed = mixing.mix(docs.select("doc_id", "text", "source", whole), keep=["doc"])
    times = (F.col("taken") / F.col("size")).cast("int")
    taken = mixed.filter("taken > 0").select("doc", F.explode(F.sequence(F.lit(1), times)))
    return taken.select("doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, SHARDS).withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
