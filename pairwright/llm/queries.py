"""The corpus operators over their tables, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import (
    conversation_repair,
    decontamination,
    embedding_links,
    language_id,
    line_dedup,
    mixing,
    near_duplicates,
    oracles,
    periodic_runs,
    pii,
    sentence_pieces,
    sharding,
    token_counts,
    toxicity,
)
from pairwright.llm.frames import SPACED_WORD, count_words, fold, table
from pairwright.session import materialize, new_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, cast(doc_id AS VARCHAR) AS ident,
         CASE WHEN text IS NULL THEN 0 ELSE length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents
), w AS (
  SELECT *, CASE WHEN size > 0 THEN 1.0::DOUBLE + 3.0::DOUBLE
      * greatest(1.0::DOUBLE - abs(length(t)::DOUBLE / size - 6.5::DOUBLE) / 6.5::DOUBLE, 0.0::DOUBLE)
      ELSE 1.0::DOUBLE END AS weight,
    (('0x' || substr(md5('mix:' || coalesce(ident, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS sw
  FROM w GROUP BY source
), cand AS (
  -- the level at which the words wanted are met: with the sources at or below it stopped
  SELECT arg_min(lv, stop) AS level FROM (
    SELECT a.source_size / a.sw AS stop,
      (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
       - 2 * coalesce((SELECT sum(b.source_size) FROM s b WHERE b.source_size / b.sw < a.source_size / a.sw), 0))
      / (SELECT sum(b.sw) FROM s b WHERE b.source_size / b.sw >= a.source_size / a.sw) AS lv
    FROM s a)
  WHERE lv < 2 * stop
), t AS (
  SELECT source, source_size,
    CASE WHEN level * sw >= 2 * source_size THEN (2 * source_size)::DOUBLE ELSE level * sw END AS target
  FROM s, cand
), p AS (
  SELECT w.doc_id, w.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    sum(w.size) OVER (PARTITION BY w.source ORDER BY pow(u, 1.0::DOUBLE / weight) DESC, ident, w.size
                      ROWS UNBOUNDED PRECEDING) - w.size AS ahead
  FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + CASE WHEN ahead + size / 2.0::DOUBLE <= target - epochs * source_size THEN size ELSE 0 END)::BIGINT AS taken
FROM p
"""


@query("op2_mix_sources", OP2_SQL)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op7_virtual_slots")
def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents; ``next_shard`` is their shard once the map is edited for 17 shards."""
    docs = table(spark, sf_dir, "documents")
    path = new_dir(spark, "slot-map")
    parts = materialize(sharding.part_loads(docs), "slot-parts")
    placed = sharding.shard_documents(docs, 16, path=path, parts=parts)
    version = sharding.rebalance(spark, path, sharding.slot_loads(parts), 17)
    edited = sharding.load_map(spark, path, version)
    # one row a slot
    following = F.broadcast(edited.toDF("virtual_slot", "next_shard"))
    return placed.join(following, "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
        "next_shard",
    )


@query("op9_personal_data", oracles.OP9_SQL)
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k.name) for k in pii.KINDS],
        F.size(F.filter(spans, lambda s: s["score"] >= 0.7)).cast("long").alias("n_likely"),
        F.sha2(pii.joined(spans, pii.BASE), 256).alias("base_sha256"),
        pii.joined(spans).alias("spans"),
    )


@query("op3_decontaminate", oracles.OP3_SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        decontamination.contaminated("hits").alias("contaminated"),
    )


@query("op10_minhash_near_dedup", oracles.OP10_SQL)
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1))
    return toxicity.score_documents(docs, model).select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(language_id.labelled_sample(docs, fold("doc_id", 5) != 0))
    labelled = language_id.label_documents(docs.select("doc_id", "text"), model)
    return labelled.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


@query("op4_embedding_links", oracles.OP4_SQL)
def op4_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.link_embeddings(table(spark, sf_dir, "embeddings"))


#: A byte-level vocabulary; any tokenizer file of that kind will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@query("op8_token_counts")
def op8_token_counts(
    spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY
) -> DataFrame:
    automaton = token_counts.build(*token_counts.byte_level_pieces(vocabulary))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, automaton).select("doc_id", "tokens.*")


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_repeats(docs).select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"),
    )


def with_repetition(text: Column, doc_id: Column) -> Column:
    """The text as op13 reads it: of some documents the words from one on repeat with a period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = count_words(text).cast("int")
    words = F.regexp_extract_all(text, F.lit(f"({SPACED_WORD})"), F.lit(1))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    periods = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
    repeated = F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(periods), F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(repeated, " ")).otherwise(text)


@query("op13_periodic_runs", oracles.OP13_SQL)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", with_repetition(F.col("text"), F.col("doc_id")).alias("text")
    )
    runs = F.col("repeats.runs")
    # the greatest length, then the smallest start and period
    best = F.array_min(
        F.transform(
            runs,
            lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")),
        )
    )
    listed = F.transform(
        runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return periodic_runs.mark_runs(docs).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        best["s"].alias("start"),
        (-best["l"]).alias("length"),
        best["p"].alias("period"),
        F.floor(-best["l"] * 1000 / best["p"]).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("repeats.collapsed", 256).alias("collapsed_sha256"),
    )


@query("op11_sentence_pieces")
def op11_sentence_pieces(
    spark: SparkSession, sf_dir: str, model: str | None = None
) -> DataFrame:
    """``model``: the file of a piece model; a public one unless given."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentence_pieces.read_pieces(model)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentence_pieces.encode_texts(docs, pieces).select("doc_id", "ids")
    return sentence_pieces.decode_ids(encoded, pieces).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with the damage op12 repairs."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", ""))
    times = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    return (
        turns.filter(kind != 0)
        .withColumn("_time", F.explode(times))
        .select(
            "conv_id",
            "turn",
            F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
            text.otherwise(shown("text")).alias("text"),
        )
    )


@query("op12_conversation_repair", oracles.OP12_SQL)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = conversation_repair.repair_rows(damaged(turns))
    copies, fault = F.col("copies"), F.col("fault")
    again = F.when(fault == "blank", 0).otherwise(copies - 1)
    in_order = F.sort_array(
        F.collect_list(
            F.struct(
                "piece",
                "pos",
                conversation_repair.audit().alias("audit"),
                F.transform(
                    conversation_repair.messages(), lambda m: F.concat_ws(":", m["role"], m["text"])
                ).alias("lines"),
            )
        )
    )
    per_conversation = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.coalesce(F.sum(F.when(fault == "blank", copies)), F.lit(0)).alias("blank"),
        F.sum(again + F.when(fault == "duplicate", 1).otherwise(0)).alias("duplicate"),
        F.count_if(fault == "truncated").alias("truncated"),
        F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("cost"),
        in_order.alias("rows"),
    )
    repaired = per_conversation.select(
        F.col("conv_id").alias("_conv"),
        *[c for c in per_conversation.columns if c not in ("conv_id", "rows")],
        F.array_join(F.col("rows.audit"), "").alias("audit"),
        F.array_join(F.flatten(F.col("rows.lines")), "\n").alias("repaired"),
    )
    every = turns.select("conv_id").distinct()
    joined = every.join(repaired, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select(
        "conv_id",
        *[
            F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        ],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"),
    )
