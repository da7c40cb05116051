"""Incoming messages: which source they belong to and where their attachments go.

Messages carry ``msg_id, subject, received`` and ``attachments``, an array of
``pos, filename, size, content_hash``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.functions.naming import is_data, safe_filename
from pairwright.operators.blocks import look_up, salt_of
from pairwright.operators.file_names import number_names
from pairwright.operators.fragments import FragmentIndex
from pairwright.session import materialize
from pairwright.specs import Config, Source, as_date


def received_in_range(messages: DataFrame, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Messages received from ``start`` to the end of ``end``; a plain range the scan can use."""
    start, end = as_date(start), as_date(end)
    if end < start:
        raise ValueError(f"end date {end} is before start date {start}")
    kind = messages.schema["received"].dataType
    low = F.lit(start.isoformat()).cast(kind)
    high = F.lit((end + dt.timedelta(days=1)).isoformat()).cast(kind)
    return messages.filter((F.col("received") >= low) & (F.col("received") < high))


def received_date(received: Column, is_text: bool = False) -> Column:
    """The day of a message; text counts by its leading ISO date."""
    if is_text:
        return F.substring(received, 1, 10).try_cast("date")
    return F.to_date(received)


def attachment_names(attachments: Column | str = "attachments") -> Column:
    names = F.col(attachments)["filename"] if isinstance(attachments, str) else attachments
    return F.coalesce(names, F.array().cast("array<string>"))


def rule_matches(source: Source, subject: Column, names: Column) -> Column:
    """Every subject fragment is in the subject, or any file fragment is in any file name."""
    subject = F.lower(F.coalesce(subject, F.lit("")))
    by_subject = F.lit(bool(source.subject_all))
    for fragment in source.subject_all:
        by_subject = by_subject & F.contains(subject, F.lit(fragment.lower()))
    by_name = F.lit(False)
    for fragment in source.attachment_contains:
        by_name = by_name | F.exists(names, _holds(fragment))
    return by_subject | by_name


def _holds(fragment: str) -> Callable[[Column], Column]:
    """A test of one file name for a fragment, without regard to case."""
    return lambda name: F.contains(
        F.lower(F.coalesce(name, F.lit(""))), F.lit(fragment.lower())
    )


def rule_index(spark: SparkSession, config: Config) -> FragmentIndex:
    """The fragments of all rules; the owner of a rule is its source's place in the configuration."""
    return FragmentIndex(
        spark,
        [("subject", f, k) for k, s in enumerate(config.sources) for f in s.subject_all]
        + [("name", f, k) for k, s in enumerate(config.sources) for f in s.attachment_contains],
    )


def classify(messages: DataFrame, config: Config) -> DataFrame:
    """Messages with the first configured source whose rule matches; NULL for none.

    What a message is classified by, its subject and file names, is looked up once however many
    messages share it, and in one join however many sources there are.
    """
    spark = messages.sparkSession
    subject, names = F.coalesce("subject", F.lit("")), attachment_names()
    keyed = messages.drop("source").withColumn("_key", F.md5(F.to_json(F.struct(subject.alias("s"), names.alias("n")))))
    distinct = keyed.select(
        F.col("_key").alias("key"), subject.alias("subject"), names.alias("names")
    ).dropDuplicates(["key"])
    texts = distinct.select(
        "key",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("subject").alias("kind"), F.col("subject").alias("text"))),
                F.transform(
                    F.array_distinct("names"),
                    lambda n: F.struct(
                        F.lit("name").alias("kind"), F.coalesce(n, F.lit("")).alias("text")
                    ),
                ),
            )
        ).alias("t"),
    ).select("key", "t.*")
    needed = [(k, s.name, len({f.lower() for f in s.subject_all})) for k, s in enumerate(config.sources)]
    rules = spark.createDataFrame(needed, "owner int, source string, subject_needs int")
    found = (
        rule_index(spark, config)
        .find(texts)
        .groupBy("key", "owner")
        .agg(
            F.count_if(F.col("kind") == "subject").alias("in_subject"),
            F.count_if(F.col("kind") == "name").alias("in_names"),
        )
        .join(F.broadcast(rules), "owner")
        .filter(
            (F.col("in_names") > 0)
            | ((F.col("subject_needs") > 0) & (F.col("in_subject") == F.col("subject_needs")))
        )
    )
    first = found.groupBy(F.col("key").alias("_key")).agg(F.min_by("source", "owner").alias("source"))
    return keyed.join(first, "_key", "left").drop("_key")


def classified(messages: DataFrame, config: Config, only: str | None = None) -> DataFrame:
    """Messages that belong to a source, with it.

    ``only`` is applied after classification, so that asking for one source never moves a message
    to it that an earlier rule claims.
    """
    found = classify(messages, config).filter("source IS NOT NULL")
    return found if not only else found.filter(F.lower("source") == only.lower())


def skipped_reason(name: Column, size: Column, config: Config) -> Column:
    """Why an attachment is not kept; NULL when it is.

    Data files are kept at any size; others only when not known to be too small.
    """
    too_small = size.isNotNull() & (size < config.min_attachment_bytes)
    return F.when(
        ~is_data(name, config.data_extensions) & too_small,
        F.concat(F.lit("under the least size ("), size.cast("string"), F.lit(" bytes)")),
    )


def _is_text(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "string"


def attachments_of(messages: DataFrame, config: Config) -> DataFrame:
    """One row per attachment of classified messages, with its safe name and target folder.

    A message without a readable date has no folder; its attachments are skipped for that reason.
    """
    rows = messages.select(
        "source",
        "msg_id",
        "subject",
        "received",
        received_date(F.col("received"), _is_text(messages, "received")).alias("run_date"),
        F.explode("attachments").alias("a"),
    )
    named = rows.select(
        "source",
        "run_date",
        "msg_id",
        "subject",
        "received",
        F.col("a.pos").alias("pos"),
        safe_filename(F.col("a.filename")).alias("filename"),
        F.col("a.size").alias("size"),
        F.col("a.content_hash").alias("content_hash"),
    )
    folder = config.run_path("source", "run_date")
    return (
        named.withColumn(
            "skipped_reason",
            F.when(F.col("run_date").isNull(), F.lit("no date of receipt")).otherwise(
                skipped_reason(F.col("filename"), F.col("size"), config)
            ),
        )
        .withColumn("folder", folder)
        .withColumn("root", F.regexp_replace("folder", "/[^/]*$", ""))
    )


#: Keys of new attachments that are sent to all tasks: some 20 MB at most.
FEW_KEYS = 100_000


def narrowed(archive: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of an archive that share their key with something new.

    The archive has everything ever filed, what is new is often one day. When its keys are few, by
    count, they go to where the archive is read, and the rest of the archive is not shuffled.
    """
    keys = new.select(*on).distinct()
    few = keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    return archive.join(F.broadcast(keys) if few else keys, list(on), "left_semi")


def first_with_content(
    candidates: DataFrame, filed: DataFrame | None = None
) -> DataFrame:
    """Find for every attachment the one that holds the same content first, under the same root.

    Adds ``first_of`` (a struct: ``was_filed, received, msg_id, pos, path``) and ``is_first``.
    Files already filed (``root, content_hash, path``) come before anything new. The hash alone
    decides: the size a mail program reports need not be the size on disk. An attachment whose
    hash is not known equals no other. Content sent over and over is first reduced to one candidate
    per part of the group, so no task sees the whole group.
    """
    content = ["root", "_content"]
    new = F.struct(
        F.lit(False).alias("was_filed"),
        F.col("received"),
        F.col("msg_id"),
        F.col("pos"),
        F.lit(None).cast("string").alias("path"),
    )
    unknown = F.concat_ws("/", F.lit("?"), "msg_id", "pos")
    rows = candidates.withColumn(
        "_content", F.coalesce("content_hash", unknown)
    ).withColumn("_salt", salt_of("msg_id", "pos"))
    parts = rows.groupBy(*content, "_salt").agg(_earliest(new).alias("_first"))
    if filed is not None:
        kinds = {f.name: f.dataType for f in candidates.schema}
        old = F.struct(
            F.lit(True).alias("was_filed"),
            F.lit(None).cast(kinds["received"]).alias("received"),
            F.lit(None).cast(kinds["msg_id"]).alias("msg_id"),
            F.lit(None).cast(kinds["pos"]).alias("pos"),
            F.col("path"),
        )
        known = filed.filter("content_hash IS NOT NULL")
        parts = parts.unionByName(
            narrowed(known, candidates, ["root", "content_hash"])
            .groupBy("root", F.col("content_hash").alias("_content"))
            .agg(F.min_by(old, "path").alias("_first"))
            .withColumn("_salt", F.lit(-1))
        )
    across = Window.partitionBy(*content)
    best = parts.withColumn("first_of", _earliest(F.col("_first")).over(across)).select(
        *content, "_salt", "first_of"
    )
    return (
        rows.join(best, [*content, "_salt"])
        .drop("_content", "_salt")
        .withColumn(
            "is_first",
            ~F.col("first_of.was_filed")
            & (F.col("first_of.msg_id") == F.col("msg_id"))
            & (F.col("first_of.pos") == F.col("pos")),
        )
    )


def _earliest(arrival: Column) -> Column:
    """Filed before new; new ones by time of arrival."""
    rank = F.struct(
        (~arrival["was_filed"]).alias("r"),
        arrival["received"].alias("t"),
        arrival["msg_id"].alias("m"),
        arrival["pos"].alias("p"),
    )
    return F.min_by(arrival, rank)


def filing_plan(
    messages: DataFrame,
    config: Config,
    only: str | None = None,
    filed: DataFrame | None = None,
    stage: Callable[[DataFrame, str], DataFrame] = materialize,
) -> DataFrame:
    """What to do with every attachment of every classified message.

    ``written`` attachments go to ``path``; the others say why not, and a duplicate names the file
    that already holds its content. ``filed`` lists files already stored, as
    ``root, folder, filename, content_hash, path``. What several steps read is written to the
    shared folder by ``stage``.
    """
    arrived = attachments_of(classified(messages, config, only), config)
    kept = arrived.filter("skipped_reason IS NULL")
    names_there = None
    if filed is not None:
        # read for its keys and to be judged
        kept = stage(kept, "kept")
        names_there = narrowed(filed.select("folder", "filename"), kept, ["folder"])
    judged = stage(first_with_content(kept, filed), "judged")
    stored = stage(
        number_names(judged.filter("is_first"), names_there, stage).withColumn(
            "path", F.concat_ws("/", "folder", "stored_name")
        ),
        "stored",
    )
    columns = ["source", "run_date", "msg_id", "pos", "subject", "filename"]
    no_text = F.lit(None).cast("string")
    as_sent = F.concat_ws("/", "folder", "filename").alias("path")
    written = stored.select(
        *columns,
        "path",
        F.lit(True).alias("written"),
        F.lit("").alias("skipped_reason"),
        no_text.alias("duplicate_of"),
    )
    firsts = stored.select(
        F.col("msg_id").alias("_m"), F.col("pos").alias("_p"), F.col("path").alias("_first_path")
    )
    duplicates = (
        judged.filter("NOT is_first")
        .withColumn("_m", F.col("first_of.msg_id"))
        .withColumn("_p", F.col("first_of.pos"))
        .withColumn("_salt", salt_of("msg_id", "pos"))
    )
    known = duplicates.filter("first_of.was_filed").select(
        *columns, as_sent, F.col("first_of.path").alias("duplicate_of")
    )
    among_new = look_up(
        duplicates.filter("NOT first_of.was_filed"), firsts, ["_m", "_p"]
    ).select(*columns, as_sent, F.col("_first_path").alias("duplicate_of"))
    resent = known.unionByName(among_new).select(
        *columns,
        "path",
        F.lit(False).alias("written"),
        F.lit("same content as an earlier file").alias("skipped_reason"),
        "duplicate_of",
    )
    dropped = arrived.filter("skipped_reason IS NOT NULL").select(
        *columns,
        as_sent,
        F.lit(False).alias("written"),
        "skipped_reason",
        no_text.alias("duplicate_of"),
    )
    return written.unionByName(resent).unionByName(dropped)


def fetch_summary(
    messages: DataFrame, plan: DataFrame, config: Config, only: str | None = None
) -> DataFrame:
    """One row: messages seen and matched, files written and skipped, and that as a sentence."""
    matched = F.col("_source").isNotNull()
    if only:
        matched = matched & (F.lower("_source") == only.lower())
    classes = classify(messages, config).select(F.col("source").alias("_source"))
    zero = F.lit(0).cast("long")
    seen = classes.agg(
        F.count("*").alias("messages_seen"),
        F.count_if(matched).alias("messages_matched"),
        zero.alias("files_written"),
        zero.alias("files_skipped"),
    )
    files = plan.agg(
        zero.alias("messages_seen"),
        zero.alias("messages_matched"),
        F.count_if(F.col("written")).alias("files_written"),
        F.count_if(~F.col("written")).alias("files_skipped"),
    )
    both = seen.unionByName(files)
    counted = both.agg(*[F.sum(c).alias(c) for c in both.columns])
    return counted.withColumn(
        "summary",
        F.format_string(
            "%d of %d messages matched; saved %d file(s), skipped %d.",
            "messages_matched",
            "messages_seen",
            "files_written",
            "files_skipped",
        ),
    )
