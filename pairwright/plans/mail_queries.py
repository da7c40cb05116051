"""Queries over incoming messages and their attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators import arrivals as ar
from pairwright.operators.file_names import number_names
from pairwright.plans.derived_inputs import MAIL, document_messages, table
from pairwright.plans.registry import query

_MAIL = """
    WITH msg AS (
        SELECT doc_id AS msg_id, 'Daily STATEMENT ' || lang || ' from ' || source AS subject,
            TIMESTAMP '2026-01-01 08:00:00' + to_hours(CAST(doc_id % 720 AS INT)) AS received,
            CASE WHEN lang = 'de' THEN 'scan.pdf' ELSE lang || '_report: ' || source || '.pdf' END
                AS report, lang, source AS origin, n_chars, text
        FROM documents),
    rules AS (
        SELECT *, lang = 'en' AS north,
            lang = 'fr' OR contains(report, 'es_report: src1') OR contains(report, 'src7') AS south,
            contains(report, '_report') AS rest
        FROM msg),
    sorted AS (
        SELECT *, CASE WHEN north THEN 'NORTH' WHEN south THEN 'SOUTH' WHEN rest THEN 'REST' END
            AS source, CAST(received AS DATE) AS run_date FROM rules),
    attached AS (
        SELECT source, run_date, msg_id, subject, received, a.pos AS pos, a.name AS filename,
            a.size AS size, a.content AS content
        FROM (SELECT *, unnest([
            {'pos': 0, 'name': replace(report, ':', '_'), 'size': n_chars * 16, 'content': text},
            {'pos': 1, 'name': 'data.csv', 'size': 50, 'content': lang || origin},
            {'pos': 2, 'name': 'logo.png', 'size': 300, 'content': 'logo'}]) AS a FROM sorted)
        WHERE source IS NOT NULL),
    judged AS (
        SELECT *, '/statements/' || source AS root,
            '/statements/' || source || '/' || source || ' ' || strftime(run_date, '%Y.%m.%d')
                AS folder,
            CASE WHEN filename LIKE '%.csv' OR size >= 8192 THEN NULL
                 ELSE 'under the least size (' || size || ' bytes)' END AS reason
        FROM attached),
    firsts AS (
        SELECT *, row_number() OVER (PARTITION BY root, size, content
                                     ORDER BY received, msg_id, pos) AS copy,
            first_value(msg_id) OVER (PARTITION BY root, size, content
                                      ORDER BY received, msg_id, pos) AS first_msg,
            first_value(pos) OVER (PARTITION BY root, size, content
                                   ORDER BY received, msg_id, pos) AS first_pos
        FROM judged WHERE reason IS NULL),
    stored AS (
        SELECT *, row_number() OVER (PARTITION BY folder, filename
                                     ORDER BY received, msg_id, pos) AS counter
        FROM firsts WHERE copy = 1),
    named AS (
        SELECT *, CASE WHEN counter = 1 THEN filename
            ELSE regexp_replace(filename, '\\.([a-z]+)$', '') || ' (' || counter || ')'
                 || regexp_extract(filename, '\\.[a-z]+$') END AS stored_name
        FROM stored),
    plan AS (
        SELECT source, run_date, msg_id, pos, subject, filename,
            folder || '/' || stored_name AS path, true AS written, '' AS skipped_reason,
            NULL AS duplicate_of FROM named
        UNION ALL
        SELECT f.source, f.run_date, f.msg_id, f.pos, f.subject, f.filename,
            f.folder || '/' || f.filename, false, 'same content as an earlier file',
            n.folder || '/' || n.stored_name
        FROM firsts f JOIN named n ON n.msg_id = f.first_msg AND n.pos = f.first_pos
        WHERE f.copy > 1
        UNION ALL
        SELECT source, run_date, msg_id, pos, subject, filename, folder || '/' || filename, false,
            reason, NULL FROM judged WHERE reason IS NOT NULL)
"""


@query(
    "filter_received_range",
    """SELECT event_id AS msg_id, event_type AS subject FROM events
    WHERE ts >= '2024-01-06' AND ts < '2024-01-20'""",
)
def filter_received_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"),
        F.col("event_type").alias("subject"),
        F.col("ts").alias("received"),
    )
    return ar.received_in_range(messages, "2024-01-06", "2024-01-19").drop("received")


@query(
    "received_date",
    """SELECT event_id AS msg_id, CAST(ts AS DATE) AS received_date,
        CAST(ts AS DATE) AS received_date_of_text FROM events""",
)
def received_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"),
        ar.received_date(F.col("ts")).alias("received_date"),
        ar.received_date(F.col("ts").cast("string"), is_text=True).alias("received_date_of_text"),
    )


@query("rule_match", f"{_MAIL} SELECT msg_id, north, south, rest FROM rules")
def rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_messages(spark, sf_dir).select(
        "msg_id",
        *[
            ar.rule_matches(s, F.col("subject"), ar.attachment_names()).alias(s.name.lower())
            for s in MAIL.sources
        ],
    )


@query("classify_messages", f"{_MAIL} SELECT msg_id, source FROM sorted")
def classify_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ar.classify(document_messages(spark, sf_dir), MAIL).select("msg_id", "source")


@query(
    "filter_only_source",
    f"{_MAIL} SELECT msg_id, subject, source FROM sorted WHERE source = 'SOUTH'",
)
def filter_only_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ar.classified(document_messages(spark, sf_dir), MAIL, only="south").select(
        "msg_id", "subject", "source"
    )


@query(
    "keep_attachment",
    f"""{_MAIL} SELECT source, msg_id, pos, filename, size, reason IS NULL AS keep,
        reason AS skipped_reason FROM judged""",
)
def keep_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = ar.classified(document_messages(spark, sf_dir), MAIL)
    return ar.attachments_of(messages, MAIL).select(
        "source",
        "msg_id",
        "pos",
        "filename",
        "size",
        F.col("skipped_reason").isNull().alias("keep"),
        "skipped_reason",
    )


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = ar.classified(document_messages(spark, sf_dir), MAIL)
    return ar.attachments_of(messages, MAIL).filter("skipped_reason IS NULL")


@query(
    "first_content_wins",
    f"{_MAIL} SELECT source, msg_id, pos, copy = 1 AS is_first, first_msg, first_pos FROM firsts",
)
def first_content_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ar.first_with_content(_kept(spark, sf_dir)).select(
        "source",
        "msg_id",
        "pos",
        "is_first",
        F.col("first_of.msg_id").alias("first_msg"),
        F.col("first_of.pos").alias("first_pos"),
    )


@query(
    "dedupe_against_filed",
    f"""{_MAIL}
    , filed AS (SELECT root, size, content, min(folder || '/' || filename || '.' || msg_id) AS path
        FROM judged WHERE reason IS NULL AND day(run_date) <= 10 GROUP BY ALL)
    SELECT f.source, f.msg_id, f.pos, f.copy = 1 AND p.path IS NULL AS is_first,
        p.path AS filed_path
    FROM firsts f LEFT JOIN filed p USING (root, size, content)""",
)
def dedupe_against_filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attachments against those of the first ten days, taken as already filed."""
    kept = _kept(spark, sf_dir)
    filed = kept.filter(F.day("run_date") <= 10).select(
        "root",
        "size",
        "content_hash",
        F.concat("folder", F.lit("/"), "filename", F.lit("."), F.col("msg_id")).alias("path"),
    )
    return ar.first_with_content(kept, filed).select(
        "source", "msg_id", "pos", "is_first", F.col("first_of.path").alias("filed_path")
    )


@query(
    "unique_file_name",
    f"{_MAIL} SELECT source, run_date, msg_id, pos, folder, filename, stored_name FROM named",
)
def unique_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = ar.first_with_content(_kept(spark, sf_dir)).filter("is_first")
    return number_names(stored).select(
        "source", "run_date", "msg_id", "pos", "folder", "filename", "stored_name"
    )


@query("filing_plan", f"{_MAIL} SELECT * FROM plan")
def filing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ar.filing_plan(document_messages(spark, sf_dir), MAIL)


@query(
    "fetch_summary",
    f"""{_MAIL}
    , c AS (SELECT (SELECT count(*) FROM msg) AS messages_seen,
        (SELECT count(source) FROM sorted) AS messages_matched,
        (SELECT count(*) FROM plan WHERE written) AS files_written,
        (SELECT count(*) FROM plan WHERE NOT written) AS files_skipped)
    SELECT *, messages_matched || ' of ' || messages_seen || ' messages matched; saved '
        || files_written || ' file(s), skipped ' || files_skipped || '.' AS summary FROM c""",
)
def fetch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = document_messages(spark, sf_dir)
    return ar.fetch_summary(messages, ar.filing_plan(messages, MAIL), MAIL)
