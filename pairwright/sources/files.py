"""File listings, stored words and the tables a check leaves behind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.naming import suffix
from pairwright.operators.pairing import (
    RUN,
    differences_worklist,
    matched_pairs,
    one_sided,
    order_one_sided,
)
from pairwright.operators.runs import run_summary
from pairwright.specs import Config

WORD_COLUMNS = ["source", "run_date", "doc_id", "page", "seq", "text", "x0", "top"]


def scan_words(spark: SparkSession, path: str) -> DataFrame:
    """Positioned words stored as Parquet."""
    return spark.read.parquet(path).select(*WORD_COLUMNS)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder with name, suffix and size; their content is not read."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("length").alias("size"))
    )
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return listed.withColumn("filename", name).withColumn("suffix", suffix(F.col("filename")))


def report_tables(
    results: DataFrame,
    pairs: DataFrame,
    unread: DataFrame,
    records: DataFrame,
    config: Config,
) -> dict[str, DataFrame]:
    """The tables of a report, by name.

    ``lines`` is the summary as measures: folder, pairing, counts, totals and verdict. One-sided records are in reading order by ``group_pos, first_seen, ordinal``, unread
    lines by ``doc_id, page, line``.
    """
    return {
        "summary": results,
        "lines": run_summary(results, records, config),
        "differences": differences_worklist(pairs),
        "unmatched": order_one_sided(one_sided(pairs, config), pairs),
        "unread": unread.select(*RUN, "doc_id", "page", "line", "unread_line"),
        "matched": matched_pairs(pairs),
    }


#: Under the root of a report: the lists of current runs, and the name of the one that counts.
MANIFEST, POINTER = "manifest", "CURRENT"


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """The runs of a report with the version their rows are in; NULL before the first commit."""
    pointer = f"{root}/{POINTER}"
    if not _file_system(spark, pointer).exists(_hadoop_path(spark, pointer)):
        return None
    version = spark.read.text(pointer).first().value
    return spark.read.parquet(f"{root}/{MANIFEST}/{version}")


def _point_to(spark: SparkSession, root: str, version: str) -> None:
    """Swap the pointer in one step: it names the old version or the new one, never neither."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    draft, pointer = _hadoop_path(spark, f"{root}/{POINTER}-{version}"), _hadoop_path(spark, f"{root}/{POINTER}")
    stream = draft.getFileSystem(conf).create(draft)
    stream.write(bytearray(version, "utf-8"))
    stream.close()
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(pointer.toUri(), conf).rename(draft, pointer, options)


def write_report(tables: dict[str, DataFrame], root: str, report_id: str) -> dict[str, str]:
    """Write every table of a report; returns where each one is.

    A rerun replaces the runs it covers and no others. Its rows go into a version of their own, and
    so does the list of all runs with the version each is in; then one pointer is swapped to that
    list. Whatever stops before, the report stays as it was, all of it. Rows of a run are brought
    together, small runs share a task and large ones are split.
    """
    root = root.rstrip("/")
    spark = tables["summary"].sparkSession
    version = f"{report_id}-{uuid.uuid4().hex}"
    paths = {name: f"{root}/{name}" for name in tables}
    for name, rows in tables.items():
        rows.hint("rebalance", *RUN).write.partitionBy(*RUN).parquet(f"{paths[name]}/version={version}")
    runs = tables["summary"].select(*RUN).distinct()
    current = runs.select(*RUN, F.lit(report_id).alias("report_id"), F.lit(version).alias("version"))
    before = _manifest(spark, root)
    if before is not None:
        current = current.unionByName(before.join(runs, RUN, "left_anti"))
    current.write.parquet(f"{root}/{MANIFEST}/{version}")
    _point_to(spark, root, version)
    return paths


def read_report(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of the current report of every run."""
    root = root.rstrip("/")
    current = _manifest(spark, root)
    if current is None:
        raise FileNotFoundError(f"no report has been completed under {root}")
    rows = spark.read.parquet(f"{root}/{name}")
    return rows.join(current, [*RUN, "version"], "left_semi").drop("version")


def drop_old_versions(spark: SparkSession, root: str) -> int:
    """Delete versions no run is in any more, also those of reports that were never completed.

    Not while a report is being written. Returns how many folders went.
    """
    root = root.rstrip("/")
    current = _manifest(spark, root)
    # one row a version that is still read, at most one a report
    used = {r.version for r in current.select("version").distinct().collect()}
    listed = spark.read.text(f"{root}/{POINTER}").first().value
    files, gone = _file_system(spark, root), 0
    for table in files.listStatus(_hadoop_path(spark, root)):
        if not table.isDirectory():
            continue
        for folder in files.listStatus(table.getPath()):
            name = folder.getPath().getName().removeprefix("version=")
            stays = name == listed if table.getPath().getName() == MANIFEST else name in used
            if folder.isDirectory() and not stays:
                files.delete(folder.getPath(), True)
                gone += 1
    return gone


def write_overview(overview: DataFrame, path: str) -> None:
    """Write the overview of a range, one row per run."""
    overview.write.mode("overwrite").parquet(path)
