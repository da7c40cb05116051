"""The whole check, for every source and day of a range in one plan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators.calendar import expected_runs
from pairwright.operators.layout import document_records, read_lines, unread_lines
from pairwright.operators.pairing import (
    RECORD_COLUMNS,
    RUN,
    normalize_records,
    pair_records,
)
from pairwright.operators.runs import (
    file_count_errors,
    inventory,
    overview,
    run_results,
)
from pairwright.session import materialize
from pairwright.specs import DOCUMENT, Config, as_date


@dataclass(frozen=True)
class Inputs:
    """What has been received, for any number of runs.

    ``words`` are the documents' positioned words, ``sheet_records`` the exports' records,
    ``arrivals`` the files in each run folder (``source, run_date, filename``) and ``errors``
    whatever went wrong while reading (``source, run_date, error``).
    """

    words: DataFrame
    sheet_records: DataFrame
    arrivals: DataFrame
    errors: DataFrame | None = None


@dataclass(frozen=True)
class Outcome:
    """The tables a check produces."""

    pairs: DataFrame
    unread: DataFrame
    results: DataFrame
    overview: DataFrame
    records: DataFrame


#: Runs whose list is sent to all tasks: some 10 MB at most.
FEW_RUNS = 100_000
#: What of a statement line is read later on; its words are not.
LINE_COLUMNS = [*RECORD_COLUMNS, "doc_id", "page", "line", "text", "is_record"]


def compute_again(df: DataFrame, label: str) -> DataFrame:
    """A stage that writes nothing."""
    return df


def reconcile_range(
    inputs: Inputs,
    config: Config,
    calendar: DataFrame,
    only: str | None = None,
    stage: Callable[[DataFrame, str], DataFrame] = materialize,
) -> Outcome:
    """Reconcile every source on every day of ``calendar`` (``run_date``).

    Only runs holding exactly one document and one data file are read; a run that cannot be checked
    becomes a row saying why and hides none of the others. Words are narrowed to the sources and
    the calendar's span, which prunes what is read, and shuffled once, by page.

    The runs, and lines, records and pairs are each read by several later steps, so ``stage``
    writes them to the shared folder once; pass :func:`compute_again` to leave everything to one
    lazy plan instead. A list of runs that is short by count is sent to where the words are read, a
    longer one meets the lines. Records are shuffled once to be paired, and pairs, unread lines and
    the runs themselves once to be counted.
    """
    expected = expected_runs(calendar, config, only)
    errors = file_count_errors(inputs.arrivals, config).select(*RUN, "error")
    if inputs.errors is not None:
        errors = errors.unionByName(inputs.errors.select(*RUN, "error"))
    one_error = errors.groupBy(*RUN).agg(F.min("error").alias("error"))
    runs = stage(
        inventory(expected, inputs.arrivals, config).join(one_error, RUN, "left"), "runs"
    )
    checkable = runs.filter(F.col("complete") & F.col("error").isNull()).select(*RUN)
    many, first, last = runs.agg(F.count("*"), F.min("run_date"), F.max("run_date")).first()
    few = many <= FEW_RUNS
    in_span = F.col("source").isin([s.name for s in config.only(only)]) & F.col(
        "run_date"
    ).between(F.lit(first), F.lit(last))

    def to_check(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(checkable) if few else checkable, RUN, "left_semi")

    words = inputs.words.filter(in_span)
    lines = read_lines(to_check(words) if few else words, config)
    wanted = lines.withColumn("side", F.lit(DOCUMENT)).select(*LINE_COLUMNS)
    read = stage(wanted if few else to_check(wanted), "lines")
    sheets = to_check(inputs.sheet_records.filter(in_span))
    records = stage(
        normalize_records(document_records(read).unionByName(sheets), config), "records"
    )
    pairs = stage(pair_records(records, config, stage), "pairs")
    unread = unread_lines(read)
    results = run_results(checkable, pairs, config, unread)
    return Outcome(
        pairs=pairs,
        unread=unread,
        results=results,
        records=records,
        overview=overview(
            runs.drop("error"), runs.filter("error IS NOT NULL"), results, config
        ),
    )


def reconcile_run(
    inputs: Inputs, config: Config, source: str, run_date: dt.date | str, **options
) -> Outcome:
    """Reconcile one source on one day: the same plan, with its inputs pruned to that run."""
    day = F.lit(as_date(run_date))
    name = next((s.name for s in config.sources if s.name.lower() == source.lower()), None)
    if name is None:
        known = ", ".join(s.name for s in config.sources)
        raise ValueError(f"no source named {source!r}; configured: {known}")
    exact = (F.col("source") == name) & (F.col("run_date") == day)
    spark = inputs.words.sparkSession
    calendar = spark.range(1).select(day.alias("run_date"))
    pruned = Inputs(
        words=inputs.words.filter(exact),
        sheet_records=inputs.sheet_records.filter(exact),
        arrivals=inputs.arrivals.filter(exact),
        errors=None if inputs.errors is None else inputs.errors.filter(exact),
    )
    return reconcile_range(pruned, config, calendar, only=name, **options)
