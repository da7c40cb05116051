"""Pair the records of two sides one-for-one and say where a pair disagrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.normalize import KEY_SEPARATOR, canonical
from pairwright.operators import blocks
from pairwright.operators.blocks import (
    Stage,
    block_of,
    occurrence_number,
)
from pairwright.session import materialize
from pairwright.specs import DOCUMENT, FIELD_KINDS, KNOWN_FIELDS, SPREADSHEET, Config

RUN = ["source", "run_date"]
RECORD_COLUMNS = [*RUN, "side", "ordinal", "locator", *KNOWN_FIELDS]
_NORMALISED = [f"n_{f}" for f in KNOWN_FIELDS]
_SIDE_COLUMNS = ["ordinal", "locator", *KNOWN_FIELDS, *_NORMALISED]

_DIFFERENCES = "array<struct<field:string,document_value:string,spreadsheet_value:string>>"

#: Parts the keys of large runs are counted in.
KEY_PARTS = 1 << 14
#: Records of large runs that are sorted by one task.
TASK_RECORDS = 1 << 20

#: Made from the run and key of a record; equal keys have equal ones.
KEY_NUMBER = "_key_number"

MATCHED = "matched"
DIFFERING = "differing"
ONE_SIDED = "one_sided"


def as_records(df: DataFrame, side: str, **values: Column) -> DataFrame:
    """Shape any table into records; fields not given are absent (NULL)."""
    fields = [
        values.get(f, F.lit(None)).cast("string").alias(f)
        for f in KNOWN_FIELDS
    ]
    return df.select(
        F.col("source"),
        F.col("run_date"),
        F.lit(side).alias("side"),
        F.col("ordinal").cast("long").alias("ordinal"),
        F.col("locator"),
        *fields,
    )


def with_source_rules(df: DataFrame, config: Config, *columns: str) -> DataFrame:
    """Attach what is configured for a row's source; rows of unknown sources are left out."""
    rules = config.source_table(df.sparkSession).select("source", *columns)
    return df.join(F.broadcast(rules), "source")


def normalized_value(field: str) -> Column:
    """One field of a record in canonical form, read the way its own source writes dates."""
    raw = F.col(field)
    return F.when(raw.isNull() | (raw == ""), F.lit("")).otherwise(
        canonical(FIELD_KINDS.get(field, "text"), raw, F.col("date_order"))
    )


def composite_key(config: Config) -> Column:
    """The canonical values a record is recognised by, in configured order, as one string.

    Canonical values never contain the separator, so equal strings mean equal values.
    """
    key = None
    for fields in dict.fromkeys(s.match_fields for s in config.sources):
        value = F.concat_ws(KEY_SEPARATOR, *[F.col(f"n_{f}") for f in fields])
        here = F.col("pair_on") == " + ".join(fields)
        key = F.when(here, value) if key is None else key.when(here, value)
    return key.otherwise(F.lit(""))


def _unidentified(config: Config) -> Column:
    """True for a record paired by identifier whose identifier is blank.

    Looks at the value as it was read, so the test is cheap wherever a filter ends up.
    """
    blank = F.lit(False)
    for field in dict.fromkeys(s.match_on for s in config.sources if s.match_on):
        here = F.col("by_id") & (F.col("pair_on") == field)
        shown = F.rlike(F.coalesce(F.col(field), F.lit("")), F.lit(r"(?U)[^\s\x1c-\x1f]"))
        blank = F.when(here, ~shown).otherwise(blank)
    return blank


def _paired_value(field: str, config: Config) -> Column:
    """A field in canonical form where records are recognised by it or compared on it, else NULL."""
    used = {
        s.pair_on
        for s in config.sources
        if field in s.match_fields or (s.match_on and field in s.compare_fields)
    }
    if used == {s.pair_on for s in config.sources}:
        return normalized_value(field)
    return F.when(F.col("pair_on").isin(sorted(used)), normalized_value(field))


def normalize_records(records: DataFrame, config: Config, every: bool = True) -> DataFrame:
    """Records with their canonical values (``n_*``) and the key they are paired by.

    Where only pairs are asked for and no totals, ``every`` value need not be read: those a source's
    records are neither recognised by nor compared on are NULL then.
    """
    values = {f: normalized_value(f) if every else _paired_value(f, config) for f in KNOWN_FIELDS}
    return (
        with_source_rules(records, config, "by_id", "pair_on", "date_order")
        .withColumns({f"n_{f}": v for f, v in values.items()})
        .withColumn("pair_key", composite_key(config))
        .withColumn("unidentified", _unidentified(config))
        .drop("date_order", "pair_on")
    )


def key_counts(normalised: DataFrame) -> DataFrame:
    """How often each key of a run occurs on either side: runs of equal keys with their lengths.

    Records are added up before they are shuffled, so a key of any size is a few rows. Records that
    pair with nothing are left out.
    """
    on_side = {side: F.count_if(F.col("side") == side).alias(side) for side in (DOCUMENT, SPREADSHEET)}
    return (
        normalised.filter(~F.col("unidentified"))
        .groupBy(*RUN, "by_id", "pair_key")
        .agg(*on_side.values())
    )


def run_sizes(records: DataFrame) -> DataFrame:
    """How many records each side of a run has: nothing of them is read or normalised."""
    return records.groupBy(*RUN, "side").agg(F.count("*").alias("records"))


def large_runs(records: DataFrame) -> DataFrame:
    """Runs with more records on a side than a block has: only they can have a key of that size.

    There is at most one for every block of records.
    """
    large = run_sizes(records).filter(F.col("records") > F.lit(1 << blocks.BLOCK_BITS))
    return large.select(*RUN).distinct()


def quick_key(config: Config) -> Column:
    """The values of a record's key that are quickest to read: texts and counts, else all of them.

    Records of one key agree in it, so no key has more records than this has. Needs ``pair_on``.
    """
    value = F.lit("")
    for fields in dict.fromkeys(s.match_fields for s in config.sources):
        quick = [f for f in fields if FIELD_KINDS.get(f) not in ("date", "number")] or fields
        here = F.col("pair_on") == " + ".join(fields)
        shown = F.concat_ws(KEY_SEPARATOR, *[F.col(f"n_{f}") for f in quick])
        value = F.when(here, shown).otherwise(value)
    return value


def _part_of(key: Column | str) -> Column:
    """The part the keys of a run are counted in."""
    return F.pmod(F.xxhash64(*RUN, key), F.lit(KEY_PARTS)).cast("int")


def _large_parts(rows: DataFrame, part: Column) -> list[int]:
    """Parts with more records on a side than a block has, at most ``KEY_PARTS`` numbers."""
    on_side = [F.count_if(F.col("side") == side) for side in (DOCUMENT, SPREADSHEET)]
    counted = rows.groupBy(part.alias("part")).agg(F.greatest(*on_side).alias("records"))
    large = counted.filter(F.col("records") > F.lit(1 << blocks.BLOCK_BITS))
    return [r.part for r in large.select("part").collect()]


def _large_keys(pairable: DataFrame, config: Config | None) -> Column | None:
    """Tells the records whose key may have more than a block of records on a side, if there are any.

    What is quick to read of the keys is counted first, and whole keys only where that is too much.
    Counts are added up per part before they are shuffled.
    """
    if config is not None:
        hinted = with_source_rules(pairable, config, "pair_on").withColumn(
            "_part", _part_of(quick_key(config))
        )
        suspects = _large_parts(hinted, F.col("_part"))
        if not suspects:
            return None
        pairable = hinted.filter(F.col("_part").isin(suspects))
    large = _large_parts(pairable, _part_of("pair_key"))
    return _part_of("pair_key").isin(large) if large else None


def _number_in_place(pairable: DataFrame, tasks: int | None = None) -> DataFrame:
    """Numbers for keys of ordinary size, whose records meet by key and stay where they are.

    They are sorted by a number made from the key first, which is quicker to compare than texts.
    """
    own = Window.partitionBy(KEY_NUMBER, *RUN, "pair_key", "side").orderBy("ordinal", "locator")
    dealt = [tasks] if tasks else []
    return (
        pairable.repartition(*dealt, *RUN, "pair_key")
        .withColumn(KEY_NUMBER, F.xxhash64(*RUN, "pair_key"))
        .withColumn("n", F.row_number().over(own).cast("long"))
    )


def _number_by_blocks(pairable: DataFrame, stage: Stage) -> DataFrame:
    """Numbers for keys of any size: a key is numbered block by block."""
    cut = pairable.withColumn("_block", block_of("ordinal"))
    return occurrence_number(
        cut, [*RUN, "side", "pair_key"], ["ordinal", "locator"], ["_block"], stage=stage
    ).drop("_block")


def _numbered_parts(
    normalised: DataFrame, stage: Stage, config: Config | None = None
) -> list[DataFrame]:
    """Pairable records with their numbers: those of ordinary keys, and those of large ones if any."""
    pairable = normalised.filter(~F.col("unidentified"))
    sizes = run_sizes(normalised).agg(F.sum("records"), F.max("records")).first()
    records, largest = sizes[0] or 0, sizes[1] or 0
    if largest <= 1 << blocks.BLOCK_BITS:
        return [_number_in_place(pairable)]
    usual = int(normalised.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = -(-records // TASK_RECORDS)
    tasks = tasks if tasks > usual else None
    large = _large_keys(
        pairable.join(F.broadcast(large_runs(normalised)), RUN, "left_semi"), config
    )
    if large is None:
        return [_number_in_place(pairable, tasks)]
    return [
        _number_in_place(pairable.filter(~large), tasks),
        _number_by_blocks(pairable.filter(large), stage),
    ]


def number_occurrences(
    normalised: DataFrame, stage: Stage = materialize, config: Config | None = None
) -> DataFrame:
    """Number the records that share a key on a side, in file order.

    Records paired by identifier whose identifier is blank are left out: they pair with nothing.
    With the ``config`` they were normalised by, large runs are looked at more quickly.
    """
    parts = [p.drop(KEY_NUMBER) for p in _numbered_parts(normalised, stage, config)]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def pair_records(
    normalised: DataFrame,
    config: Config,
    stage: Stage = materialize,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """One row per pair or one-sided record of every run.

    The n-th record with a key on one side goes with the n-th on the other. Records are shuffled
    once, by run and key: there they are numbered and there the two halves meet. Only a key with more
    than a block of records on a side is too much for one task; such keys, which only large runs can
    have, are numbered by blocks (``stage`` keeps them) and their records meet by key and number, two
    at most. Columns: run, ``pair_key``, ``n``, ``by_id``, the two sides as structs (NULL where
    missing), ``differences`` and ``outcome``.

    ``carry`` names the fields the sides hold besides place and compared values, all if not given.
    What is not carried is not shuffled; without a compared field there are no ``differences``.
    """
    on = [*RUN, "pair_key", "n"]
    columns = _SIDE_COLUMNS
    if carry is not None:
        columns = ["ordinal", "locator", *carry, *[f"n_{f}" for f in _compared(config)]]

    def packed(side: str) -> Column:
        # at most one record of a side has this key and number
        here = F.when(F.col("side") == side, F.struct(*columns))
        return F.first(here, ignorenulls=True).alias(side)

    unidentified = normalised.filter("unidentified").select(
        *RUN,
        "pair_key",
        F.lit(None).cast("long").alias("n"),
        *[
            F.when(F.col("side") == side, F.struct(*columns)).alias(side)
            for side in (DOCUMENT, SPREADSHEET)
        ],
    )
    by_id = any(s.match_on for s in config.sources)
    joined = unidentified if by_id else None
    for numbered in _numbered_parts(normalised, stage, config):
        # in the order they were numbered in, where that was by key
        first = [c for c in numbered.columns if c == KEY_NUMBER]
        met = numbered.groupBy(*first, *on).agg(packed(DOCUMENT), packed(SPREADSHEET)).drop(*first)
        joined = met if joined is None else joined.unionByName(met)
    return classify_pairs(joined, config)


def _compared(config: Config) -> list[str]:
    """The fields on which pairs of some source are compared: only pairs by identifier are."""
    used = {f for s in config.sources if s.match_on for f in s.compare_fields}
    return [f for f in KNOWN_FIELDS if f in used]


def _disagrees(field: str) -> Column:
    return F.array_contains("compare_fields", field) & (
        F.col(f"{DOCUMENT}.n_{field}") != F.col(f"{SPREADSHEET}.n_{field}")
    )


def differences_column(fields: Sequence[str] = KNOWN_FIELDS) -> Column:
    """The compared fields on which a pair disagrees, with the values as they were read."""
    per_field = [
        F.when(
            _disagrees(f),
            F.struct(
                F.lit(f).alias("field"),
                display(f"{DOCUMENT}.{f}").alias("document_value"),
                display(f"{SPREADSHEET}.{f}").alias("spreadsheet_value"),
            ),
        )
        for f in fields
    ]
    return F.array_compact(F.array(*per_field))


def classify_pairs(joined: DataFrame, config: Config) -> DataFrame:
    """Say of each row whether it is a clean pair, a disagreeing pair or one-sided.

    The outcome does not look at the values as they were read, so where only it is asked for they
    are not needed.
    """
    both = F.col(DOCUMENT).isNotNull() & F.col(SPREADSHEET).isNotNull()
    compared = _compared(config)
    held = joined.schema[DOCUMENT].dataType.names
    differs = F.lit(False)
    for field in compared:
        differs = differs | _disagrees(field)
    if not compared:
        differences = F.lit(None).cast(_DIFFERENCES)
    else:
        differences = F.when(both & F.col("by_id"), differences_column(compared))
    judged = with_source_rules(joined, config, "by_id", "compare_fields")
    if set(compared) <= set(held):
        judged = judged.withColumn("differences", differences)
    return judged.withColumn(
        "outcome",
        F.when(~both, ONE_SIDED).when(F.col("by_id") & differs, DIFFERING).otherwise(MATCHED),
    ).drop("compare_fields")


def display(column: Column | str) -> Column:
    """A value as it was read; blank when there is none."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


# --------------------------------------------------------------------------------------------
# what the pairs say
# --------------------------------------------------------------------------------------------


def side_label(side: str) -> Column:
    """The name a side is shown under."""
    return F.coalesce(F.col(f"label_{side}"), F.lit(side))


def one_sided(pairs: DataFrame, config: Config) -> DataFrame:
    """Records that only one side has, with where they are and where they are missing."""
    rows = with_source_rules(
        pairs.filter(F.col("outcome") == ONE_SIDED), config, "label_document", "label_spreadsheet"
    )
    from_document = F.col(DOCUMENT).isNotNull()
    record = F.coalesce(DOCUMENT, SPREADSHEET)
    held = pairs.schema[DOCUMENT].dataType.names
    return rows.select(
        *RUN,
        "pair_key",
        "n",
        "by_id",
        F.when(from_document, DOCUMENT).otherwise(SPREADSHEET).alias("side"),
        F.when(from_document, side_label(DOCUMENT))
        .otherwise(side_label(SPREADSHEET))
        .alias("present_in"),
        F.when(from_document, side_label(SPREADSHEET))
        .otherwise(side_label(DOCUMENT))
        .alias("missing_from"),
        record["ordinal"].alias("ordinal"),
        record["locator"].alias("locator"),
        *[display(record[f]).alias(f) for f in KNOWN_FIELDS if f in held],
    )


def order_one_sided(unmatched: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add the columns that list one-sided records in reading order within a run.

    ``group_pos``: spreadsheet rows without an identifier, then document records, then the other
    spreadsheet rows; ``first_seen`` keeps the latter together by the row their key first occurred.
    Keys are added up before they are shuffled, and leftovers meet their key block by block.
    """
    left_over = (F.col("side") == SPREADSHEET) & F.col("n").isNotNull()
    marked = unmatched.withColumn(
        "group_pos",
        F.when((F.col("side") == SPREADSHEET) & F.col("n").isNull(), 0)
        .when(F.col("side") == DOCUMENT, 1)
        .otherwise(2),
    )
    # the blocks of leftovers a key may have: numbers have no gaps, so none is beyond the last one
    last = F.shiftright(F.max("n"), blocks.BLOCK_BITS)
    keyed = pairs.filter(F.col(SPREADSHEET).isNotNull() & F.col("n").isNotNull())
    first = (
        keyed.groupBy(*RUN, "pair_key")
        .agg(
            F.min(F.col(f"{SPREADSHEET}.ordinal")).alias("first_seen"),
            F.max(F.col("outcome") == ONE_SIDED).alias("_left_over"),
            last.alias("_last"),
        )
        .filter("_left_over")
        .select(*RUN, "pair_key", "first_seen", F.explode(F.sequence(F.lit(0), "_last")).alias("_block"))
    )
    wanted = marked.filter(left_over).withColumn("_block", block_of("n"))
    found = wanted.join(first, [*RUN, "pair_key", "_block"]).drop("_block")
    return found.unionByName(
        marked.filter(~left_over).withColumn("first_seen", F.lit(None).cast("long"))
    )


def matched_pairs(pairs: DataFrame) -> DataFrame:
    """Agreeing pairs: where each half is, and the document's values."""
    return pairs.filter(F.col("outcome") == MATCHED).select(
        *RUN,
        F.col(f"{DOCUMENT}.locator").alias("document_locator"),
        F.col(f"{SPREADSHEET}.locator").alias("spreadsheet_locator"),
        *[display(f"{DOCUMENT}.{f}").alias(f) for f in KNOWN_FIELDS],
    )


def differences_worklist(pairs: DataFrame) -> DataFrame:
    """One row per field on which an identified pair disagrees."""
    return pairs.filter(F.col("outcome") == DIFFERING).select(
        *RUN,
        F.col("pair_key").alias("identifier"),
        F.explode("differences").alias("d"),
        F.col(f"{DOCUMENT}.locator").alias("document_locator"),
        F.col(f"{SPREADSHEET}.locator").alias("spreadsheet_locator"),
    ).select(*RUN, "identifier", "d.*", "document_locator", "spreadsheet_locator")


def ambiguous_ids(pairs: DataFrame) -> DataFrame:
    """Identifiers that occur more than once on a side: exactly those with a second occurrence."""
    return pairs.filter(F.col("by_id") & (F.col("n") == 2)).select(
        *RUN, F.col("pair_key").alias("identifier")
    )


def repeats(counts: DataFrame) -> DataFrame:
    """Of :func:`key_counts` the keys that occur more than once on a side."""
    return counts.filter((F.col(DOCUMENT) >= 2) | (F.col(SPREADSHEET) >= 2))


def ambiguous_keys(counts: DataFrame) -> DataFrame:
    """Identifiers that occur more than once on a side, without any pairing."""
    return repeats(counts).filter("by_id").select(*RUN, F.col("pair_key").alias("identifier"))


def repeated_keys(normalised: DataFrame) -> DataFrame:
    """Composite keys that occur more than once on a side, with how often.

    When both sides repeat a key the spreadsheet's count is the one shown. Keys are only counted,
    so records are added up before they are shuffled and nothing is paired.
    """
    on_sheet = F.col(SPREADSHEET)
    counted = repeats(key_counts(normalised.filter(~F.col("by_id")))).withColumn(
        "occurrences", F.when(on_sheet >= 2, on_sheet).otherwise(F.col(DOCUMENT))
    )
    return counted.select(
        *RUN,
        "pair_key",
        "occurrences",
        F.concat(
            F.replace("pair_key", F.lit(KEY_SEPARATOR), F.lit(" | ")),
            F.lit(" (x"),
            F.col("occurrences").cast("string"),
            F.lit(")"),
        ).alias("shown"),
    )


def records_for_side(pairs: DataFrame, *sides: str) -> DataFrame:
    """All records of one side, or of both in one pass, whatever became of them."""
    wanted = sides or (DOCUMENT, SPREADSHEET)
    records = F.array(
        *[F.when(F.col(s).isNotNull(), F.struct(F.lit(s).alias("side"), f"{s}.*")) for s in wanted]
    )
    return pairs.select(*RUN, "outcome", F.explode(F.array_compact(records)).alias("r")).select(
        *RUN, "outcome", "r.*"
    )


def fields_in_play(pairs: DataFrame, config: Config) -> DataFrame:
    """Per run, the fields worth showing: those a shown record carries, key fields first."""
    shown = F.coalesce(DOCUMENT, F.when(F.col("outcome") == ONE_SIDED, F.col(SPREADSHEET)))
    flags = pairs.groupBy(*RUN).agg(
        *[F.max(F.when(shown[f].isNotNull(), F.lit(f))).alias(f) for f in KNOWN_FIELDS]
    )
    present = F.array_compact(F.array(*KNOWN_FIELDS))
    return with_source_rules(flags, config, "match_fields").select(
        *RUN,
        F.concat(
            F.array_intersect("match_fields", present), F.array_except(present, "match_fields")
        ).alias("fields"),
    )
