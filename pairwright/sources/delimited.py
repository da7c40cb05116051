"""Read delimited exports: many files, each with its own headers, each of any size.

Files are read as splittable text. Whether a physical line starts inside a quoted value, and which
row of the file it belongs to, depends on everything before it; both are found split by split and
carried over split boundaries, so one huge file is shared by as many tasks as it has splits.
Every value stays text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.functions.naming import is_data, is_own_report, row_locator
from pairwright.functions.naming import suffix as suffix_of_name
from pairwright.operators.blocks import state_prefix
from pairwright.operators.pairing import RECORD_COLUMNS, RUN
from pairwright.session import materialize
from pairwright.specs import KNOWN_FIELDS, SPREADSHEET, Config

#: Cell texts that mean "no value" in a spreadsheet.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: Parts the rows of a file are dealt into when they meet its headers.
PARTS_PER_FILE = 64
SEPARATORS = {".csv": ",", ".tsv": "\t"}
FILE = "file_path"
_SPLIT = "split_start"
_DECODABLE = "is_utf8"

# The inside of a quoted value up to its closing quote; a doubled quote is part of the value.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'


def _in_class(sep: str) -> str:
    """A separator as it is written inside and outside a character class of a regex."""
    if len(sep) != 1 or sep in '"\r\n':
        raise ValueError(f"a separator is one character other than a quote or line end, not {sep!r}")
    return f"\\x{{{ord(sep):x}}}"


def _quote_patterns(sep: str) -> tuple[str, str]:
    """Does a line end inside a quoted value, if reached outside one / inside one?"""
    s = _in_class(sep)
    complete = rf'(?:(?:"{_QUOTED}"[^{s}]*+|[^"{s}][^{s}]*+)?+{s})*+'
    left_open = rf'{complete}"{_QUOTED}\z'
    return rf"^{left_open}", rf'^{_QUOTED}(?:\z|"[^{s}]*+{s}{left_open})'


def read_text_lines(
    spark: SparkSession, path: str | list[str], suffix: str = ".csv"
) -> DataFrame:
    """Physical lines with their file, the split they are in and their place in the split.

    The suffix of a file may be in any case. Partition columns of the folder layout (such as ``source`` and ``run_date``) are kept.
    """
    any_case = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    return (
        spark.read.option("pathGlobFilter", f"*{any_case}")
        .option("recursiveFileLookup", "false")
        .text(path)
        .select(
            "*",
            F.col("_metadata.file_path").alias(FILE),
            F.col("_metadata.file_block_start").alias(_SPLIT),
            # as read: later steps replace what cannot be decoded
            F.is_valid_utf8("value").alias(_DECODABLE),
            F.monotonically_increasing_id().alias("pos"),
        )
    )


def number_rows(lines: DataFrame, sep: str = ",") -> DataFrame:
    """Add ``row``, counting a file's rows from 1 (its header), and drop blank lines.

    All lines of a quoted value that runs over several lines get the same number;
    ``continues`` marks a line that starts inside a quoted value and ``open`` one that ends in one.
    """
    off_pattern, on_pattern = _quote_patterns(sep)
    tagged = (
        lines.withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
        .withColumn("_off", F.rlike("value", F.lit(off_pattern)).cast("int"))
        .withColumn("_on", F.rlike("value", F.lit(on_pattern)).cast("int"))
        .withColumn("_blank", F.rlike("value", F.lit(r'(?U)^\s*(?:"\s*")?\z')))
    )
    block = [FILE, _SPLIT]
    order = (
        Window.partitionBy(*block)
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # rows that begin in the split so far, were the split entered outside / inside a quoted value
    begins = {
        start: ((F.coalesce("_set", F.lit(start)) + F.col("_flips")) % 2 == 0) & ~F.col("_blank")
        for start in (0, 1)
    }
    local = state_prefix(tagged, block, ["pos"], F.col("_off"), F.col("_on")).withColumns(
        {f"_rows_{start}": F.sum(cond.cast("long")).over(order) for start, cond in begins.items()}
    )
    state = {
        start: (F.coalesce("_set", F.lit(start)) + F.col("_flips")) % 2 for start in (0, 1)
    }
    ends = F.struct(
        *[
            F.when(state[start] == 1, F.col("_on")).otherwise(F.col("_off")).alias(f"end_{start}")
            for start in (0, 1)
        ],
        F.col("_rows_0"),
        F.col("_rows_1"),
    )
    splits = local.groupBy(*block).agg(F.max_by(ends, "pos").alias("_last"))
    by_file = Window.partitionBy(FILE).orderBy(_SPLIT)
    entered = (
        state_prefix(splits, [FILE], [_SPLIT], F.col("_last.end_0"), F.col("_last.end_1"))
        .withColumn("_entered", (F.coalesce("_set", F.lit(0)) + F.col("_flips")) % 2)
        .withColumn(
            "_held",
            F.when(F.col("_entered") == 1, F.col("_last._rows_1")).otherwise(
                F.col("_last._rows_0")
            ),
        )
        .withColumn("_before", F.sum("_held").over(by_file) - F.col("_held"))
        .select(*block, "_entered", "_before")
    )
    inside = (F.coalesce("_set", "_entered") + F.col("_flips")) % 2 == 1
    return (
        local.join(entered, block)
        .withColumn("continues", inside)
        .withColumn("open", F.when(inside, F.col("_on")).otherwise(F.col("_off")) == 1)
        .withColumn(
            "row",
            F.col("_before")
            + F.when(F.col("_entered") == 1, F.col("_rows_1")).otherwise(F.col("_rows_0")),
        )
        .filter(F.col("continues") | ~F.col("_blank"))
        .drop("_off", "_on", "_blank", "_set", "_flips", "_rows_0", "_rows_1", "_entered",
              "_before")
    )


def split_cells(text: Column, sep: str) -> Column:
    """The cells of one row as an array of text, quotes removed."""
    s = _in_class(sep)
    cell = rf'{s}("{_QUOTED}"[^{s}]*+|[^"{s}][^{s}]*+|)'
    found = F.regexp_extract_all(F.concat(F.lit(sep), text), F.lit(cell), F.lit(1))

    def unquoted(c: Column) -> Column:
        inner = F.regexp_replace(c, rf'(?s)^"({_QUOTED})"', "$1")
        # only what stood between the quotes has doubled quotes to undo
        head = F.regexp_extract(c, rf'(?s)^"({_QUOTED})"', 1)
        tail = F.substring(inner, F.char_length(head) + 1, F.char_length(inner))
        return F.when(
            F.startswith(c, F.lit('"')),
            F.concat(F.replace(head, F.lit('""'), F.lit('"')), tail),
        ).otherwise(c)

    return F.transform(found, unquoted)


def assemble_rows(numbered: DataFrame, sep: str = ",") -> DataFrame:
    """One row per logical row with its ``cells``.

    Almost every row is one line and passes straight through; only the lines of rows that run over
    several lines are brought together, and of those only rows whose quoted value is known to close:
    a stray quote in a large file does not gather the rest of it. Such a file yields only what came
    before the quote.
    """
    keep = [c for c in numbered.columns if c not in ("value", "pos", "continues", "open", _DECODABLE)]
    group = [c for c in keep if c != _SPLIT]
    single = numbered.filter("NOT continues AND NOT open").select(*keep, "value")
    pieces = numbered.filter("continues OR open")
    closes = pieces.filter("continues AND NOT open").select(FILE, "row").distinct()
    closed = (
        pieces.join(closes, [FILE, "row"], "left_semi")
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct(_SPLIT, "pos", "value"))).alias("_p"))
        .select(
            *group,
            F.col("_p")[0][_SPLIT].alias(_SPLIT),
            F.array_join(F.col("_p")["value"], "\n").alias("value"),
        )
        .select(*keep, "value")
    )
    return single.unionByName(closed).select(*keep, split_cells(F.col("value"), sep).alias("cells"))


def scan_delimited(
    spark: SparkSession, path: str | list[str], suffix: str = ".csv", sep: str | None = None
) -> DataFrame:
    """All rows of all files under ``path``: file, row number (1 is the header) and cells.

    The separator follows from the suffix unless it is given.
    """
    sep = sep or SEPARATORS[suffix]
    return assemble_rows(number_rows(read_text_lines(spark, path, suffix), sep), sep)


# --------------------------------------------------------------------------------------------
# headers
# --------------------------------------------------------------------------------------------


def header_cells(rows: DataFrame) -> DataFrame:
    """The headers of every file, one row each, with what they are looked up by.

    Of two equal headers the first counts; of headers equal but for case and padding, the last.
    """
    keys = [c for c in rows.columns if c not in (_SPLIT, "row", "cells")]
    cells = rows.filter("row = 1").select(*keys, F.posexplode("cells").alias("idx", "header"))
    named = cells.withColumn(
        "header",
        F.when(F.col("header") == "", F.concat(F.lit("Unnamed: "), F.col("idx").cast("string")))
        .otherwise(F.col("header")),
    )
    first = named.groupBy(*keys, "header").agg(F.min("idx").alias("idx"))
    return first.withColumn(
        "header_key",
        F.lower(F.regexp_replace("header", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")),
    )


def resolve_headers(headers: DataFrame, config: Config) -> DataFrame:
    """Per file and configured field the position of its column; NULL when no alias is there.

    The first configured alias that the file has wins.
    """
    keys = [c for c in headers.columns if c not in ("idx", "header", "header_key")]
    aliases = config.alias_table(headers.sparkSession)
    last = headers.groupBy(*keys, "header_key").agg(F.max_by("idx", "idx").alias("idx"))
    hits = (
        last.join(F.broadcast(aliases), ["source", "header_key"])
        .groupBy(*keys, "field")
        .agg(F.min_by("idx", "priority").alias("idx"))
    )
    wanted = headers.select(*keys).distinct().join(
        F.broadcast(aliases.select("source", "field").distinct()), "source"
    )
    return wanted.join(hits, [*keys, "field"], "left").select(*keys, "field", "idx")


def resolve_errors(resolved: DataFrame, headers: DataFrame, config: Config) -> DataFrame:
    """Fields for which a file has no column: what was tried and what the file has."""
    keys = [c for c in headers.columns if c not in ("idx", "header", "header_key")]
    tried = (
        config.alias_table(headers.sparkSession)
        .groupBy("source", "field")
        .agg(F.sort_array(F.collect_list(F.struct("priority", "alias"))).alias("_a"))
        .select("source", "field", F.array_join(F.col("_a")["alias"], ", ").alias("tried"))
    )
    # a header row is one row of a file, so its names are few
    actual = headers.groupBy(*keys).agg(
        F.array_join(
            F.sort_array(F.collect_list(F.struct("idx", "header")))["header"], ", "
        ).alias("actual")
    )
    return (
        resolved.filter("idx IS NULL")
        .join(F.broadcast(tried), ["source", "field"])
        .join(actual, keys)
        .select(
            *keys,
            "field",
            F.concat(
                F.lit("no header for "),
                F.col("field"),
                F.lit(" ("),
                F.col("tried"),
                F.lit(") in: "),
                F.col("actual"),
            ).alias("error"),
        )
    )


# --------------------------------------------------------------------------------------------
# records
# --------------------------------------------------------------------------------------------


def blank_if_na(cell: Column) -> Column:
    """A missing cell, or one holding a text that means "no value", is blank."""
    return F.when(cell.isNull() | cell.isin(*NA_TOKENS), F.lit("")).otherwise(cell)


def rows_to_records(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Records of every file whose headers were all found; all-blank rows are dropped.

    A file's column positions, one row each, are repeated for every part its rows are dealt into, so
    the rows of one huge file never meet them in a single task.
    """
    positions = (
        resolved.groupBy(*RUN, FILE)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("field", "idx"))).alias("_idx"),
            F.count_if(F.col("idx").isNull()).alias("_missing"),
        )
        .filter("_missing = 0")
        .select(FILE, "_idx")
    )
    parts = F.sequence(F.lit(0), F.lit(PARTS_PER_FILE - 1))
    data = rows.filter("row > 1").withColumn(
        "_part", F.pmod(F.col("row"), F.lit(PARTS_PER_FILE)).cast("int")
    )
    placed = data.join(positions.withColumn("_part", F.explode(parts)), [FILE, "_part"])

    def value(field: str) -> Column:
        idx = F.col("_idx")[field]
        cell = F.when(idx < F.size("cells"), F.get("cells", idx))
        return F.when(F.map_contains_key("_idx", field), blank_if_na(cell))

    records = placed.withColumns({f: value(f) for f in KNOWN_FIELDS})
    written = F.concat_ws("", *[F.col(f) for f in KNOWN_FIELDS])
    return (
        records.filter(F.rlike(written, F.lit(r"(?U)[^\s\x1c-\x1f]")))
        .withColumn("side", F.lit(SPREADSHEET))
        .withColumn("ordinal", F.col("row"))
        .withColumn("locator", row_locator(F.col("row")))
        .select(*RECORD_COLUMNS)
    )


def too_wide_errors(rows: DataFrame) -> DataFrame:
    """Files with a row that has more cells than the header, which cannot be read reliably."""
    widths = rows.groupBy(*RUN, FILE).agg(
        F.max(F.when(F.col("row") == 1, F.size("cells"))).alias("_header"),
        F.max(F.size("cells")).alias("_widest"),
    )
    return widths.filter("_widest > _header").select(
        *RUN,
        FILE,
        F.concat(
            F.lit("Expected "),
            F.col("_header").cast("string"),
            F.lit(" fields, saw "),
            F.col("_widest").cast("string"),
        ).alias("error"),
    )


def unterminated_errors(numbered: DataFrame) -> DataFrame:
    """Files that end inside a quoted value."""
    last = numbered.groupBy(*RUN, FILE).agg(
        F.max_by("open", F.struct(_SPLIT, "pos")).alias("_open")
    )
    return last.filter("_open").select(
        *RUN, FILE, F.lit("unexpected end of data inside a quoted value").alias("error")
    )


def undecodable_errors(numbered: DataFrame) -> DataFrame:
    """Files with bytes that are not UTF-8 text: their values would not be what was written."""
    files = numbered.filter(~F.col(_DECODABLE)).select(*RUN, FILE).distinct()
    return files.withColumn("error", F.lit("the file is not UTF-8 text"))


def data_files(
    spark: SparkSession, path: str | list[str], config: Config, suffix_only: str | None = None
) -> DataFrame:
    """Files that should give records, with their run; their content is not read.

    All files of a data kind, or those of one suffix; a report of an earlier check is none.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_name").alias("name"))
        .withColumn("suffix", suffix_of_name(F.col("name")))
    )
    folder = r"/source=([^/]+)/run_date=([^/]+)/"
    wanted = (
        F.col("suffix") == suffix_only.lower()
        if suffix_only
        else F.col("suffix").isin(list(config.data_extensions))
    )
    return found.filter(wanted & ~is_own_report(F.col("name"))).select(
        F.url_decode(F.nullif(F.regexp_extract(FILE, folder, 1), F.lit(""))).alias("source"),
        F.regexp_extract(FILE, folder, 2).try_cast("date").alias("run_date"),
        FILE,
        "name",
        "suffix",
    )


def _empty_files(arrivals: DataFrame, files: DataFrame, config: Config) -> DataFrame:
    """Data files that have arrived but are not among those Spark sees."""
    name = F.col("filename")
    return (
        arrivals.filter(is_data(name, config.data_extensions) & ~is_own_report(name))
        .select(*RUN, name.alias("name"))
        .distinct()
        .join(files, [*RUN, "name"], "left_anti")
        .select(
            *RUN,
            F.concat_ws("/", config.run_path("source", "run_date"), "name").alias(FILE),
            "name",
            suffix_of_name(F.col("name")).alias("suffix"),
        )
    )


def unread_errors(files: DataFrame, headers: DataFrame, config: Config, readable) -> DataFrame:
    """Files that gave no header, and why: each of them is named, none just disappears."""
    names = [s.name for s in config.sources]
    missing = files.join(headers.select(FILE).distinct(), FILE, "left_anti")
    strange = files.filter(~F.col("source").isin(names) | F.col("source").isNull())
    why = (
        F.when(~F.col("suffix").isin(list(readable)), F.lit(": this format is not read here"))
        .when(F.col("source").isNull() | ~F.col("source").isin(names), F.lit(": unknown source"))
        .otherwise(F.lit(": no header row"))
    )
    return (
        missing.unionByName(strange)
        .distinct()
        .select(*RUN, FILE, F.concat("name", why).alias("error"))
    )


def read_exports(
    spark: SparkSession,
    path: str | list[str],
    config: Config,
    suffix: str | None = None,
    sep: str | None = None,
    stage: Callable[[DataFrame, str], DataFrame] = materialize,
    arrivals: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Records of all exports under ``path``, and what kept others from being read.

    The folders must carry ``source=.../run_date=...``. Files of all known suffixes are read, each
    kind with its own separator, or those of one suffix with the one given. The numbered lines are
    written to the shared folder once, as records and errors are all derived from them. A file with
    an error gives no records, and every data file gives a header or an error. Spark does not list
    files of no bytes at all: ``arrivals`` (``source, run_date, filename``) names those as well.
    """
    separators = SEPARATORS if suffix is None else {suffix.lower(): sep or SEPARATORS[suffix.lower()]}
    files = stage(data_files(spark, path, config, suffix), "files")
    if arrivals is not None:
        files = files.unionByName(_empty_files(arrivals, files, config))
    columns = [*RUN, FILE, "error"]
    rows = unreadable = None
    for kind, separator in separators.items():
        if files.filter(F.col("suffix") == kind).isEmpty():
            continue
        numbered = stage(number_rows(read_text_lines(spark, path, kind), separator), "exports")
        of_kind = assemble_rows(numbered, separator).select(*RUN, FILE, _SPLIT, "row", "cells")
        wrong = too_wide_errors(of_kind).unionByName(unterminated_errors(numbered))
        wrong = wrong.select(*columns).unionByName(undecodable_errors(numbered).select(*columns))
        rows = of_kind if rows is None else rows.unionByName(of_kind)
        unreadable = wrong if unreadable is None else unreadable.unionByName(wrong)
    if rows is None:
        nothing = files.select(*RUN, FILE, F.lit(0).cast("bigint").alias(_SPLIT),
                               F.lit(0).cast("bigint").alias("row"),
                               F.array().cast("array<string>").alias("cells")).limit(0)
        rows, unreadable = nothing, nothing.select(*RUN, FILE, F.lit("").alias("error"))
    headers = stage(header_cells(rows), "headers")
    resolved = resolve_headers(headers, config)
    errors = (
        resolve_errors(resolved, headers, config)
        .select(*columns)
        .unionByName(unreadable.select(*columns))
        .unionByName(unread_errors(files, headers, config, separators).select(*columns))
    )
    usable = resolved.join(unreadable.select(FILE), FILE, "left_anti")
    return rows_to_records(rows, usable), errors


def run_of_path(path: Column) -> tuple[Column, Column]:
    """Source and date from a path laid out as source/source yyyy.MM.dd/file."""
    pattern = r"/([^/]+)/\1 ([0-9]{4})\.([0-9]{2})\.([0-9]{2})/[^/]+$"
    source = F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    day = F.concat_ws("-", *[F.regexp_extract(path, pattern, g) for g in (2, 3, 4)])
    return source, day.try_cast("date")
