"""What is known about each sender: how to recognise, read and pair its records.

A :class:`Config` is a handful of plain values written by a person. It reaches the plans either as
literals inside Column expressions or as small tables that are broadcast; their size is the size
of the configuration and never grows with the data.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pairwright.functions.normalize import DATE_ORDERS, DAY_FIRST

#: The fields a record may have, in the order they are shown.
KNOWN_FIELDS = ("date", "description", "quantity", "amount", "reference", "account")
#: How a field is read where it is not plain text.
FIELD_KINDS = {"date": "date", "quantity": "count", "amount": "number"}
DOCUMENT = "document"
SPREADSHEET = "spreadsheet"
#: Suffixes of data files.
DEFAULT_DATA_EXTENSIONS = (".csv", ".xlsx", ".xlsm", ".ods", ".tsv")
DEFAULT_FOLDER_TEMPLATE = "{source}/{source} {date:%Y.%m.%d}"


class SpecError(ValueError):
    """A configuration that cannot be used; the message names what is wrong with it."""


@dataclass(frozen=True)
class Source:
    """One sender of statements."""

    name: str
    columns: Mapping[str, float]
    aliases: Mapping[str, Sequence[str]]
    match_on: str | None = None
    match_key: Sequence[str] = ()
    subject_all: Sequence[str] = ()
    attachment_contains: Sequence[str] = ()
    start_markers: Sequence[str] = ()
    stop_markers: Sequence[str] = ()
    skip_markers: Sequence[str] = ()
    labels: Mapping[str, str] = field(default_factory=dict)
    date_order: str = DAY_FIRST

    def __post_init__(self) -> None:
        unknown = [f for f in (*self.columns, *self.aliases) if f not in KNOWN_FIELDS]
        if unknown:
            raise SpecError(f"{self.name}: unknown field(s) {', '.join(unknown)}")
        if any(part in self.name for part in ("/", "\\", "..")) or not self.name.strip():
            raise SpecError(f"{self.name!r} cannot name a folder")
        if self.date_order not in DATE_ORDERS:
            raise SpecError(f"{self.name}: date_order must be one of {', '.join(DATE_ORDERS)}")
        if bool(self.match_on) == bool(self.match_key):
            raise SpecError(f"{self.name}: give either match_on or match_key")
        for name in self.match_fields:
            if name not in self.columns or name not in self.aliases:
                raise SpecError(f"{self.name}: '{name}' must be readable from both sides")
        if self.match_on and not self.compare_fields:
            raise SpecError(f"{self.name}: nothing to compare besides '{self.match_on}'")

    @property
    def match_fields(self) -> tuple[str, ...]:
        return (self.match_on,) if self.match_on else tuple(self.match_key)

    @property
    def compare_fields(self) -> tuple[str, ...]:
        return tuple(
            f
            for f in KNOWN_FIELDS
            if f in self.columns and f in self.aliases and f != self.match_on
        )

    @property
    def pair_on(self) -> str:
        return " + ".join(self.match_fields)


@dataclass(frozen=True)
class Config:
    """Every sender, and where their files are kept."""

    sources: Sequence[Source]
    root: str = "/statements"
    folder_template: str = DEFAULT_FOLDER_TEMPLATE
    min_attachment_bytes: int = 8192
    data_extensions: Sequence[str] = DEFAULT_DATA_EXTENSIONS

    def __post_init__(self) -> None:
        if not self.sources:
            raise SpecError("at least one source is required")
        names = [s.name.lower() for s in self.sources]
        if len(set(names)) != len(names):
            raise SpecError("source names must differ by more than case")
        extensions = tuple(
            e if e.startswith(".") else f".{e}" for e in (x.lower() for x in self.data_extensions)
        )
        object.__setattr__(self, "data_extensions", extensions or DEFAULT_DATA_EXTENSIONS)

    def only(self, name: str | None) -> list[Source]:
        """The sources to report on; the name is matched without regard to case."""
        return [s for s in self.sources if not name or s.name.lower() == name.lower()]

    # -- small tables ------------------------------------------------------------------------

    def source_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (
                s.name,
                pos,
                bool(s.match_on),
                s.pair_on,
                list(s.match_fields),
                list(s.compare_fields),
                s.date_order,
                s.labels.get(DOCUMENT),
                s.labels.get(SPREADSHEET),
            )
            for pos, s in enumerate(self.sources)
        ]
        return local_table(
            spark,
            rows,
            "source string, source_pos int, by_id boolean, pair_on string, "
            "match_fields array<string>, compare_fields array<string>, date_order string, "
            "label_document string, label_spreadsheet string",
        )

    def layout_table(self, spark: SparkSession) -> DataFrame:
        """Column starts, left to right, and markers of each source's statements.

        ``spans`` says of each field where its column starts and where the next one does; the last
        column has no end.
        """
        rows = [
            (
                s.name,
                [{"x0": float(x), "pos": pos, "field": f} for x, pos, f in _starts(s)],
                _spans(s),
                [m.lower() for m in s.start_markers],
                [m.lower() for m in s.stop_markers],
                [m.lower() for m in s.skip_markers],
            )
            for s in self.sources
        ]
        return local_table(
            spark,
            rows,
            "source string, starts array<struct<x0:double,pos:int,field:string>>, "
            f"spans struct<{','.join(f'{f}:struct<start:double,stop:double>' for f in KNOWN_FIELDS)}>, "
            "start_markers array<string>, stop_markers array<string>, skip_markers array<string>",
        )

    def alias_table(self, spark: SparkSession) -> DataFrame:
        """Accepted header spellings, the preferred one first."""
        rows = [
            (s.name, f, priority, alias, alias.strip().lower())
            for s in self.sources
            for f, names in s.aliases.items()
            for priority, alias in enumerate(names)
        ]
        return local_table(
            spark,
            rows,
            "source string, field string, priority int, alias string, header_key string",
        )

    # -- paths -------------------------------------------------------------------------------

    def run_path(self, source: Column | str, run_date: Column | str) -> Column:
        """Where one source's files of one day are kept."""
        source = F.col(source) if isinstance(source, str) else source
        run_date = F.col(run_date) if isinstance(run_date, str) else run_date
        rendered = _render(self.folder_template, source, run_date)
        return F.concat(F.lit(self.root.rstrip("/") + "/"), *rendered)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table kept inside the plan, so that reading it starts no job of its own."""
    struct = spark.createDataFrame([], schema).schema
    columns = list(zip(*rows, strict=True)) or [()] * len(struct)
    arrow = pa.Table.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, to_arrow_schema(struct), strict=True)],
        schema=to_arrow_schema(struct),
    )
    return spark.createDataFrame(arrow, schema=struct)


def _starts(source: Source) -> list[tuple[float, int, str]]:
    """Sorted by position on the page; of two equal starts the later one counts."""
    return sorted((x, pos, f) for pos, (f, x) in enumerate(source.columns.items()))


def _spans(source: Source) -> dict[str, dict[str, float | None] | None]:
    """Where the column of each known field starts and the next one does."""
    starts = _starts(source)
    stops = [float(x) for x, _, _ in starts[1:]] + [None]
    spans = {f: {"start": float(x), "stop": y} for (x, _, f), y in zip(starts, stops, strict=True)}
    return {f: spans.get(f) for f in KNOWN_FIELDS}


#: Date codes a folder template may use and their Spark spelling.
_DATE_CODES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%b": "MMM",
    "%B": "MMMM",
    "%a": "EEE",
    "%A": "EEEE",
    "%j": "DDD",
}


def _render(template: str, source: Column, run_date: Column) -> list[Column]:
    import string

    pieces: list[Column] = []
    for literal, name, spec, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name == "source":
            pieces.append(source)
        elif name == "date":
            pieces.extend(_render_date(spec or "%Y-%m-%d", run_date))
        elif name is not None:
            raise SpecError(f"folder_template: '{{{name}}}' is not available")
    return pieces


def _render_date(spec: str, run_date: Column) -> list[Column]:
    pieces: list[Column] = []
    i = 0
    while i < len(spec):
        code = spec[i : i + 2]
        if code == "%W":
            # weeks start on Monday; the days before the first Monday are in week 0
            week = F.floor((F.dayofyear(run_date) + 6 - F.weekday(run_date)) / 7)
            pieces.append(F.lpad(week.cast("string"), 2, "0"))
            i += 2
        elif code in _DATE_CODES:
            pieces.append(F.date_format(run_date, _DATE_CODES[code]))
            i += 2
        elif spec[i] == "%":
            raise SpecError(f"folder_template: date code {code!r} is not available")
        else:
            pieces.append(F.lit(spec[i]))
            i += 1
    return pieces


def as_date(value: dt.date | str) -> dt.date:
    """A date given as such or as ISO text."""
    return dt.date.fromisoformat(value) if isinstance(value, str) else value
