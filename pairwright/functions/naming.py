"""File names, suffixes and the places they stand for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCUMENT_KIND = "document"
DATA_KIND = "data"
OTHER_KIND = "other"
#: Fixed value: the report an earlier check may have left in a run folder.
REPORT_NAME = "reconciliation_report.xlsx"


def suffix(name: Column) -> Column:
    """The last '.ext' of a file name in small letters; blank for none.

    A name that only starts with a dot, or ends with one, has no suffix.
    """
    return F.lower(F.regexp_extract(name, r"(?s)[^/](\.[^./]+)$", 1))


def stem(name: Column) -> Column:
    """A file name without its suffix."""
    return F.substring(name, F.lit(1), F.char_length(name) - F.char_length(suffix(name)))


def is_document(name: Column) -> Column:
    return suffix(name) == ".pdf"


def is_data(name: Column, extensions: Sequence[str]) -> Column:
    return suffix(name).isin(list(extensions))


def file_kind(name: Column, extensions: Sequence[str]) -> Column:
    """'document', 'data' or 'other'."""
    return (
        F.when(is_document(name), DOCUMENT_KIND)
        .when(is_data(name, extensions), DATA_KIND)
        .otherwise(OTHER_KIND)
    )


def is_own_report(name: Column) -> Column:
    return name == REPORT_NAME


def safe_filename(name: Column, fallback: str = "attachment") -> Column:
    """A name any file system takes: forbidden characters replaced, dots and spaces trimmed."""
    text = F.coalesce(name, F.lit(""))
    text = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    # fixed values: characters that file systems do not take
    text = F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_")
    text = F.regexp_replace(text, r"^[. ]+|[. ]+$", "")
    return F.when(text == "", F.lit(fallback)).otherwise(text)


def numbered_name(name: Column, counter: Column) -> Column:
    """The name itself for the first, 'stem (n).ext' for the n-th."""
    return F.when(counter <= 1, name).otherwise(
        F.concat(stem(name), F.lit(" ("), counter.cast("string"), F.lit(")"), suffix_as_is(name))
    )


def suffix_as_is(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)[^/](\.[^./]+)$", 1)


def document_locator(page: Column, line: Column) -> Column:
    return F.concat(F.lit("page "), page.cast("string"), F.lit(", line "), line.cast("string"))


def row_locator(row: Column) -> Column:
    return F.concat(F.lit("row "), row.cast("string"))
