"""Rebuild statement records from words and their positions on the page.

Words are shuffled once, by document and block of pages. A page is bounded by its physical height,
so a block of pages is bounded too: its lines are grouped, numbered and scanned inside one task, and
a document of any length is as many blocks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.naming import document_locator
from pairwright.functions.normalize import mask_shape
from pairwright.operators.blocks import running_state
from pairwright.operators.pairing import RECORD_COLUMNS, RUN
from pairwright.specs import DOCUMENT, KNOWN_FIELDS, Config

PAGE = [*RUN, "doc_id", "page"]
_BLOCK = [*RUN, "doc_id", "page_block"]
#: Pages that share a block, as a power of two.
PAGE_BLOCK_BITS = 10
#: Room for the lines of a page in a record's ordinal: pages are at most 14,400 points high.
LINE_BITS = 14
#: How far left of its column a word may start, in points.
COLUMN_TOLERANCE = 2.0


def group_lines(words: DataFrame) -> DataFrame:
    """Visual lines: words whose vertical position rounds to the same point, left to right.

    A word must say which page of which document it is on. Stating that here keeps the branches of
    later plans alike, so that they share one shuffle of the words.
    """
    by_block = words.withColumn("page_block", F.shiftright("page", PAGE_BLOCK_BITS))
    for column in (*_BLOCK, "page"):
        by_block = by_block.filter(F.col(column).isNotNull())
    by_block = by_block.repartition(*_BLOCK)
    # what tells most words of a task apart comes first: words are sorted by it
    return (
        by_block.groupBy("page", F.rint("top").alias("line_top"), *_BLOCK)
        .agg(F.sort_array(F.collect_list(F.struct("x0", "top", "seq", "text"))).alias("words"))
        .withColumn("text", line_text(F.col("words")))
    )


def line_text(words: Column) -> Column:
    return F.array_join(words["text"], " ")


def number_lines(lines: DataFrame) -> DataFrame:
    """Line numbers within a page, counting every line on it."""
    return lines.withColumn(
        "line", F.row_number().over(Window.partitionBy(*_BLOCK, "page").orderBy("line_top"))
    )


def contains_any(text: Column, markers: Column | str) -> Column:
    """True when the text holds any of the (small-letter) markers, in whatever case."""
    lowered = F.lower(text)
    return F.exists(markers, lambda m: F.contains(lowered, m))


def mark_sections(lines: DataFrame, config: Config) -> DataFrame:
    """Add ``in_section`` (the state a line is reached in) and ``keep`` (it is a record line).

    Every line consumed as a marker, skipped or outside the section has ``keep`` false.
    """
    layout = config.layout_table(lines.sparkSession).drop("starts", "spans")
    marked = (
        lines.join(F.broadcast(layout), "source")
        .withColumn("is_start", contains_any(F.col("text"), "start_markers"))
        .withColumn("is_stop", contains_any(F.col("text"), "stop_markers"))
        .withColumn("is_skip", contains_any(F.col("text"), "skip_markers"))
        .withColumn("opens_at_once", (F.size("start_markers") == 0).cast("int"))
        .drop("start_markers", "stop_markers", "skip_markers")
    )
    blank = F.trim("text") == ""
    from_off = (F.col("is_start") & ~blank).cast("int")
    from_on = (~F.col("is_stop") | blank).cast("int")
    stated = running_state(
        marked,
        [*RUN, "doc_id"],
        ["page", "line_top"],
        from_off,
        from_on,
        F.col("opens_at_once"),
        ["page_block"],
        "state_in",
    )
    return (
        stated.withColumn("in_section", F.col("state_in") == 1)
        .withColumn(
            "keep",
            F.col("in_section")
            & ~F.col("is_stop")
            & ~F.col("is_skip")
            & ~F.col("is_start")
            & ~blank,
        )
        .drop("state_in", "page_block", "opens_at_once")
    )


def column_of(x0: Column, starts: str = "starts") -> Column:
    """The field of the rightmost column that starts at or before a word; NULL left of all."""
    return F.try_element_at(
        F.filter(starts, lambda s: s["x0"] - COLUMN_TOLERANCE <= x0), F.lit(-1)
    )["field"]


def assign_columns(lines: DataFrame) -> DataFrame:
    """Add one text column per known field; NULL where the source does not have the field.

    Needs ``words``, left to right, and the source's ``spans``. A word belongs to a field when it
    starts in its span, which is what :func:`column_of` says of it.
    """

    def value(field: str) -> Column:
        start, stop = F.col("spans")[field]["start"], F.col("spans")[field]["stop"]
        mine = F.filter(
            "words",
            lambda w: (start - COLUMN_TOLERANCE <= w["x0"])
            & (stop.isNull() | (w["x0"] < stop - COLUMN_TOLERANCE)),
        )
        return F.when(start.isNotNull(), F.array_join(mine["text"], " "))

    return lines.withColumns({f: value(f) for f in KNOWN_FIELDS})


def gives_value(words: Column) -> Column:
    """True when a word that shows something stands in a column. Needs the source's ``starts``."""
    leftmost = F.col("starts")[0]["x0"]
    return F.exists(
        words, lambda w: (leftmost - COLUMN_TOLERANCE <= w["x0"]) & (F.trim(w["text"]) != "")
    )


def read_lines(words: DataFrame, config: Config) -> DataFrame:
    """Record lines of all documents, split into fields, with their locators.

    ``is_record`` tells lines that gave a value from lines nobody could read. It looks at the words
    and not at the values, which are then put together only once, for the lines that are asked for.
    """
    layout = config.layout_table(words.sparkSession).select("source", "starts", "spans")
    lines = mark_sections(number_lines(group_lines(words)), config).filter("keep")
    read = assign_columns(lines.join(F.broadcast(layout), "source"))
    return (
        read.withColumn("locator", document_locator(F.col("page"), F.col("line")))
        .withColumn(
            "ordinal",
            F.shiftleft(F.col("page").cast("long"), LINE_BITS) + F.col("line"),
        )
        .withColumn("is_record", F.coalesce(gives_value(F.col("words")), F.lit(False)))
    )


def document_records(read: DataFrame) -> DataFrame:
    """The lines that gave a value, as records."""
    return (
        read.filter("is_record").withColumn("side", F.lit(DOCUMENT)).select(*RECORD_COLUMNS)
    )


def unread_lines(read: DataFrame) -> DataFrame:
    """The lines inside the section that gave no value, shown with their place."""
    return read.filter(~F.col("is_record")).select(
        *RUN,
        "doc_id",
        "page",
        "line",
        F.concat("locator", F.lit(": "), "text").alias("unread_line"),
    )


def layout_probe(words: DataFrame, mask: bool = False, page: int | None = None) -> DataFrame:
    """Each line as its words with their positions, to find out where columns start.

    ``page`` looks at one page number only; it is an error if no document has it.
    """
    if page is not None:
        words = words.filter(F.col("page") == page)
        if words.isEmpty():
            raise ValueError(f"no document has a page {page}")

    def shown(word: Column) -> Column:
        text = mask_shape(word["text"]) if mask else word["text"]
        return F.concat(text, F.lit("@"), F.rint(word["x0"]).cast("bigint").cast("string"))

    return number_lines(group_lines(words)).select(
        *PAGE, "line", F.array_join(F.transform("words", shown), "  ").alias("shown")
    )


def column_start_counts(words: DataFrame) -> DataFrame:
    """How many words start at each position, per source: columns show up as high counts."""
    return words.groupBy("source", F.rint("x0").cast("long").alias("x0")).agg(
        F.count("*").alias("words")
    )


#: Positions further apart than this, in points, do not belong to one column.
COLUMN_GAP = 3
#: A proposed column has at least one word in so many of the fullest one.
COLUMN_SHARE = 20


def propose_columns(words: DataFrame) -> DataFrame:
    """Columns a source's statements seem to have: ``start``, ``stop``, ``words``, ``permille``.

    The positions words start at fall into segments with gaps between them; a segment is a column
    if it has enough words. ``permille`` compares it with the fullest segment of the source. Positions
    are whole points of a page, so few rows are left to be put in order per source.
    """
    by_source = Window.partitionBy("source")
    along = by_source.orderBy("x0")
    before = F.lag("x0").over(along)
    starts = column_start_counts(words).withColumn(
        "_opens", (before.isNull() | (F.col("x0") - before > COLUMN_GAP)).cast("int")
    )
    segments = (
        starts.withColumn("_segment", F.sum("_opens").over(along))
        .groupBy("source", "_segment")
        .agg(
            F.min("x0").alias("start"), F.max("x0").alias("stop"), F.sum("words").alias("words")
        )
    )
    fullest = F.max("words").over(by_source)
    return (
        segments.withColumn("permille", F.floor(F.col("words") * 1000 / fullest))
        .withColumn("_enough", F.col("words") * COLUMN_SHARE >= fullest)
        .filter("_enough")
        .select("source", "start", "stop", "words", "permille")
    )
