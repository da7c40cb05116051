"""Queries that rebuild statement records from positioned words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators import layout as ly
from pairwright.plans.derived_inputs import ORDERS, order_words, table
from pairwright.plans.registry import query
from pairwright.session import materialize, new_dir
from pairwright.sources.files import scan_words as read_words
from pairwright.specs import KNOWN_FIELDS

# --------------------------------------------------------------------------------------------
# the same statements in SQL
# --------------------------------------------------------------------------------------------

_BASE = """
    base AS (
        SELECT o_orderpriority AS source, CAST(date_trunc('year', o_orderdate) AS DATE) AS run_date,
            o_orderpriority || ' ' || year(o_orderdate) AS doc_id,
            CAST(o_orderkey // 64 AS INT) AS page,
            CAST(40 + (o_orderkey % 64) * 11 AS DOUBLE) AS top,
            o_orderkey AS ordinal, o_custkey AS customer, o_orderstatus AS status,
            o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d') AS date,
            'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS reference,
            CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey % 500 + 1 AS VARCHAR) END AS quantity,
            format('{:,.2f}', o_totalprice) AS amount
        FROM orders)"""

_LINES = f"""
    WITH {_BASE},
    lines AS (
        SELECT source, run_date, doc_id, page, top AS line_top,
            concat_ws(' ', '*', reference, date, 'Customer ' || customer, quantity, amount) AS text,
            reference, date, 'Customer ' || customer AS description,
            coalesce(quantity, '') AS quantity, amount,
            concat_ws('  ', '*@6', 'AAA-999999999999@54', '9999-99-99@148', 'Aaaaaaaa@232',
                regexp_replace(CAST(customer AS VARCHAR), '[0-9]', '9', 'g') || '@288',
                regexp_replace(quantity, '[0-9]', '9', 'g') || '@371',
                regexp_replace(amount, '[0-9]', '9', 'g') || '@450') AS shown,
            6 + (quantity IS NOT NULL)::INT AS words
        FROM base
        UNION ALL SELECT source, run_date, doc_id, page, top + 3, 'SUM CARRIED OVER', 'SUM CARRIED OVER',
            '', '', '', '', 'AAA@60  AAAAAAA@80  AAAA@95', 3 FROM base WHERE price > 480000
        UNION ALL SELECT source, run_date, doc_id, page, top + 4, 'Booked Entries',
            'Booked Entries', '', '', '', '', 'Aaaaaa@60  Aaaaaaa@120', 2
            FROM base WHERE price < 30000
        UNION ALL SELECT source, run_date, doc_id, page, top + 5,
            'sum carried over, booked entries', 'sum carried over,', 'booked entries', '', '', '',
            'aaa@60  aaaaaaa@80  aaaa,@100  aaaaaa@150  aaaaaaa@205', 5
            FROM base WHERE price > 240000 AND price < 250000
        UNION ALL SELECT source, run_date, doc_id, page, top + 6, 'Sheet 7', '', '', 'Sheet 7', '',
            '', 'Aaaaa@300  9@330', 2 FROM base WHERE price > 100000 AND price < 120000
        UNION ALL SELECT source, run_date, doc_id, page, top + 7, '~ note', '', '', '', '', '',
            '~@3  aaaa@12', 2 FROM base WHERE status = 'P'),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_top) AS line,
            contains(lower(text), 'booked entries') AS is_start,
            contains(lower(text), 'sum carried over') AS is_stop,
            contains(lower(text), 'sheet ') AS is_skip
        FROM lines),
    marked AS (
        SELECT *, CASE WHEN is_start AND NOT is_stop THEN 1
                       WHEN is_stop AND NOT is_start THEN 0 END AS sets,
            sum((is_start AND is_stop)::INT) OVER (PARTITION BY doc_id ORDER BY page, line_top
                ROWS UNBOUNDED PRECEDING) AS flips
        FROM numbered),
    stated AS (
        SELECT *,
            (coalesce(last_value(sets IGNORE NULLS) OVER earlier, 0)
             + coalesce(last_value(flips) OVER earlier, 0)
             - coalesce(last_value(CASE WHEN sets IS NOT NULL THEN flips END IGNORE NULLS)
                        OVER earlier, 0)) % 2 = 1 AS in_section
        FROM marked
        WINDOW earlier AS (PARTITION BY doc_id ORDER BY page, line_top
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    final AS (
        SELECT *, in_section AND NOT is_stop AND NOT is_skip AND NOT is_start AS keep,
            'page ' || page || ', line ' || line AS locator FROM stated)
"""

_WORDS = f"""
    WITH {_BASE},
    words AS (
        SELECT source, run_date, doc_id, page, ordinal, unnest([
            {{'text': date, 'x0': 148.4, 'up': 0.2, 'pos': 0}},
            {{'text': reference, 'x0': 54.0, 'up': 0.0, 'pos': 1}},
            {{'text': amount, 'x0': 450.5, 'up': 0.4, 'pos': 2}},
            {{'text': 'Customer', 'x0': 232.0, 'up': 0.1, 'pos': 3}},
            {{'text': CAST(customer AS VARCHAR), 'x0': 288.0, 'up': 0.1, 'pos': 4}},
            {{'text': '*', 'x0': 6.0, 'up': 0.0, 'pos': 5}}]) AS w, top FROM base
        UNION ALL SELECT source, run_date, doc_id, page, ordinal,
            {{'text': quantity, 'x0': 371.0, 'up': 0.0, 'pos': 6}}, top FROM base
            WHERE quantity IS NOT NULL
        UNION ALL SELECT source, run_date, doc_id, page, ordinal, unnest([
            {{'text': 'SUM', 'x0': 60.0, 'up': 3.0, 'pos': 7}},
            {{'text': 'CARRIED', 'x0': 80.0, 'up': 3.0, 'pos': 8}},
            {{'text': 'OVER', 'x0': 95.0, 'up': 3.0, 'pos': 9}}]), top
            FROM base WHERE price > 480000
        UNION ALL SELECT source, run_date, doc_id, page, ordinal, unnest([
            {{'text': 'Booked', 'x0': 60.0, 'up': 4.0, 'pos': 7}},
            {{'text': 'Entries', 'x0': 120.0, 'up': 4.0, 'pos': 8}}]), top
            FROM base WHERE price < 30000
        UNION ALL SELECT source, run_date, doc_id, page, ordinal, unnest([
            {{'text': 'sum', 'x0': 60.0, 'up': 5.0, 'pos': 7}},
            {{'text': 'carried', 'x0': 80.0, 'up': 5.0, 'pos': 8}},
            {{'text': 'over,', 'x0': 100.0, 'up': 5.0, 'pos': 9}},
            {{'text': 'booked', 'x0': 150.0, 'up': 5.0, 'pos': 10}},
            {{'text': 'entries', 'x0': 205.0, 'up': 5.0, 'pos': 11}}]), top
            FROM base WHERE price > 240000 AND price < 250000
        UNION ALL SELECT source, run_date, doc_id, page, ordinal, unnest([
            {{'text': 'Sheet', 'x0': 300.0, 'up': 6.0, 'pos': 7}},
            {{'text': '7', 'x0': 330.0, 'up': 6.0, 'pos': 8}}]), top
            FROM base WHERE price > 100000 AND price < 120000
        UNION ALL SELECT source, run_date, doc_id, page, ordinal, unnest([
            {{'text': '~', 'x0': 3.0, 'up': 7.0, 'pos': 20}},
            {{'text': 'note', 'x0': 12.0, 'up': 7.0, 'pos': 21}}]), top
            FROM base WHERE status = 'P')
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.number_lines(ly.group_lines(order_words(spark, sf_dir)))


@query(
    "scan_words",
    f"""{_WORDS} SELECT source, run_date, doc_id, page, w.text AS text, CAST(w.x0 AS DOUBLE) AS x0,
        round(top + CAST(w.up AS DOUBLE), 1) AS top FROM words""",
)
def scan_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words written to the shared folder and read back."""
    path = new_dir(spark, "words")
    order_words(spark, sf_dir).write.parquet(path)
    return read_words(spark, path).drop("seq").withColumn("top", F.round("top", 1))


@query(
    "group_lines",
    f"{_LINES} SELECT source, run_date, doc_id, page, line_top, words FROM lines",
)
def group_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ly.group_lines(order_words(spark, sf_dir))
    return lines.select(*ly.PAGE, "line_top", F.size("words").alias("words"))


@query("line_text", f"{_LINES} SELECT source, run_date, doc_id, page, line_top, text FROM lines")
def line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.group_lines(order_words(spark, sf_dir)).select(*ly.PAGE, "line_top", "text")


@query(
    "sort_words",
    f"""{_WORDS} SELECT source, run_date, doc_id, page, CAST(top + round(w.up) AS DOUBLE) AS line_top,
        w.text AS text, row_number() OVER (PARTITION BY doc_id, page, top + round(w.up)
            ORDER BY w.x0, w.up, w.pos) AS place
    FROM words""",
)
def sort_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ly.group_lines(order_words(spark, sf_dir))
    return lines.select(*ly.PAGE, "line_top", F.posexplode("words").alias("pos", "w")).select(
        *ly.PAGE, "line_top", "w.text", (F.col("pos") + 1).alias("place")
    )


@query("line_number", f"{_LINES} SELECT source, run_date, doc_id, page, line, text FROM numbered")
def line_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*ly.PAGE, "line", "text")


@query(
    "section_filter",
    f"{_LINES} SELECT source, run_date, doc_id, page, line, in_section, keep FROM final",
)
def section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = ly.mark_sections(_lines(spark, sf_dir), ORDERS)
    return marked.select(*ly.PAGE, "line", "in_section", "keep")


@query(
    "assign_columns",
    f"""{_WORDS} SELECT doc_id, page, w.text AS text, CAST(w.x0 AS DOUBLE) AS x0,
        CASE WHEN w.x0 >= 450 THEN 'amount' WHEN w.x0 >= 370 THEN 'quantity'
             WHEN w.x0 >= 230 THEN 'description' WHEN w.x0 >= 146 THEN 'date'
             WHEN w.x0 >= 52 THEN 'reference' END AS field FROM words""",
)
def assign_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column every single word belongs to; none for words left of all columns."""
    layout = ORDERS.layout_table(spark).select("source", "starts")
    return (
        order_words(spark, sf_dir)
        .join(F.broadcast(layout), "source")
        .select("doc_id", "page", "text", "x0", ly.column_of(F.col("x0")).alias("field"))
    )


@query(
    "columns_to_values",
    f"""{_LINES} SELECT source, run_date, locator, date, description, quantity, amount, reference
    FROM final WHERE keep AND text <> '~ note'""",
)
def columns_to_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = ly.document_records(ly.read_lines(order_words(spark, sf_dir), ORDERS))
    return records.select(
        "source", "run_date", "locator", *[f for f in KNOWN_FIELDS if f != "account"]
    )


@query(
    "records_vs_unread",
    f"""{_LINES} SELECT source, run_date, doc_id, page, line, text <> '~ note' AS is_record,
        CASE WHEN text = '~ note' THEN locator || ': ' || text END AS unread_line
    FROM final WHERE keep""",
)
def records_vs_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read by both branches: what is shown of a line is kept, its words are not
    shown = [*ly.PAGE, "line", "locator", "text", "is_record"]
    read = materialize(ly.read_lines(order_words(spark, sf_dir), ORDERS).select(*shown), "lines")
    unread = ly.unread_lines(read).withColumn("is_record", F.lit(False))
    records = read.filter("is_record").select(
        *ly.PAGE, "line", "is_record", F.lit(None).cast("string").alias("unread_line")
    )
    return records.unionByName(unread)


@query("layout_probe", f"{_LINES} SELECT source, run_date, doc_id, page, line, shown FROM numbered")
def layout_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.layout_probe(order_words(spark, sf_dir), mask=True)


@query(
    "layout_start_counts",
    f"""{_WORDS} SELECT source, CAST(round_even(w.x0, 0) AS BIGINT) AS x0, count(*) AS words
    FROM words GROUP BY ALL""",
)
def layout_start_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often words start at each position: the columns of a layout stand out."""
    return ly.column_start_counts(order_words(spark, sf_dir))


@query(
    "layout_proposal",
    f"""{_WORDS},
    starts AS (SELECT source, CAST(round_even(w.x0, 0) AS BIGINT) AS x0, count(*) AS words
        FROM words GROUP BY ALL),
    gaps AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY source ORDER BY x0) <= 3 THEN 0
        ELSE 1 END AS opens FROM starts),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY x0) AS segment FROM gaps),
    segments AS (SELECT source, min(x0) AS start, max(x0) AS stop, CAST(sum(words) AS BIGINT) AS words
        FROM numbered GROUP BY source, segment),
    compared AS (SELECT *, max(words) OVER (PARTITION BY source) AS fullest FROM segments)
    SELECT source, start, stop, words, words * 1000 // fullest AS permille FROM compared
    WHERE words * 20 >= fullest""",
)
def layout_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the columns of each source's statements seem to start."""
    return ly.propose_columns(order_words(spark, sf_dir))


@query(
    "marker_predicate",
    """SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'the of')
        OR contains(lower(text), '100%') AS has_marker FROM documents""",
)
def marker_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold any of three markers, one of which has a wildcard character in it."""
    markers = F.array(F.lit("license"), F.lit("the of"), F.lit("100%"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", ly.contains_any(F.col("text"), markers).alias("has_marker")
    )
