"""Queries over runs: calendars, arrivals, status of a range, files read and tables written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators import runs as rn
from pairwright.operators.calendar import expected_runs, first_weekdays, weekdays_between
from pairwright.operators.pairing import RUN
from pairwright.plans.derived_inputs import (
    EVENT_FILES,
    ORDERS,
    event_arrivals,
    order_arrivals,
    order_exports,
    order_records,
    order_words,
    table,
    write_order_exports,
)
from pairwright.plans.layout_queries import _LINES
from pairwright.plans.pair_queries import order_sides_sql
from pairwright.plans.reconcile import Inputs, Outcome
from pairwright.plans.reconcile import reconcile_range as check_range
from pairwright.plans.reconcile import reconcile_run as check_run
from pairwright.plans.registry import query
from pairwright.session import materialize, new_dir
from pairwright.sources import delimited as dl
from pairwright.sources import files as fl

# --------------------------------------------------------------------------------------------
# calendars
# --------------------------------------------------------------------------------------------


@query(
    "weekday_calendar",
    """SELECT CAST(d AS DATE) AS run_date FROM (
        SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)),
            max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d FROM orders)
    WHERE isodow(d) < 6""",
)
def weekday_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = table(spark, sf_dir, "orders").agg(
        F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last")
    )
    return span.select(F.explode(weekdays_between(F.col("first"), F.col("last"))).alias("run_date"))


@query(
    "weekday_calendar_n",
    """SELECT start, CAST(d AS DATE) AS run_date FROM (
        SELECT start, d, row_number() OVER (PARTITION BY start ORDER BY d) AS k FROM (
            SELECT start, unnest(generate_series(start, start + 20, INTERVAL 1 DAY)) AS d
            FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS start FROM orders))
        WHERE isodow(d) < 6)
    WHERE k <= 7""",
)
def weekday_calendar_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven weekdays from every order date on."""
    starts = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("start"))
    return starts.distinct().select(
        "start", F.explode(first_weekdays(F.col("start"), 7)).alias("run_date")
    )


# --------------------------------------------------------------------------------------------
# arrivals
# --------------------------------------------------------------------------------------------

_ARRIVALS = """
    WITH files AS (
        SELECT event_type AS source, CAST(ts AS DATE) + CAST(user_id AS INT) AS run_date,
            value < 4 OR (value >= 14 AND value < 20) AS is_document,
            value >= 4 AND value < 12 AS is_data, event_id, value
        FROM events WHERE value < 12 OR value >= 14),
    present AS (
        SELECT source, run_date, count(*) FILTER (is_document) AS documents,
            count(*) FILTER (is_data) AS data_files FROM files GROUP BY ALL),
    shown AS (
        SELECT *, documents > 0 AS has_document, data_files > 0 AS has_data,
            documents > 0 AND data_files > 0 AS complete,
            CASE WHEN documents = 0 AND data_files = 0 THEN 'PDF + spreadsheet'
                 WHEN documents = 0 THEN 'PDF' WHEN data_files = 0 THEN 'spreadsheet' ELSE '-' END
                AS missing
        FROM present)
"""


@query("folder_presence", f"{_ARRIVALS} SELECT * FROM shown")
def folder_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.folder_presence(event_arrivals(spark, sf_dir), EVENT_FILES)


@query(
    "inventory_scan",
    f"""{_ARRIVALS}
    , days AS (SELECT CAST(d AS DATE) AS run_date FROM (
        SELECT unnest(generate_series(min(run_date), max(run_date), INTERVAL 1 DAY)) AS d
        FROM (SELECT CAST(ts AS DATE) + CAST(user_id AS INT) AS run_date FROM events))
        WHERE isodow(d) < 6)
    SELECT s.source, d.run_date, p.source IS NOT NULL AS folder_exists,
        coalesce(has_document, false) AS has_document, coalesce(has_data, false) AS has_data,
        coalesce(complete, false) AS complete, coalesce(missing, 'PDF + spreadsheet') AS missing
    FROM (SELECT unnest(['signup', 'error', 'view', 'click', 'purchase']) AS source) s
    CROSS JOIN days d LEFT JOIN shown p ON p.source = s.source AND p.run_date = d.run_date""",
)
def inventory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrivals = event_arrivals(spark, sf_dir)
    calendar = arrivals.agg(F.min("run_date").alias("a"), F.max("run_date").alias("b")).select(
        F.explode(weekdays_between(F.col("a"), F.col("b"))).alias("run_date")
    )
    return rn.inventory(expected_runs(calendar, EVENT_FILES), arrivals, EVENT_FILES).drop(
        "documents", "data_files"
    )


@query(
    "exactly_one_file",
    f"""{_ARRIVALS}
    SELECT source, run_date, documents, data_files,
        CASE WHEN documents = 0 THEN 'no PDF found'
             WHEN documents > 1 THEN documents || ' PDF files found'
             WHEN data_files = 0 THEN 'no spreadsheet found'
             ELSE data_files || ' spreadsheet files found' END AS error
    FROM present WHERE documents <> 1 OR data_files <> 1""",
)
def exactly_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.file_count_errors(event_arrivals(spark, sf_dir), EVENT_FILES)


@query(
    "conflicting_files",
    f"""{_ARRIVALS}
    SELECT f.source, f.run_date,
        CASE WHEN value < 4 THEN 'statement.pdf' WHEN value < 9 THEN 'Export.CSV'
             WHEN value < 12 THEN 'records.xlsx' ELSE 'scan-' || event_id || '.PDF' END AS filename
    FROM files f JOIN present p ON p.source = f.source AND p.run_date = f.run_date
    WHERE (is_document AND documents > 1) OR (is_data AND data_files > 1)""",
)
def conflicting_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of runs that hold more than one of a kind."""
    return rn.conflicting_files(event_arrivals(spark, sf_dir), EVENT_FILES).drop("kind")


@query(
    "infer_source",
    """SELECT DISTINCT '/data/' || CASE WHEN month(o_orderdate) = 1 THEN 'old 5-low/' ELSE '' END
            || CASE WHEN month(o_orderdate) = 2 THEN 'misc' ELSE lower(o_orderpriority) || ' files' END
            || '/' || strftime(o_orderdate, '%Y.%m.%d') AS path,
        CASE WHEN month(o_orderdate) = 2 THEN NULL
             WHEN month(o_orderdate) = 1 AND o_orderpriority <> '5-LOW' THEN NULL
             ELSE o_orderpriority END AS source
    FROM orders""",
)
def infer_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders named after their source; in January two names occur, in February none."""
    month = F.month("run_date")
    paths = order_records(spark, sf_dir).select(
        F.concat(
            F.lit("/data/"),
            F.when(month == 1, F.lit("old 5-low/")).otherwise(F.lit("")),
            F.when(month == 2, F.lit("misc")).otherwise(
                F.concat(F.lower("source"), F.lit(" files"))
            ),
            F.lit("/"),
            F.date_format("run_date", "yyyy.MM.dd"),
        ).alias("path")
    )
    return rn.infer_source(paths.distinct(), ORDERS)


# --------------------------------------------------------------------------------------------
# a whole range
# --------------------------------------------------------------------------------------------

_RANGE = f"""{_LINES},
    {order_sides_sql(yearly=True)},
    runs AS (
        SELECT source, run_date,
            NOT (source = '5-LOW' AND year(run_date) = 1996) AS has_document,
            NOT (source = '1-URGENT' AND year(run_date) = 1997) AS has_data,
            source = '3-MEDIUM' AND year(run_date) = 1998 AS resent
        FROM o GROUP BY ALL),
    expected AS (
        SELECT p.source, y.run_date FROM (SELECT DISTINCT source FROM o) p
        CROSS JOIN (SELECT run_date FROM o UNION
                    SELECT CAST(run_date + INTERVAL 1 YEAR AS DATE) FROM o) y),
    checkable AS (SELECT * FROM runs WHERE has_document AND has_data AND NOT resent),
    read AS (SELECT f.* FROM final f JOIN checkable c
             ON f.source = c.source AND f.run_date = c.run_date WHERE f.keep),
    d AS (SELECT * FROM read WHERE text <> '~ note'),
    s AS (SELECT t.* FROM sheet t JOIN checkable c
          ON t.source = c.source AND t.run_date = c.run_date),
    pairs AS (
        SELECT coalesce(d.source, s.source) AS source, coalesce(d.run_date, s.run_date) AS run_date,
            d.reference IS NOT NULL AS in_document, s.pair_key IS NOT NULL AS in_sheet,
            s.description LIKE '% pending' AS description_differs, s.price > 490000 AS amount_differs,
            d.quantity = '' AS quantity_differs
        FROM d FULL JOIN s
            ON d.source = s.source AND d.run_date = s.run_date AND d.reference = s.pair_key),
    judged AS (
        SELECT *, CASE WHEN NOT in_document OR NOT in_sheet THEN 'one_sided'
            WHEN description_differs OR amount_differs OR quantity_differs THEN 'differing'
            ELSE 'matched' END AS outcome FROM pairs),
    counts AS (
        SELECT source, run_date, count(*) FILTER (in_document) AS document_count,
            count(*) FILTER (in_sheet) AS spreadsheet_count,
            count(*) FILTER (outcome = 'matched') AS matched,
            count(*) FILTER (outcome = 'differing') AS differing,
            count(*) FILTER (outcome = 'one_sided') AS one_sided
        FROM judged GROUP BY ALL),
    notes AS (SELECT source, run_date, count(*) AS unread FROM read WHERE text = '~ note'
              GROUP BY ALL),
    results AS (
        SELECT c.source, c.run_date, coalesce(document_count, 0) AS document_count,
            coalesce(spreadsheet_count, 0) AS spreadsheet_count, coalesce(matched, 0) AS matched,
            coalesce(differing, 0) AS differing, coalesce(one_sided, 0) AS one_sided,
            coalesce(unread, 0) AS unread
        FROM checkable c
        LEFT JOIN counts k ON c.source = k.source AND c.run_date = k.run_date
        LEFT JOIN notes n ON c.source = n.source AND c.run_date = n.run_date),
    judged_runs AS (
        SELECT *, document_count > 0 AND differing = 0 AND one_sided = 0 AND unread = 0 AS clean,
            concat_ws(', ',
                CASE WHEN document_count = 0 THEN 'nothing read from document' END,
                CASE WHEN differing > 0 THEN differing || ' differing' END,
                CASE WHEN one_sided > 0 THEN one_sided || ' one-sided' END,
                CASE WHEN unread > 0 THEN unread || ' unread' END) AS reason
        FROM results),
    overview AS (
        SELECT e.run_date, e.source,
            CASE WHEN r.source IS NULL OR NOT has_document OR NOT has_data THEN 'INCOMPLETE'
                 WHEN resent THEN 'FAILED' WHEN clean THEN 'RECONCILED' ELSE 'DIFFERENCES' END
                AS status,
            CASE WHEN r.source IS NULL THEN 'folder does not exist'
                 WHEN NOT has_document THEN 'missing PDF'
                 WHEN NOT has_data THEN 'missing spreadsheet'
                 WHEN resent THEN '2 PDF files found' ELSE reason END AS why,
            document_count, spreadsheet_count, matched, differing, one_sided, unread,
            '/statements/' || e.source || '/' || e.source || ' '
                || strftime(e.run_date, '%Y.%m.%d') AS folder
        FROM expected e
        LEFT JOIN runs r ON e.source = r.source AND e.run_date = r.run_date
        LEFT JOIN judged_runs j ON e.source = j.source AND e.run_date = j.run_date)
"""


def _inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(
        words=order_words(spark, sf_dir),
        sheet_records=order_exports(spark, sf_dir).withColumn(
            "run_date", F.trunc("run_date", "year")
        ),
        arrivals=order_arrivals(spark, sf_dir),
    )


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year with orders and the one after it."""
    year = F.trunc(F.to_date("o_orderdate"), "year")
    return (
        table(spark, sf_dir, "orders")
        .select(F.explode(F.array(year, F.add_months(year, 12))).alias("run_date"))
        .distinct()
    )


def _range(spark: SparkSession, sf_dir: str) -> Outcome:
    return check_range(_inputs(spark, sf_dir), ORDERS, _years(spark, sf_dir))


@query("reconcile_range", f"{_RANGE} SELECT * FROM overview")
def reconcile_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _range(spark, sf_dir).overview


@query("run_status", f"{_RANGE} SELECT source, run_date, status, why FROM overview")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _range(spark, sf_dir).overview.select("source", "run_date", "status", "why")


@query(
    "status_tally",
    f"""{_RANGE} SELECT s.status, count(o.status) AS runs FROM (
        SELECT unnest(['RECONCILED', 'DIFFERENCES', 'INCOMPLETE', 'FAILED']) AS status) s
    LEFT JOIN overview o ON o.status = s.status GROUP BY s.status""",
)
def status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.status_tally(_range(spark, sf_dir).overview)


@query(
    "reconcile_run",
    f"""{_RANGE} SELECT source, run_date, document_count, spreadsheet_count, matched, differing,
        one_sided, unread, CASE WHEN clean THEN 'FULLY RECONCILED' ELSE 'DIFFERENCES FOUND' END
            AS verdict, reason
    FROM judged_runs WHERE source = '2-HIGH' AND year(run_date) = 1999""",
)
def reconcile_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source on one run date, as a check of a single folder does it."""
    outcome = check_run(_inputs(spark, sf_dir), ORDERS, "2-high", "1999-01-01")
    return outcome.results.select(
        *RUN, "document_count", "spreadsheet_count", "matched", "differing", "one_sided",
        "unread", "verdict", "reason",
    )


# --------------------------------------------------------------------------------------------
# tables written
# --------------------------------------------------------------------------------------------


@query(
    "sink_report",
    f"""{_RANGE}
    SELECT 'summary' AS name, source, run_date, 1 AS rows FROM results
    UNION ALL SELECT 'lines', source, run_date, 9 + (document_count = 0)::INT FROM results
    UNION ALL SELECT CASE outcome WHEN 'one_sided' THEN 'unmatched' ELSE outcome END, source,
        run_date, count(*) FROM judged WHERE outcome <> 'differing' GROUP BY ALL
    UNION ALL SELECT 'differences', source, run_date, sum(description_differs::INT
        + amount_differs::INT + quantity_differs::INT) FROM judged WHERE outcome = 'differing'
        GROUP BY ALL
    UNION ALL SELECT 'unread', source, run_date, unread FROM notes""",
)
def sink_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All report tables written run by run and read back; rows per table and run."""
    outcome = _range(spark, sf_dir)
    tables = fl.report_tables(
        outcome.results, outcome.pairs, outcome.unread, outcome.records, ORDERS
    )
    root = new_dir(spark, "report")
    fl.write_report(tables, root, "r1")
    counted = None
    for name in tables:
        rows = (
            fl.read_report(spark, root, name)
            .groupBy(*RUN)
            .agg(F.count("*").alias("rows"))
            .select(F.lit(name).alias("name"), *RUN, "rows")
        )
        counted = rows if counted is None else counted.unionByName(rows)
    return counted


@query("sink_overview", f"{_RANGE} SELECT * FROM overview")
def sink_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview written and read back."""
    path = new_dir(spark, "overview")
    fl.write_overview(_range(spark, sf_dir).overview, path)
    return spark.read.parquet(path)


# --------------------------------------------------------------------------------------------
# files read
# --------------------------------------------------------------------------------------------

_FILES = """
    WITH o AS (
        SELECT o_orderpriority AS source, CAST(date_trunc('year', o_orderdate) AS DATE) AS run_date,
            o_orderkey // 1048576 AS part, o_orderkey AS ordinal, o_totalprice AS price,
            'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS reference,
            strftime(o_orderdate, '%Y-%m-%d') AS date,
            CASE WHEN o_orderstatus = 'P' THEN 'customer' || chr(10) || o_custkey || ' "pending"'
                 ELSE 'customer ' || o_custkey END AS description,
            CAST(o_custkey % 500 + 1 AS VARCHAR) AS quantity, printf('%.2f', o_totalprice) AS amount
        FROM orders),
    headers AS (
        SELECT unnest([
            {'source': '1-URGENT', 'header': 'Vch|Value Day|Text|Pcs|Total'},
            {'source': '2-HIGH', 'header': '  voucher |BOOKED|Wording|Pieces|Sum'},
            {'source': '3-MEDIUM', 'header': 'Voucher|Booked|Wording|Pieces|Sum'},
            {'source': '4-NOT SPECIFIED', 'header': 'Sum|Voucher|Vch|Booked|sum'},
            {'source': '5-LOW', 'header': 'Voucher|Booked|Wording|Pieces|Gross'}]) AS h),
    counted AS (
        SELECT source, run_date, part, -1 AS ordinal, 0 AS sub, h.header AS cells
        FROM (SELECT DISTINCT source, run_date, part FROM o) JOIN headers ON h.source = source
        UNION ALL
        SELECT source, run_date, part, ordinal, 0,
            concat_ws('|', reference, date, description, quantity, amount) FROM o
        UNION ALL
        SELECT source, run_date, part, ordinal, 1, '||||' FROM o WHERE price > 495000),
    rowed AS (
        SELECT *, row_number() OVER (PARTITION BY source, run_date, part ORDER BY ordinal, sub)
            AS row FROM counted)
"""


def _exports(spark: SparkSession, sf_dir: str) -> str:
    root = new_dir(spark, "exports")
    write_order_exports(spark, sf_dir, root)
    return root


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dl.read_text_lines(spark, _exports(spark, sf_dir), ".txt")
    # headers, cells and records are all read from the numbered lines
    return dl.assemble_rows(materialize(dl.number_rows(lines, ","), "exports"), ",")


@query("scan_delimited", f"{_FILES} SELECT source, run_date, part, row, cells FROM rowed")
def scan_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports written as text, read back row by row; cells are shown joined by a bar."""
    return _scan(spark, sf_dir).select(
        *RUN, F.col("part").cast("long").alias("part"), "row",
        F.array_join("cells", "|").alias("cells"),
    )


@query(
    "resolve_headers",
    f"""{_FILES}, found AS (SELECT unnest([
            {{'source': '1-URGENT', 'idx': [0, 1, 2, 3, 4]}},
            {{'source': '2-HIGH', 'idx': [0, 1, 2, 3, 4]}},
            {{'source': '3-MEDIUM', 'idx': [0, 1, 2, 3, 4]}},
            {{'source': '4-NOT SPECIFIED', 'idx': [1, 3, NULL, NULL, 4]}},
            {{'source': '5-LOW', 'idx': [0, 1, 2, 3, NULL]}}]) AS f),
    fields AS (SELECT unnest([
            {{'field': 'reference', 'tried': 'Voucher, Vch', 'at': 1}},
            {{'field': 'date', 'tried': 'Booked, Value Day', 'at': 2}},
            {{'field': 'description', 'tried': 'Wording, Text', 'at': 3}},
            {{'field': 'quantity', 'tried': 'Pieces, Pcs', 'at': 4}},
            {{'field': 'amount', 'tried': 'Sum, Total', 'at': 5}}]) AS g)
    SELECT k.source, k.run_date, k.part, g.field AS field, f.idx[g.at] AS idx,
        CASE WHEN f.idx[g.at] IS NULL THEN 'no header for ' || g.field || ' (' || g.tried
            || ') in: ' || replace(h.header, '|', ', ') END AS error
    FROM (SELECT DISTINCT source, run_date, part FROM o) k
    JOIN headers ON h.source = k.source JOIN found ON f.source = k.source CROSS JOIN fields""",
)
def resolve_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each field is in each file, and why a field was not found."""
    headers = materialize(dl.header_cells(_scan(spark, sf_dir)), "headers")
    resolved = dl.resolve_headers(headers, ORDERS)
    errors = dl.resolve_errors(resolved, headers, ORDERS).select(dl.FILE, "field", "error")
    return resolved.join(errors, [dl.FILE, "field"], "left").select(
        *RUN, F.col("part").cast("long").alias("part"), "field", "idx", "error"
    )


@query(
    "rows_to_records",
    f"""{_FILES} SELECT r.source, r.run_date, 'row ' || r.row AS locator, o.reference, o.date,
        o.description, o.quantity, o.amount
    FROM rowed r JOIN o ON o.ordinal = r.ordinal AND r.sub = 0
    WHERE r.source IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
)
def rows_to_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all files whose headers were found."""
    rows = _scan(spark, sf_dir)
    headers = materialize(dl.header_cells(rows), "headers")
    resolved = dl.resolve_headers(headers, ORDERS)
    return dl.rows_to_records(rows, resolved).select(
        *RUN, "locator", "reference", "date", "description", "quantity", "amount"
    )


@query(
    "list_files",
    f"""{_FILES} SELECT source, CAST(run_date AS VARCHAR) AS run_date, '.txt' AS suffix,
        count(DISTINCT part) AS files FROM o GROUP BY ALL""",
)
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = fl.list_files(spark, _exports(spark, sf_dir))
    folder = r"/source=([^/]+)/run_date=([^/]+)/"
    return (
        listed.select(
            F.url_decode(F.regexp_extract("path", folder, 1)).alias("source"),
            F.regexp_extract("path", folder, 2).alias("run_date"),
            "suffix",
        )
        .groupBy("source", "run_date", "suffix")
        .agg(F.count("*").alias("files"))
    )
