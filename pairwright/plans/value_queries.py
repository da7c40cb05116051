"""Queries over single values: normalisers, names, labels and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import normalize as nz
from pairwright.functions.naming import (
    document_locator,
    file_kind,
    row_locator,
    safe_filename,
)
from pairwright.operators.pairing import (
    normalize_records,
    normalized_value,
    side_label,
    with_source_rules,
)
from pairwright.plans.derived_inputs import (
    DIFFERING_SOURCES,
    EVENT_FILES,
    LINES,
    ORDERS,
    event_arrivals,
    line_records,
    order_records,
    order_statements,
    table,
)
from pairwright.plans.registry import query
from pairwright.specs import DOCUMENT, FIELD_KINDS, KNOWN_FIELDS, SPREADSHEET

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


@query(
    "norm_text",
    f"""SELECT doc_id,
        upper(replace(trim(regexp_replace(text, '{_SPACE}+', ' ', 'g')), 'ß', 'SS')) AS n_text
    FROM documents""",
)
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", nz.norm_text("text").alias("n_text"))


def _pick(selector: Column, spellings: list[Column]) -> Column:
    chosen = spellings[-1]
    for i, spelling in reversed(list(enumerate(spellings[:-1]))):
        chosen = F.when(selector == i, spelling).otherwise(chosen)
    return chosen


@query(
    "norm_date",
    """SELECT o_orderkey AS ordinal,
        CASE WHEN o_orderstatus = 'P' THEN 'OPEN SINCE ' || strftime(o_orderdate, '%d/%m/%Y')
             ELSE strftime(o_orderdate, '%Y-%m-%d') END AS n_date
    FROM orders""",
)
def norm_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in every accepted spelling; open orders carry a text that is no date."""
    day = F.to_date("o_orderdate")

    def spelled(pattern: str) -> Column:
        return F.date_format(day, pattern)

    spellings = [
        spelled(p)
        for p in (
            "yyyy-MM-dd", "yyyy/M/d", "yyyy.MM.d", "yyyyMMdd", "dd-MMM-yyyy", "d MMM yyyy",
            "dd-MMMM-yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yy", "MMM d, yy",
            "dd-MM-yyyy", "d/M/yyyy", "dd.MM.yyyy", "dd-MM-yy", "dd/MM/yy",
            "yyyy-MM-dd 00:00:00", "'  'd  MMM  yyyy' '",
        )
    ]
    text = F.when(
        F.col("o_orderstatus") == "P", F.concat(F.lit(" open  since "), spelled("dd/MM/yyyy"))
    ).otherwise(_pick(F.col("o_custkey") % len(spellings), spellings))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ordinal"), nz.norm_date(text).alias("n_date")
    )


@query(
    "date_order",
    """SELECT o_orderkey AS ordinal, strftime(o_orderdate, '%Y-%m-%d') AS day_first,
        CASE WHEN day(o_orderdate) <= 12
             THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)),
                           '%Y-%m-%d')
             ELSE strftime(o_orderdate, '%Y-%m-%d') END AS month_first
    FROM orders""",
)
def date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.date_format(F.to_date("o_orderdate"), "d/MM/yyyy")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ordinal"),
        nz.norm_date(spelled, nz.DAY_FIRST).alias("day_first"),
        nz.norm_date(spelled, F.lit(nz.MONTH_FIRST)).alias("month_first"),
    )


_PLAIN = "rtrim(rtrim(printf('%.2f', o_totalprice), '0'), '.')"


@query(
    "norm_number",
    f"""SELECT o_orderkey AS ordinal,
        CASE WHEN o_custkey % 10 IN (5, 6, 7) THEN '-' || {_PLAIN}
             WHEN o_custkey % 10 = 9 THEN 'ABOUT ' || printf('%.2f', o_totalprice) || ' OR SO 1'
             ELSE {_PLAIN} END AS n_number
    FROM orders""",
)
def norm_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices as statements of many countries print them."""
    grouped = F.format_number("o_totalprice", 2)
    plain = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    spellings = [
        grouped,
        F.translate(grouped, ",.", ".,"),
        F.translate(grouped, ",", " "),
        F.translate(grouped, ",", "'"),
        F.concat(F.lit("EUR "), grouped),
        F.concat(F.lit(" ("), grouped, F.lit(" ) ")),
        F.concat(F.translate(grouped, ",.", "’,"), F.lit(" -")),
        F.concat(F.lit("-"), plain, F.lit("$")),
        F.concat(plain, F.lit(" DR")),
        F.concat(F.lit("about "), plain, F.lit("  or so 1")),
    ]
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ordinal"),
        nz.norm_number(_pick(F.col("o_custkey") % 10, spellings)).alias("n_number"),
    )


@query(
    "unify_separator",
    """SELECT o_orderkey AS ordinal,
        printf('%.2f', o_totalprice) AS both_comma_last,
        printf('%.2f', o_totalprice) AS both_dot_last,
        printf('%.0f', o_totalprice) AS grouping_only,
        printf('%.2f', o_totalprice) AS decimal_comma
    FROM orders""",
)
def unify_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = F.format_number("o_totalprice", 2)
    plain = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ordinal"),
        nz.unify_separator(F.translate(grouped, ",.", ".,")).alias("both_comma_last"),
        nz.unify_separator(grouped).alias("both_dot_last"),
        nz.unify_separator(F.format_number("o_totalprice", 0)).alias("grouping_only"),
        nz.unify_separator(F.translate(plain, ".", ",")).alias("decimal_comma"),
    )


@query(
    "format_number",
    """SELECT o_orderkey AS ordinal,
        regexp_replace(rtrim(rtrim(printf('%.6f', o_totalprice / 7), '0'), '.'), '^-0$', '0')
            AS seventh,
        regexp_replace(rtrim(rtrim(printf('%.6f', -o_totalprice / 1e12), '0'), '.'), '^-0$', '0')
            AS tiny,
        regexp_replace(rtrim(rtrim(printf('%.6f', o_totalprice), '0'), '.'), '^-0$', '0') AS price
    FROM orders""",
)
def format_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ordinal"),
        nz.norm_numeric(price / 7).alias("seventh"),
        nz.norm_numeric(-price / F.lit(1e12)).alias("tiny"),
        nz.norm_numeric(price).alias("price"),
    )


@query(
    "norm_quantity",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CASE WHEN l_tax > 0.075 THEN 'V1X' || CAST(CAST(l_quantity AS INT) AS VARCHAR)
             ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS n_quantity
    FROM lineitem""",
)
def norm_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line quantities as counts; a mark such as v1x12.0 is text but loses its ending too."""
    text = F.col("l_quantity").cast("decimal(10,1)").cast("string")
    spelled = (
        F.when(F.col("l_tax") > 0.075, F.concat(F.lit("v1x"), text))
        .when(F.col("l_discount") > 0.05, F.concat(F.translate(text, ".", ","), F.lit("0 pcs")))
        .otherwise(text)
    )
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        nz.norm_quantity(spelled).alias("n_quantity"),
    )


_ORDER_FIELDS = f"""
    strftime(o_orderdate, '%Y-%m-%d') AS n_date,
    'CUSTOMER ' || o_custkey AS n_description,
    CAST(o_custkey % 500 + 1 AS VARCHAR) AS n_quantity,
    {_PLAIN} AS n_amount,
    'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS n_reference
"""


@query(
    "normalize_field",
    f"""SELECT o_orderkey AS ordinal, {_ORDER_FIELDS}, '' AS n_account,
        '2-HIGH' = o_orderpriority AS is_high
    FROM orders""",
)
def normalize_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = order_statements(spark, sf_dir)
    order = F.when(F.col("source") == "2-HIGH", nz.MONTH_FIRST).otherwise(nz.DAY_FIRST)
    return records.select(
        "ordinal",
        *[nz.canonical(FIELD_KINDS.get(f, "text"), f, order).alias(f"n_{f}") for f in KNOWN_FIELDS],
        (F.col("source") == "2-HIGH").alias("is_high"),
    )


@query(
    "normalized_value",
    """SELECT o_orderpriority AS source, o_orderkey AS ordinal,
        strftime(o_orderdate, '%Y-%m-%d') AS n_date
    FROM orders""",
)
def read_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates read the way their own source writes them (one source puts the month first)."""
    records = with_source_rules(order_statements(spark, sf_dir), ORDERS, "date_order")
    return records.select("source", "ordinal", normalized_value("date").alias("n_date"))


@query(
    "mask_shape",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '\p{Nd}', '9', 'g'),
        '\p{Lu}', 'A', 'g'), '\p{Ll}', 'a', 'g') AS shape FROM pages""",
)
def mask_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", nz.mask_shape("url").alias("shape"))


@query(
    "composite_key",
    """SELECT side, l_returnflag AS source, l_orderkey * 8 + l_linenumber AS ordinal, l_partkey,
        CASE l_returnflag
            WHEN 'A' THEN status || ' | ' || quantity
            WHEN 'N' THEN quantity || ' | ' || status
            ELSE strftime(l_shipdate, '%Y-%m-%d') || ' | ' || status || ' | '
                 || rtrim(rtrim(printf('%.2f', l_extendedprice), '0'), '.') || ' | ' || quantity
        END AS pair_key
    FROM (
        SELECT *, 'document' AS side, 'STATUS ' || l_linestatus AS status,
            CAST(CAST(l_quantity AS INT) AS VARCHAR) AS quantity FROM lineitem
        UNION ALL
        SELECT *, 'spreadsheet', 'STATUS ' || l_linestatus,
            CAST(CAST(l_quantity AS INT) + CASE WHEN l_tax > 0.075 THEN 1 ELSE 0 END AS VARCHAR)
        FROM lineitem)""",
)
def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_records(line_records(spark, sf_dir), LINES, every=False).select(
        "side",
        "source",
        "ordinal",
        F.split("locator", "/")[2].cast("long").alias("l_partkey"),
        F.replace("pair_key", F.lit(nz.KEY_SEPARATOR), F.lit(" | ")).alias("pair_key"),
    )


@query(
    "safe_filename",
    rf"""SELECT kind, id, CASE WHEN name = '' THEN 'attachment' ELSE name END AS name FROM (
        SELECT kind, id, trim(regexp_replace(
            regexp_replace(raw, '^{_SPACE}+|{_SPACE}+$', '', 'g'),
            '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '. ') AS name
        FROM (SELECT 'url' AS kind, page_id AS id, url AS raw FROM pages
              UNION ALL SELECT 'text', doc_id, text FROM documents))""",
)
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select(
        F.lit("url").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("raw")
    )
    texts = table(spark, sf_dir, "documents").select(
        F.lit("text").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("raw")
    )
    return urls.unionByName(texts).select("kind", "id", safe_filename(F.col("raw")).alias("name"))


@query(
    "side_label",
    """SELECT o_orderpriority AS source, count(*) AS orders,
        CASE o_orderpriority[1] WHEN '1' THEN 'statement 1' WHEN '4' THEN 'bank 4'
             WHEN '5' THEN 'slip 5' ELSE 'document' END AS document,
        CASE o_orderpriority[1] WHEN '2' THEN 'ledger 2' WHEN '4' THEN 'book 4'
             ELSE 'spreadsheet' END AS spreadsheet
    FROM orders GROUP BY ALL""",
)
def labels_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("source"))
        .agg(F.count("*").alias("orders"))
    )
    rules = with_source_rules(
        counted, DIFFERING_SOURCES, "label_document", "label_spreadsheet"
    )
    return rules.select(
        "source",
        "orders",
        side_label(DOCUMENT).alias("document"),
        side_label(SPREADSHEET).alias("spreadsheet"),
    )


@query(
    "locator",
    """SELECT o_orderkey AS ordinal,
        'page ' || (o_orderkey // 64 + 1) || ', line ' || (o_orderkey % 64 + 1) AS in_document,
        'row ' || (o_orderkey + 2) AS in_spreadsheet
    FROM orders""",
)
def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("ordinal"),
        document_locator(F.shiftright(key, 6) + 1, key % 64 + 1).alias("in_document"),
        row_locator(key + 2).alias("in_spreadsheet"),
    )


@query(
    "file_kind",
    """SELECT source, run_date, filename, count(*) AS files,
        CASE WHEN lower(filename) LIKE '%.pdf' THEN 'document'
             WHEN lower(filename) LIKE '%.csv' OR lower(filename) LIKE '%.xlsx' THEN 'data'
             ELSE 'other' END AS kind
    FROM (
        SELECT event_type AS source, CAST(ts AS DATE) + CAST(user_id AS INT) AS run_date,
            CASE WHEN value < 4 THEN 'statement.pdf' WHEN value < 9 THEN 'Export.CSV'
                 WHEN value < 12 THEN 'records.xlsx'
                 WHEN value < 14 THEN 'reconciliation_report.xlsx'
                 WHEN value < 20 THEN 'scan-' || event_id || '.PDF'
                 ELSE 'note-' || event_id || '.txt' END AS filename
        FROM events)
    GROUP BY source, run_date, filename""",
)
def kinds_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = (
        event_arrivals(spark, sf_dir)
        .groupBy("source", "run_date", "filename")
        .agg(F.count("*").alias("files"))
    )
    return counted.withColumn(
        "kind", file_kind(F.col("filename"), EVENT_FILES.data_extensions)
    )


@query(
    "run_path",
    """SELECT DISTINCT o_orderpriority AS source, CAST(o_orderdate AS DATE) AS run_date,
        '/statements/' || o_orderpriority || '/' || o_orderpriority || ' '
            || strftime(o_orderdate, '%Y.%m.%d') AS folder
    FROM orders""",
)
def run_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = order_records(spark, sf_dir).select("source", "run_date").distinct()
    return runs.withColumn("folder", ORDERS.run_path("source", "run_date"))
