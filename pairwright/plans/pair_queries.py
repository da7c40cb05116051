"""Queries that pair the two sides and report what the pairs say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.normalize import KEY_SEPARATOR
from pairwright.operators import pairing as pg
from pairwright.operators import runs as rn
from pairwright.plans.derived_inputs import (
    LINE_IDS,
    LINES,
    ORDERS,
    line_id_records,
    line_records,
    order_records,
)
from pairwright.plans.registry import query
from pairwright.session import materialize
from pairwright.specs import DOCUMENT, KNOWN_FIELDS, SPREADSHEET

# --------------------------------------------------------------------------------------------
# the same pairing in SQL, from the typed columns
# --------------------------------------------------------------------------------------------


def order_sides_sql(yearly: bool = False) -> str:
    """Both sides of the orders as ``doc`` and ``sheet``."""
    day = "CAST(date_trunc('year', o_orderdate) AS DATE)" if yearly else "CAST(o_orderdate AS DATE)"
    return f"""
    o AS (
        SELECT o_orderpriority AS source, {day} AS run_date, o_orderkey AS ordinal,
            o_custkey AS customer, o_orderstatus AS status, o_totalprice AS price,
            'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS ref,
            CASE WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%m/%d/%Y')
                 ELSE strftime(o_orderdate, '%d-%b-%Y') END AS doc_date,
            strftime(o_orderdate, '%Y-%m-%d') AS iso_date,
            CAST(o_custkey % 500 + 1 AS VARCHAR) AS quantity,
            o_orderstatus = 'P' AND month(o_orderdate) = 2 AS described
        FROM orders),
    doc AS (
        SELECT source, run_date, ref AS pair_key, ordinal, 'line ' || ordinal AS locator,
            doc_date AS date, '  Customer   ' || customer AS description, quantity || '.0' AS quantity,
            format('{{:,.2f}}', price) AS amount, ref AS reference, price, described
        FROM o),
    sheet AS (
        SELECT source, run_date,
            CASE WHEN price < 10000 THEN '' WHEN price < 20000 THEN ref || '-B' ELSE ref END
                AS pair_key,
            ordinal, 'row ' || (ordinal + 2) AS locator, iso_date AS date,
            'CUSTOMER ' || customer || CASE WHEN described THEN ' pending' ELSE '' END
                AS description,
            quantity, printf('%.2f', price + CASE WHEN price > 490000 THEN 90 ELSE 0 END) AS amount,
            CASE WHEN price < 10000 THEN ''
                 WHEN price < 20000 THEN lower(ref) || '-b' ELSE lower(ref) END AS reference,
            price
        FROM o)"""


def order_pairs_sql(yearly: bool = False, body: str = "") -> str:
    """Order pairs: references are unique, so an ordinary full join pairs them."""
    return f"""
    WITH {order_sides_sql(yearly)},
    pairs AS (
        SELECT coalesce(d.source, s.source) AS source, coalesce(d.run_date, s.run_date) AS run_date,
            coalesce(d.pair_key, s.pair_key) AS pair_key,
            d.ordinal AS d_ordinal, s.ordinal AS s_ordinal,
            d.locator AS d_locator, s.locator AS s_locator,
            d.date AS d_date, d.description AS d_description, d.quantity AS d_quantity,
            d.amount AS d_amount, d.reference AS d_reference,
            s.date AS s_date, s.description AS s_description, s.quantity AS s_quantity,
            s.amount AS s_amount, s.reference AS s_reference,
            coalesce(d.described, false) AND s.ordinal IS NOT NULL AS description_differs,
            d.price > 490000 AND s.ordinal IS NOT NULL AS amount_differs,
            CASE WHEN d.ordinal IS NULL OR s.ordinal IS NULL THEN 'one_sided'
                 WHEN d.described OR d.price > 490000 THEN 'differing' ELSE 'matched' END AS outcome
        FROM doc d FULL JOIN sheet s
            ON d.source = s.source AND d.run_date = s.run_date AND d.pair_key = s.pair_key)
    {body}"""


def line_pairs_sql(by_id: bool = False, body: str = "") -> str:
    """Line item pairs: the n-th of a key on one side goes with the n-th on the other."""
    key = """CASE l_returnflag
            WHEN 'A' THEN status || ' | ' || quantity
            WHEN 'N' THEN quantity || ' | ' || status
            ELSE strftime(l_shipdate, '%Y-%m-%d') || ' | ' || status || ' | '
                 || rtrim(rtrim(printf('%.2f', l_extendedprice), '0'), '.') || ' | ' || quantity
        END"""
    if by_id:
        key = "l_orderkey || '-' || l_linenumber"
    return f"""
    WITH items AS (
        SELECT *, 'STATUS ' || l_linestatus AS status, CAST(l_quantity AS INT) AS units,
            CAST(date_trunc('year', l_shipdate) AS DATE) AS run_date, l_returnflag AS source,
            l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS locator,
            l_orderkey * 8 + l_linenumber AS ordinal
        FROM lineitem),
    two_sides AS (
        SELECT *, 'document' AS side, CAST(units AS VARCHAR) AS quantity FROM items
        UNION ALL
        SELECT *, 'spreadsheet', CAST(units + CASE WHEN l_tax > 0.075 THEN 1 ELSE 0 END AS VARCHAR)
        FROM items),
    keyed AS (SELECT *, {key} AS pair_key FROM two_sides),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY source, run_date, side, pair_key
                                     ORDER BY ordinal, locator) AS n FROM keyed),
    pairs AS (
        SELECT coalesce(d.source, s.source) AS source, coalesce(d.run_date, s.run_date) AS run_date,
            coalesce(d.pair_key, s.pair_key) AS pair_key, coalesce(d.n, s.n) AS n,
            d.locator AS d_locator, s.locator AS s_locator,
            d.ordinal AS d_ordinal, s.ordinal AS s_ordinal,
            d.units AS d_units, s.quantity AS s_quantity,
            d.l_shipdate AS d_date, s.l_shipdate AS s_date,
            d.l_extendedprice AS d_price, s.l_extendedprice AS s_price,
            d.status AS d_status, s.status AS s_status, d.quantity AS d_quantity,
            d.locator IS NOT NULL AND s.locator IS NOT NULL AS paired
        FROM (SELECT * FROM numbered WHERE side = 'document') d
        FULL JOIN (SELECT * FROM numbered WHERE side = 'spreadsheet') s
            ON d.source = s.source AND d.run_date = s.run_date AND d.pair_key = s.pair_key
            AND d.n = s.n)
    {body}"""


def _shown_key() -> Column:
    return F.replace("pair_key", F.lit(KEY_SEPARATOR), F.lit(" | ")).alias("pair_key")


def order_pairs(
    spark: SparkSession, sf_dir: str, yearly: bool = False, carry: Sequence[str] | None = None
) -> DataFrame:
    normalised = pg.normalize_records(order_records(spark, sf_dir, yearly), ORDERS)
    return pg.pair_records(normalised, ORDERS, carry=carry)


def line_pairs(spark: SparkSession, sf_dir: str, carry: Sequence[str]) -> DataFrame:
    normalised = pg.normalize_records(line_records(spark, sf_dir), LINES, every=False)
    return pg.pair_records(normalised, LINES, carry=carry)


def line_id_pairs(spark: SparkSession, sf_dir: str, carry: Sequence[str]) -> DataFrame:
    normalised = pg.normalize_records(line_id_records(spark, sf_dir), LINE_IDS, every=False)
    return pg.pair_records(normalised, LINE_IDS, carry=carry)


# --------------------------------------------------------------------------------------------
# pairing
# --------------------------------------------------------------------------------------------


@query(
    "reconcile_by_id",
    order_pairs_sql(body="""
    SELECT source, run_date, pair_key, outcome, d_locator AS document_locator,
        s_locator AS spreadsheet_locator FROM pairs"""),
)
def reconcile_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_pairs(spark, sf_dir, carry=()).select(
        *pg.RUN,
        "pair_key",
        "outcome",
        F.col("document.locator").alias("document_locator"),
        F.col("spreadsheet.locator").alias("spreadsheet_locator"),
    )


def keyed_lines_sql(units: str) -> str:
    """Line items of one side with their key and its occurrence number, and nothing else."""
    return f"""
        SELECT source, run_date, locator, pair_key,
            row_number() OVER (PARTITION BY source, run_date, pair_key ORDER BY ordinal, locator) AS n
        FROM (
            SELECT l_returnflag AS source, CAST(date_trunc('year', l_shipdate) AS DATE) AS run_date,
                concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS locator,
                l_orderkey * 8 + l_linenumber AS ordinal,
                CASE l_returnflag
                    WHEN 'A' THEN concat('STATUS ', l_linestatus, ' | ', {units})
                    WHEN 'N' THEN concat({units}, ' | STATUS ', l_linestatus)
                    ELSE concat(strftime(l_shipdate, '%Y-%m-%d'), ' | STATUS ', l_linestatus, ' | ',
                        rtrim(rtrim(printf('%.2f', l_extendedprice), '0'), '.'), ' | ', {units})
                END AS pair_key
            FROM lineitem)"""


@query(
    "reconcile_by_key",
    f"""
    SELECT source, run_date, pair_key, n,
        CASE WHEN d.locator IS NULL OR s.locator IS NULL THEN 'one_sided' ELSE 'matched' END
            AS outcome,
        d.locator AS document_locator, s.locator AS spreadsheet_locator
    FROM ({keyed_lines_sql("CAST(l_quantity AS INT)")}) d
    FULL JOIN ({keyed_lines_sql("CAST(l_quantity AS INT) + (l_tax > 0.075)::INT")}) s
        USING (source, run_date, pair_key, n)""",
)
def reconcile_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_pairs(spark, sf_dir, carry=()).select(
        *pg.RUN,
        _shown_key(),
        "n",
        "outcome",
        F.col("document.locator").alias("document_locator"),
        F.col("spreadsheet.locator").alias("spreadsheet_locator"),
    )


@query(
    "occurrence_number",
    line_pairs_sql(body="""
    SELECT source, run_date, side, pair_key, locator, n FROM numbered"""),
)
def occurrence_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = pg.number_occurrences(
        pg.normalize_records(line_records(spark, sf_dir), LINES, every=False), config=LINES
    )
    return numbered.select(*pg.RUN, "side", _shown_key(), "locator", "n")


@query(
    "merge_specs",
    """SELECT o_orderpriority AS source, o_orderkey AS ordinal, true AS by_id,
        'reference' AS pair_on,
        CASE WHEN o_orderpriority = '2-HIGH' THEN 'month_first' ELSE 'day_first' END AS date_order
    FROM orders""",
)
def merge_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairwright.plans.derived_inputs import order_statements

    return pg.with_source_rules(
        order_statements(spark, sf_dir), ORDERS, "by_id", "pair_on", "date_order"
    ).select("source", "ordinal", "by_id", "pair_on", "date_order")


_ONE_SIDED_SQL = """
    SELECT source, run_date, pair_key, side,
        CASE WHEN side = 'document' THEN document ELSE 'spreadsheet' END AS present_in,
        CASE WHEN side = 'document' THEN 'spreadsheet' ELSE document END AS missing_from,
        locator, date, description, quantity, amount, reference, '' AS account
    FROM (
        SELECT source, run_date, pair_key,
            CASE WHEN d_ordinal IS NOT NULL THEN 'document' ELSE 'spreadsheet' END AS side,
            CASE WHEN source[1] IN ('1', '3') THEN 'statement ' || source[1] ELSE 'document' END
                AS document,
            coalesce(d_locator, s_locator) AS locator, coalesce(d_date, s_date) AS date,
            coalesce(d_description, s_description) AS description,
            coalesce(d_quantity, s_quantity) AS quantity, coalesce(d_amount, s_amount) AS amount,
            coalesce(d_reference, s_reference) AS reference
        FROM pairs WHERE outcome = 'one_sided')"""


@query("one_sided", order_pairs_sql(body=_ONE_SIDED_SQL))
def one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.one_sided(order_pairs(spark, sf_dir), ORDERS).drop("n", "by_id", "ordinal")


@query(
    "union_one_sided",
    order_pairs_sql(yearly=True, body="""
    SELECT source, run_date, 'document' AS side, d_locator AS locator FROM pairs
    WHERE s_ordinal IS NULL
    UNION ALL
    SELECT source, run_date, 'spreadsheet', s_locator FROM pairs WHERE d_ordinal IS NULL"""),
)
def union_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leftovers of the two sides together, in one pass over the pairs."""
    records = pg.records_for_side(order_pairs(spark, sf_dir, yearly=True))
    return records.filter(F.col("outcome") == pg.ONE_SIDED).select(*pg.RUN, "side", "locator")


@query(
    "sort_unmatched",
    line_pairs_sql(body="""
    , firsts AS (SELECT source, run_date, pair_key, min(ordinal) AS first_seen FROM keyed
                 WHERE side = 'spreadsheet' GROUP BY ALL)
    SELECT p.source, p.run_date, coalesce(d_locator, s_locator) AS locator,
        CASE WHEN d_locator IS NOT NULL THEN 1 ELSE 2 END AS group_pos,
        CASE WHEN d_locator IS NULL THEN f.first_seen END AS first_seen,
        coalesce(d_ordinal, s_ordinal) AS ordinal
    FROM pairs p LEFT JOIN firsts f USING (source, run_date, pair_key) WHERE NOT paired"""),
)
def sort_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = materialize(line_pairs(spark, sf_dir, carry=()), "pairs")
    return pg.order_one_sided(pg.one_sided(pairs, LINES), pairs).select(
        *pg.RUN, "locator", "group_pos", "first_seen", "ordinal"
    )


# --------------------------------------------------------------------------------------------
# differences
# --------------------------------------------------------------------------------------------


_COMPARED_SQL = f"""
    WITH {order_sides_sql()}
    SELECT source, ordinal, concat_ws('; ',
        CASE WHEN source[1] NOT IN ('4') THEN 'date=' || date END,
        CASE WHEN source[1] IN ('1', '2', '5') THEN 'description=' || description END,
        CASE WHEN source[1] IN ('1', '4', '5') THEN 'quantity=' || quantity END,
        CASE WHEN source[1] NOT IN ('5') THEN 'amount=' || amount END,
        CASE WHEN source[1] = '5' THEN 'reference=' || reference END) AS compared
    FROM doc"""


@query("project_compare_fields", _COMPARED_SQL)
def project_compare_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is compared of each statement line; every source compares other fields."""
    from pairwright.plans.derived_inputs import DIFFERING_SOURCES, order_statements

    rows = pg.with_source_rules(
        order_statements(spark, sf_dir), DIFFERING_SOURCES, "compare_fields"
    )
    values = F.array(
        *[
            F.when(
                F.array_contains("compare_fields", f), F.concat(F.lit(f"{f}="), pg.display(f))
            )
            for f in KNOWN_FIELDS
        ]
    )
    return rows.select("source", "ordinal", F.array_join(F.array_compact(values), "; ").alias("compared"))


@query(
    "field_differences",
    order_pairs_sql(body="""
    SELECT source, run_date, pair_key, concat_ws('; ',
        CASE WHEN description_differs
             THEN 'description: ' || d_description || ' / ' || s_description END,
        CASE WHEN amount_differs THEN 'amount: ' || d_amount || ' / ' || s_amount END)
        AS differences
    FROM pairs WHERE outcome <> 'one_sided'"""),
)
def field_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with what it disagrees on; blank where it agrees."""
    shown = F.transform(
        "differences",
        lambda d: F.concat(
            d["field"], F.lit(": "), d["document_value"], F.lit(" / "), d["spreadsheet_value"]
        ),
    )
    paired = order_pairs(spark, sf_dir).filter(F.col("outcome") != pg.ONE_SIDED)
    return paired.select(*pg.RUN, "pair_key", F.array_join(shown, "; ").alias("differences"))


@query(
    "differences_worklist",
    order_pairs_sql(body="""
    SELECT source, run_date, pair_key AS identifier, 'description' AS field,
        d_description AS document_value, s_description AS spreadsheet_value,
        d_locator AS document_locator, s_locator AS spreadsheet_locator
    FROM pairs WHERE description_differs
    UNION ALL
    SELECT source, run_date, pair_key, 'amount', d_amount, s_amount, d_locator, s_locator
    FROM pairs WHERE amount_differs"""),
)
def differences_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.differences_worklist(order_pairs(spark, sf_dir))


@query(
    "matched_pairs",
    order_pairs_sql(body="""
    SELECT source, run_date, d_locator AS document_locator, s_locator AS spreadsheet_locator,
        d_date AS date, d_description AS description, d_quantity AS quantity, d_amount AS amount,
        d_reference AS reference, '' AS account
    FROM pairs WHERE outcome = 'matched'"""),
)
def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.matched_pairs(order_pairs(spark, sf_dir))


@query(
    "display_values",
    order_pairs_sql(body="""
    SELECT 'document' AS side, ordinal, date, description, quantity, amount, reference,
        '' AS account FROM doc
    UNION ALL
    SELECT 'spreadsheet', ordinal, date, description, quantity, amount, reference, '' FROM sheet"""),
)
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_records(spark, sf_dir).select(
        "side", "ordinal", *[pg.display(f).alias(f) for f in KNOWN_FIELDS]
    )


@query(
    "fields_in_play",
    line_pairs_sql(body="""
    SELECT source, run_date, CASE source
        WHEN 'A' THEN 'description,quantity,date,amount'
        WHEN 'N' THEN 'quantity,description,date,amount'
        ELSE 'date,description,amount,quantity' END AS fields
    FROM pairs GROUP BY ALL"""),
)
def fields_in_play(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.fields_in_play(line_pairs(spark, sf_dir, KNOWN_FIELDS), LINES).withColumn(
        "fields", F.array_join("fields", ",")
    )


# --------------------------------------------------------------------------------------------
# counts and totals
# --------------------------------------------------------------------------------------------

_ORDER_COUNTS = """
    count(d_ordinal) AS document_count, count(s_ordinal) AS spreadsheet_count,
    count(*) FILTER (outcome = 'matched') AS matched,
    count(*) FILTER (outcome = 'differing') AS differing,
    count(*) FILTER (outcome = 'one_sided') AS one_sided"""


@query(
    "side_counts",
    line_pairs_sql(body="""
    SELECT source, run_date, count(d_locator) AS document_count,
        count(s_locator) AS spreadsheet_count,
        count(*) FILTER (paired) AS matched, 0 AS differing,
        count(*) FILTER (NOT paired) AS one_sided, 0 AS ambiguous,
        count(DISTINCT pair_key) FILTER (n > 1) AS repeated
    FROM pairs GROUP BY source, run_date"""),
)
def side_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each run of line items, from counts of their keys."""
    normalised = pg.normalize_records(line_records(spark, sf_dir), LINES)
    return rn.side_counts(rn.parts_of_keys(pg.key_counts(normalised)))


@query(
    "records_for_side",
    order_pairs_sql(yearly=True, body="""
    SELECT source, run_date, outcome, d_locator AS locator, d_reference AS reference,
        'document' AS side FROM pairs WHERE d_ordinal IS NOT NULL
    UNION ALL
    SELECT source, run_date, outcome, s_locator, s_reference, 'spreadsheet' FROM pairs
    WHERE s_ordinal IS NOT NULL"""),
)
def records_for_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.records_for_side(order_pairs(spark, sf_dir, yearly=True)).select(
        *pg.RUN, "outcome", "locator", "reference", "side"
    )


@query(
    "side_totals",
    line_pairs_sql(body="""
    , t AS (SELECT source, run_date,
        CAST(sum(CAST(d_price AS DECIMAL(18,2))) AS DOUBLE) AS document_amount,
        CAST(sum(CAST(s_price AS DECIMAL(18,2))) AS DOUBLE) AS spreadsheet_amount,
        CAST(sum(d_units) AS DOUBLE) AS document_quantity,
        CAST(sum(CAST(s_quantity AS INT)) AS DOUBLE) AS spreadsheet_quantity
        FROM pairs GROUP BY source, run_date)
    SELECT *, round(document_amount - spreadsheet_amount, 6) AS amount_difference,
        round(document_quantity - spreadsheet_quantity, 6) AS quantity_difference FROM t"""),
)
def side_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.side_totals(pg.normalize_records(line_records(spark, sf_dir), LINES))


@query(
    "repeated_keys",
    line_pairs_sql(body="""
    , c AS (SELECT source, run_date, pair_key,
            count(*) FILTER (side = 'document') AS d, count(*) FILTER (side = 'spreadsheet') AS s
        FROM keyed GROUP BY ALL)
    SELECT source, run_date, CASE WHEN s > 1 THEN s ELSE d END AS occurrences,
        pair_key || ' (x' || CASE WHEN s > 1 THEN s ELSE d END || ')' AS shown
    FROM c WHERE s > 1 OR d > 1"""),
)
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    normalised = pg.normalize_records(line_records(spark, sf_dir), LINES)
    return pg.repeated_keys(normalised).drop("pair_key")


@query(
    "ambiguous_ids",
    line_pairs_sql(by_id=True, body="""
    SELECT DISTINCT source, run_date, pair_key AS identifier FROM (
        SELECT source, run_date, side, pair_key FROM keyed GROUP BY ALL HAVING count(*) > 1)"""),
)
def ambiguous_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.ambiguous_ids(line_id_pairs(spark, sf_dir, carry=()))


@query(
    "union_ambiguous",
    line_pairs_sql(by_id=True, body="""
    SELECT source, run_date, pair_key AS identifier FROM keyed WHERE side = 'document'
    GROUP BY ALL HAVING count(*) > 1
    UNION
    SELECT source, run_date, pair_key FROM keyed WHERE side = 'spreadsheet'
    GROUP BY ALL HAVING count(*) > 1"""),
)
def union_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers repeated on one side together with those repeated on the other."""
    normalised = pg.normalize_records(line_id_records(spark, sf_dir), LINE_IDS)

    def repeated(side: str) -> DataFrame:
        return (
            normalised.filter((F.col("side") == side) & ~F.col("unidentified"))
            .groupBy(*pg.RUN, F.col("pair_key").alias("identifier"))
            .agg(F.count("*").alias("c"))
            .filter("c > 1")
            .drop("c")
        )

    return repeated(DOCUMENT).union(repeated(SPREADSHEET)).distinct()


def _runs(records: DataFrame) -> DataFrame:
    return records.select(*pg.RUN).distinct()


_REASON = """concat_ws(', ',
        CASE WHEN differing > 0 THEN differing || ' differing' END,
        CASE WHEN one_sided > 0 THEN one_sided || ' one-sided' END)"""


@query(
    "run_verdict",
    order_pairs_sql(body=f"""
    , c AS (SELECT source, run_date, {_ORDER_COUNTS} FROM pairs GROUP BY source, run_date)
    SELECT *, CASE WHEN differing = 0 AND one_sided = 0 THEN 'FULLY RECONCILED'
                   ELSE 'DIFFERENCES FOUND' END AS verdict, {_REASON} AS reason FROM c"""),
)
def run_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = order_records(spark, sf_dir)
    results = rn.run_results(_runs(records), order_pairs(spark, sf_dir, carry=()), ORDERS)
    return results.select(
        *pg.RUN, "document_count", "spreadsheet_count", "matched", "differing", "one_sided",
        "verdict", "reason",
    )


@query(
    "run_verdict_by_key",
    line_pairs_sql(body="""
    , c AS (SELECT source, run_date, count(d_locator) AS document_count,
            count(s_locator) AS spreadsheet_count, count(*) FILTER (paired) AS matched,
            count(*) FILTER (NOT paired) AS one_sided, count(DISTINCT pair_key) FILTER (n > 1)
                AS repeated
        FROM pairs GROUP BY source, run_date)
    SELECT *, CASE WHEN one_sided = 0 THEN 'FULLY RECONCILED' ELSE 'DIFFERENCES FOUND' END AS verdict,
        CASE WHEN one_sided > 0 THEN one_sided || ' one-sided' ELSE '' END AS reason FROM c"""),
)
def run_verdict_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of runs whose records are recognised by their own values: nothing is paired."""
    records = line_records(spark, sf_dir)
    normalised = pg.normalize_records(records, LINES)
    results = rn.run_results_by_key(_runs(records), normalised, LINES)
    return results.select(
        *pg.RUN, "document_count", "spreadsheet_count", "matched", "one_sided", "repeated",
        "verdict", "reason",
    )


@query(
    "run_reason",
    line_pairs_sql(by_id=True, body="""
    , a AS (SELECT source, run_date, count(DISTINCT pair_key) FILTER (n > 1) AS ambiguous,
            count(*) FILTER (NOT paired) AS one_sided,
            count(*) FILTER (paired AND (d_date <> s_date OR d_status <> s_status
                             OR d_price <> s_price OR d_quantity <> s_quantity)) AS differing
        FROM pairs GROUP BY source, run_date)
    SELECT source, run_date, concat_ws(', ',
        CASE WHEN differing > 0 THEN differing || ' differing' END,
        CASE WHEN one_sided > 0 THEN one_sided || ' one-sided' END,
        CASE WHEN ambiguous > 0 THEN ambiguous || ' ambiguous id(s)' END) AS reason FROM a"""),
)
def run_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = line_id_records(spark, sf_dir)
    results = rn.run_results(_runs(records), line_id_pairs(spark, sf_dir, carry=()), LINE_IDS)
    return results.select(*pg.RUN, "reason")


@query(
    "nothing_read_warning",
    """SELECT o_orderpriority AS source, CAST(o_orderdate AS DATE) AS run_date,
        count(*) FILTER (o_orderstatus = 'O') AS document_count,
        count(*) FILTER (o_orderstatus = 'O') = 0 AS nothing_read,
        CASE WHEN count(*) FILTER (o_orderstatus = 'O') = 0
             THEN 'nothing read from document, ' || count(*) || ' one-sided'
             WHEN count(*) FILTER (o_orderstatus <> 'O') > 0
             THEN count(*) FILTER (o_orderstatus <> 'O') || ' one-sided' ELSE '' END AS reason
    FROM orders GROUP BY ALL""",
)
def nothing_read_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day judged; on some not one order is in the state the statement lists.

    The export lists all orders, the statement open ones only.
    """
    from pairwright.plans.derived_inputs import table

    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("source"),
        F.to_date("o_orderdate").alias("run_date"),
        F.col("o_orderkey").alias("ordinal"),
        F.col("o_orderkey").cast("string").alias("locator"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
    )
    values = {"reference": F.col("locator"), "amount": F.col("price")}
    records = pg.as_records(
        orders.filter("status = 'O'"), DOCUMENT, **values
    ).unionByName(pg.as_records(orders, SPREADSHEET, **values))
    pairs = pg.pair_records(pg.normalize_records(records, ORDERS), ORDERS)
    results = rn.run_results(_runs(records), pairs, ORDERS)
    return results.select(
        *pg.RUN, "document_count", F.col("warning").isNotNull().alias("nothing_read"), "reason"
    )


@query(
    "run_summary",
    line_pairs_sql(body="""
    , t AS (SELECT source, run_date,
        count(d_locator) AS documents, count(s_locator) AS sheets,
        count(*) FILTER (paired) AS matched, count(*) FILTER (NOT paired) AS one_sided,
        count(DISTINCT pair_key) FILTER (n > 1) AS repeated,
        CAST(sum(CAST(d_price AS DECIMAL(18,2))) AS DOUBLE) AS d_amount,
        CAST(sum(CAST(s_price AS DECIMAL(18,2))) AS DOUBLE) AS s_amount,
        CAST(sum(d_units) AS DOUBLE) AS d_units,
        CAST(sum(CAST(s_quantity AS INT)) AS DOUBLE) AS s_units
        FROM pairs GROUP BY source, run_date)
    SELECT source, run_date, l.measure AS measure, l.side AS side, l.value AS value FROM (
        SELECT source, run_date, repeated, unnest([
            {'measure': 'folder', 'side': NULL, 'value': '/statements/' || source || '/' || source
                || ' ' || strftime(run_date, '%Y.%m.%d')},
            {'measure': 'pairing', 'side': NULL, 'value': 'composite key: ' || CASE source
                WHEN 'A' THEN 'description + quantity' WHEN 'N' THEN 'quantity + description'
                ELSE 'date + description + amount + quantity' END},
            {'measure': 'records', 'side': 'document', 'value': CAST(documents AS VARCHAR)},
            {'measure': 'records', 'side': 'spreadsheet', 'value': CAST(sheets AS VARCHAR)},
            {'measure': 'matched', 'side': NULL, 'value': CAST(matched AS VARCHAR)},
            {'measure': 'one_sided', 'side': NULL, 'value': CAST(one_sided AS VARCHAR)},
            {'measure': 'unread', 'side': NULL, 'value': '0'},
            {'measure': 'repeated_keys', 'side': NULL, 'value': CAST(repeated AS VARCHAR)},
            {'measure': 'total_amount', 'side': 'document', 'value': printf('%.2f', d_amount)},
            {'measure': 'total_amount', 'side': 'spreadsheet', 'value': printf('%.2f', s_amount)},
            {'measure': 'excess_amount', 'side': NULL, 'value': printf('%.2f', d_amount - s_amount)},
            {'measure': 'total_quantity', 'side': 'document', 'value': printf('%.2f', d_units)},
            {'measure': 'total_quantity', 'side': 'spreadsheet', 'value': printf('%.2f', s_units)},
            {'measure': 'excess_quantity', 'side': NULL, 'value': printf('%.2f', d_units - s_units)},
            {'measure': 'verdict', 'side': NULL, 'value': CASE WHEN one_sided = 0
                THEN 'FULLY RECONCILED' ELSE 'DIFFERENCES FOUND' END}]) AS l FROM t)
    WHERE (l.measure NOT IN ('total_amount', 'excess_amount') OR source = 'R')
        AND (l.measure <> 'repeated_keys' OR repeated > 0)"""),
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals are shown with two decimals here, so that both engines print them alike."""
    records = line_records(spark, sf_dir)
    # read by the counts, the totals and the list of ambiguous identifiers
    normalised = materialize(pg.normalize_records(records, LINES), "records")
    results = rn.run_results_by_key(_runs(records), normalised, LINES)
    measures = rn.run_summary(results, normalised, LINES)
    total = F.col("measure").rlike("^(total|excess)_")
    return measures.withColumn(
        "value",
        F.when(total, F.format_string("%.2f", F.when(total, F.col("value")).cast("double")))
        .otherwise(F.col("value")),
    )
