"""Two-sided inputs derived from the benchmark tables, whole tables at a time.

Each function renders rows of a table the way a statement or an export would write them. Where the
two sides should disagree, the disagreement follows from the row's own values; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.pairing import as_records
from pairwright.specs import DOCUMENT, SPREADSHEET, Config, Source

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

_COLUMNS = {"reference": 54.0, "date": 148.0, "description": 232.0, "quantity": 372.0,
            "amount": 452.0}
_ALIASES = {
    "reference": ("Voucher", "Vch"),
    "date": ("Booked", "Value Day"),
    "description": ("Wording", "Text"),
    "quantity": ("Pieces", "Pcs"),
    "amount": ("Sum", "Total"),
}

#: Orders: one source per priority, paired by reference.
ORDERS = Config(
    sources=[
        Source(
            name=name,
            columns=_COLUMNS,
            aliases=_ALIASES,
            match_on="reference",
            start_markers=("Booked Entries",),
            stop_markers=("Sum carried over",),
            skip_markers=("Sheet ",),
            labels={DOCUMENT: f"statement {name[0]}"} if name[0] in "13" else {},
            date_order="month_first" if name[0] == "2" else "day_first",
        )
        for name in PRIORITIES
    ],
)

#: The same orders, with sources that carry, compare and call things differently.
DIFFERING_SOURCES = Config(
    sources=[
        Source(
            name=name,
            columns={f: x for f, x in _COLUMNS.items() if f not in absent},
            aliases=_ALIASES,
            match_on=match_on,
            labels=labels,
        )
        for name, absent, match_on, labels in (
            ("1-URGENT", (), "reference", {DOCUMENT: "statement 1"}),
            ("2-HIGH", ("quantity",), "reference", {SPREADSHEET: "ledger 2"}),
            ("3-MEDIUM", ("quantity", "description"), "reference", {}),
            ("4-NOT SPECIFIED", ("date", "description"), "reference",
             {DOCUMENT: "bank 4", SPREADSHEET: "book 4"}),
            ("5-LOW", (), "amount", {DOCUMENT: "slip 5"}),
        )
    ],
)

#: Line items: one source per return flag, recognised only by their own values.
LINES = Config(
    sources=[
        Source(name="A", columns=_COLUMNS, aliases=_ALIASES, match_key=("description", "quantity")),
        Source(name="N", columns=_COLUMNS, aliases=_ALIASES, match_key=("quantity", "description")),
        Source(
            name="R",
            columns=_COLUMNS,
            aliases=_ALIASES,
            match_key=("date", "description", "amount", "quantity"),
        ),
    ],
)


#: Bytes of a table per core from which its row groups are enough for all cores.
SPLIT_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, dealt out first where it is small and has fewer files than cores.

    A file of one row group is one split, and a single task would do all that follows on its rows.
    Larger files have many row groups and are read by all cores as they are, without a shuffle.
    """
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if len(rows.inputFiles()) >= cores:
        return rows
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    large = files.getContentSummary(hadoop).getLength() >= cores * SPLIT_BYTES
    return rows if large else rows.repartition(cores)


def _money(value: Column) -> Column:
    return value.cast("decimal(18,2)").cast("string")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("source"),
        F.to_date("o_orderdate").alias("run_date"),
        F.col("o_orderkey").alias("ordinal"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
    )


def _reference() -> Column:
    return F.concat(F.lit("ord-"), F.lpad(F.col("ordinal").cast("string"), 12, "0"))


def order_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document side: grouped amounts, written-out dates, untidy text."""
    spelled = F.when(
        F.col("source") == "2-HIGH", F.date_format("run_date", "MM/dd/yyyy")
    ).otherwise(F.date_format("run_date", "dd-MMM-yyyy"))
    return as_records(
        _orders(spark, sf_dir).withColumn(
            "locator", F.concat(F.lit("line "), F.col("ordinal").cast("string"))
        ),
        DOCUMENT,
        reference=F.upper(_reference()),
        date=spelled,
        description=F.concat(F.lit("  Customer   "), F.col("customer").cast("string")),
        quantity=F.concat((F.col("customer") % 500 + 1).cast("string"), F.lit(".0")),
        amount=F.format_number("price", 2),
    )


def order_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spreadsheet side: plain numbers and ISO dates, with mistakes in it.

    Cheap orders lack or misspell the reference, dear ones carry a surcharge, and pending orders
    of February are described differently.
    """
    price = F.col("price")
    return as_records(
        _orders(spark, sf_dir).withColumn(
            "locator", F.concat(F.lit("row "), (F.col("ordinal") + 2).cast("string"))
        ),
        SPREADSHEET,
        reference=F.when(price < 10000, F.lit(""))
        .when(price < 20000, F.concat(_reference(), F.lit("-b")))
        .otherwise(_reference()),
        date=F.date_format("run_date", "yyyy-MM-dd"),
        description=F.concat(
            F.lit("CUSTOMER "),
            F.col("customer").cast("string"),
            F.when(
                (F.col("status") == "P") & (F.month("run_date") == 2), F.lit(" pending")
            ).otherwise(F.lit("")),
        ),
        quantity=(F.col("customer") % 500 + 1).cast("string"),
        amount=_money(price + F.when(price > 490000, 90).otherwise(0)),
    )


def order_records(spark: SparkSession, sf_dir: str, yearly: bool = False) -> DataFrame:
    """Both sides of the orders; runs are days or whole years."""
    both = order_statements(spark, sf_dir).unionByName(order_exports(spark, sf_dir))
    return both.withColumn("run_date", F.trunc("run_date", "year")) if yearly else both


#: Line items by their order and line number, an identifier that often repeats.
LINE_IDS = Config(
    sources=[
        Source(name=flag, columns=_COLUMNS, aliases=_ALIASES, match_on="reference")
        for flag in ("A", "N", "R")
    ],
)


def line_id_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of the line items, to be paired by order and line number."""
    return line_records(spark, sf_dir).withColumn(
        "reference", F.concat_ws("-", *[F.split("locator", "/")[i] for i in (0, 1)])
    )


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of the line items, one run per return flag and year.

    Few different keys repeat very often. The export counts one more unit on highly taxed lines.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("source"),
        F.trunc(F.to_date("l_shipdate"), "year").alias("run_date"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"),
        F.concat_ws(
            "/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
        ).alias("locator"),
        F.to_date("l_shipdate").alias("shipped"),
        F.col("l_linestatus").alias("status"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("tax"),
    )
    document = as_records(
        lines,
        DOCUMENT,
        date=F.date_format("shipped", "dd.MM.yyyy"),
        description=F.concat(F.lit("status "), F.col("status")),
        quantity=F.col("quantity"),
        amount=F.concat(F.lit("EUR "), F.format_number("price", 2)),
    )
    spreadsheet = as_records(
        lines,
        SPREADSHEET,
        date=F.date_format("shipped", "yyyy-MM-dd"),
        description=F.concat(F.lit("Status "), F.col("status")),
        quantity=F.concat(
            (F.col("quantity") + F.when(F.col("tax") > 0.075, 1).otherwise(0)).cast("string"),
            F.lit(".0"),
        ),
        amount=_money(F.col("price")),
    )
    return document.unionByName(spreadsheet)


# --------------------------------------------------------------------------------------------
# statements as positioned words
# --------------------------------------------------------------------------------------------

LINES_PER_PAGE_BITS = 6


def order_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders printed as statements: one document per source and year, 64 order lines a page.

    Besides its own line an order may print a marker line below it: the dearest end the section,
    cheap ones (re)start it, some in the middle do both at once, some print a page line to skip and
    pending ones a note that stands left of all columns.
    """
    orders = (
        _orders(spark, sf_dir)
        .withColumn("day", F.col("run_date"))
        .withColumn("run_date", F.trunc("run_date", "year"))
    )
    top = F.lit(40.0) + F.col("ordinal").bitwiseAND(63) * F.lit(11.0)
    price = F.col("price")

    def word(text: Column | str, x0: float, top: Column) -> Column:
        text = F.lit(text) if isinstance(text, str) else text
        return F.struct(text.alias("text"), F.lit(x0).alias("x0"), top.alias("top"))

    def line(when: Column, words: list[Column]) -> Column:
        return F.when(when, F.array(*words)).otherwise(
            F.array().cast("array<struct<text:string,x0:double,top:double>>")
        )

    words = F.concat(
        F.array(
            word(F.date_format(F.col("day"), "yyyy-MM-dd"), 148.4, top + 0.2),
            word(F.upper(_reference()), 54.0, top),
            word(F.format_number("price", 2), 450.5, top + 0.4),
            word("Customer", 232.0, top + 0.1),
            word(F.col("customer").cast("string"), 288.0, top + 0.1),
            word("*", 6.0, top),
        ),
        # every third customer has no quantity: the column must stay empty
        line(
            F.col("customer") % 3 != 0,
            [word((F.col("customer") % 500 + 1).cast("string"), 371.0, top)],
        ),
        line(
            price > 480000,
            [
                word("SUM", 60.0, top + 3),
                word("CARRIED", 80.0, top + 3),
                word("OVER", 95.0, top + 3),
            ],
        ),
        line(
            price < 30000,
            [word("Booked", 60.0, top + 4), word("Entries", 120.0, top + 4)],
        ),
        line(
            (price > 240000) & (price < 250000),
            [
                word("sum", 60.0, top + 5),
                word("carried", 80.0, top + 5),
                word("over,", 100.0, top + 5),
                word("booked", 150.0, top + 5),
                word("entries", 205.0, top + 5),
            ],
        ),
        line(
            (price > 100000) & (price < 120000),
            [word("Sheet", 300.0, top + 6), word("7", 330.0, top + 6)],
        ),
        line(F.col("status") == "P", [word("~", 3.0, top + 7), word("note", 12.0, top + 7)]),
    )
    return orders.select(
        "source",
        "run_date",
        F.concat_ws(" ", "source", F.year("run_date").cast("string")).alias("doc_id"),
        F.shiftright("ordinal", LINES_PER_PAGE_BITS).cast("int").alias("page"),
        F.posexplode(words).alias("pos", "word"),
        "ordinal",
    ).select(
        "source",
        "run_date",
        "doc_id",
        "page",
        (F.col("ordinal") * 64 + F.col("pos")).alias("seq"),
        "word.*",
    )


# --------------------------------------------------------------------------------------------
# exports as files
# --------------------------------------------------------------------------------------------

#: Orders per export file, as a power of two.
FILE_BITS = 20
#: The header each source's exports carry; one of them lacks the amount.
EXPORT_HEADERS = {
    "1-URGENT": "Vch,Value Day,Text,Pcs,Total",
    "2-HIGH": "  voucher ,BOOKED,Wording,Pieces,Sum",
    "3-MEDIUM": "Voucher,Booked,Wording,Pieces,Sum",
    "4-NOT SPECIFIED": "Sum,Voucher,Vch,Booked,sum",
    "5-LOW": "Voucher,Booked,Wording,Pieces,Gross",
}


def write_order_exports(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Write the orders as comma-separated files, one folder per source and year.

    Pending orders carry a line break inside a quoted description, the cheapest are followed by an
    empty line and the dearest by a row of empty cells.
    """
    orders = _orders(spark, sf_dir).withColumn("year", F.trunc("run_date", "year"))
    folder = ["source", "run_date", "part"]
    text = F.concat(
        F.upper(_reference()),
        F.lit(","),
        F.date_format("run_date", "yyyy-MM-dd"),
        F.when(F.col("status") == "P", F.lit(',"customer\n')).otherwise(F.lit(",customer ")),
        F.col("customer").cast("string"),
        F.when(F.col("status") == "P", F.lit(' ""pending""",')).otherwise(F.lit(",")),
        (F.col("customer") % 500 + 1).cast("string"),
        F.lit(","),
        _money(F.col("price")),
        F.when(F.col("price") < 3000, F.lit("\n"))
        .when(F.col("price") > 495000, F.lit("\n,,,,"))
        .otherwise(F.lit("")),
    )
    rows = orders.select(
        "source",
        F.col("year").alias("run_date"),
        F.shiftright("ordinal", FILE_BITS).alias("part"),
        "ordinal",
        text.alias("value"),
    )
    header = F.lit("")
    for name, line in EXPORT_HEADERS.items():
        header = F.when(F.col("source") == name, F.lit(line)).otherwise(header)
    headers = rows.select(*folder).distinct().select(
        *folder, F.lit(-1).cast("long").alias("ordinal"), header.alias("value")
    )
    (
        rows.unionByName(headers)
        .repartition(*folder)
        .sortWithinPartitions(*folder, "ordinal")
        .drop("ordinal")
        .write.partitionBy(*folder)
        .text(root)
    )


# --------------------------------------------------------------------------------------------
# messages and arrivals
# --------------------------------------------------------------------------------------------

#: Documents arriving by mail: three senders, told apart by subject or by file name.
MAIL = Config(
    sources=[
        Source(
            name="NORTH",
            columns=_COLUMNS,
            aliases=_ALIASES,
            match_on="reference",
            subject_all=("Daily", "statement EN"),
        ),
        Source(
            name="SOUTH",
            columns=_COLUMNS,
            aliases=_ALIASES,
            match_on="reference",
            subject_all=("daily", "statement fr"),
            attachment_contains=("es_Report: src1", "src7"),
        ),
        Source(
            name="REST",
            columns=_COLUMNS,
            aliases=_ALIASES,
            match_on="reference",
            attachment_contains=("_report",),
        ),
    ],
)


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a message with three attachments.

    The document itself is the first; documents with the same text are re-sends of each other. The
    second is a small table, the third a logo. Forwarded German messages have lost their file name.
    """
    d = table(spark, sf_dir, "documents")

    def attachment(pos: int, name: Column, size: Column, content: Column) -> Column:
        return F.struct(
            F.lit(pos).alias("pos"),
            name.alias("filename"),
            size.cast("long").alias("size"),
            F.sha2(content, 256).alias("content_hash"),
        )

    report = F.when(F.col("lang") == "de", F.lit("scan.pdf")).otherwise(
        F.concat("lang", F.lit("_report: "), "source", F.lit(".pdf"))
    )
    return d.select(
        F.col("doc_id").alias("msg_id"),
        F.concat(F.lit("Daily STATEMENT "), "lang", F.lit(" from "), "source").alias("subject"),
        # an hour apart, over and over through January 2026
        (
            F.lit("2026-01-01 08:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), (F.col("doc_id") % 720).cast("int"))
        ).alias("received"),
        F.array(
            attachment(0, report, F.col("n_chars") * 16, F.col("text")),
            attachment(1, F.lit("data.csv"), F.lit(50), F.concat("lang", "source")),
            attachment(2, F.lit("logo.png"), F.lit(300), F.lit("logo")),
        ).alias("attachments"),
    )


#: Files announced by the event stream, one source per event type.
EVENT_FILES = Config(
    sources=[
        Source(name=n, columns=_COLUMNS, aliases=_ALIASES, match_on="reference")
        for n in ("signup", "error", "view", "click", "purchase")
    ],
)


def event_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a file that arrived in a run folder, about two files per folder."""
    e = table(spark, sf_dir, "events")
    name = (
        F.when(F.col("value") < 4, F.lit("statement.pdf"))
        .when(F.col("value") < 9, F.lit("Export.CSV"))
        .when(F.col("value") < 12, F.lit("records.xlsx"))
        .when(F.col("value") < 14, F.lit("reconciliation_report.xlsx"))
        .when(F.col("value") < 20, F.concat(F.lit("scan-"), F.col("event_id"), F.lit(".PDF")))
        .otherwise(F.concat(F.lit("note-"), F.col("event_id"), F.lit(".txt")))
    )
    return e.select(
        F.col("event_type").alias("source"),
        F.date_add(F.to_date("ts"), F.col("user_id").cast("int")).alias("run_date"),
        name.alias("filename"),
    )


def order_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the yearly order runs: years of some sources lack a side or have one twice."""
    runs = (
        _orders(spark, sf_dir)
        .select("source", F.trunc("run_date", "year").alias("run_date"))
        .distinct()
    )
    year = F.year("run_date")
    files = F.array_compact(
        F.array(
            F.when(~((F.col("source") == "5-LOW") & (year == 1996)), F.lit("statement.pdf")),
            F.when(~((F.col("source") == "1-URGENT") & (year == 1997)), F.lit("export.csv")),
            F.when((F.col("source") == "3-MEDIUM") & (year == 1998), F.lit("resent.pdf")),
        )
    )
    return runs.select("source", "run_date", F.explode(files).alias("filename"))
