"""Small hand-written runs."""

import datetime as dt

from pairwright.specs import Config, Source

DAY = dt.date(2026, 3, 2)
KEY_SOURCE = Source(
    name="S",
    columns={"date": 40, "description": 110, "quantity": 300, "amount": 380},
    aliases={f: [f] for f in ("date", "description", "quantity", "amount")},
    match_key=("date", "description", "amount", "quantity"),
)
ID_SOURCE = Source(
    name="ACME_SUPPLIES",
    columns={"reference": 45, "date": 130, "description": 210, "quantity": 360, "amount": 420},
    aliases={f: [f] for f in ("reference", "date", "description", "quantity", "amount")},
    match_on="reference",
    start_markers=("TRANSACTION DETAIL",),
    stop_markers=("END OF REPORT",),
    skip_markers=("Reference Date Description",),
)
KEYED = Config(sources=[KEY_SOURCE])
BY_ID = Config(sources=[ID_SOURCE])

RECORD = (
    "source string, run_date date, side string, ordinal long, locator string, date string, "
    "description string, quantity string, amount string, reference string, account string"
)
FIELDS = ("date", "description", "quantity", "amount", "reference", "account")

GOLDEN_DOCUMENT = [
    ("INV-4471", "02-Mar-2026", "Copier paper A4", "40", "1,234.50"),
    ("INV-4472", "02-Mar-2026", "Toner cartridges", "6", "899.00"),
    ("INV-4473", "02-Mar-2026", "Desk risers", "12", "540.00"),
    ("INV-4474", "02-Mar-2026", "Cable trays", "30", "275.25"),
]
GOLDEN_SHEET = [
    ("INV-4471", "2026-03-02", "Copier paper A4", "40", "1234.50"),
    ("INV-4472", "2026-03-02", "Toner cartridges", "6", "989.00"),
    ("INV-4473", "2026-03-02", "Desk risers", "12", "540.00"),
    ("INV-4480", "2026-03-02", "Whiteboard markers", "50", "62.00"),
]


def records(spark, documents, sheets, source="S", day=DAY):
    """Records of one run from two lists of dicts."""
    rows = []
    for side, values in (("document", documents), ("spreadsheet", sheets)):
        for i, v in enumerate(values, start=1):
            rows.append((source, day, side, i, f"{side} {i}", *[v.get(f) for f in FIELDS]))
    return spark.createDataFrame(rows, RECORD)


def rec(date="2026-03-02", description="ALPHA", amount="100.00", quantity="1", **more):
    return dict(date=date, description=description, amount=amount, quantity=quantity, **more)


def inv(reference="INV-001", **more):
    return rec(reference=reference, **more)


def words_of(lines, doc_id="d", source="ACME_SUPPLIES", day=DAY, page=1, top=100.0):
    """Words of a page: each line is a list of (text, x0)."""
    rows, seq = [], 0
    for i, line in enumerate(lines):
        for text, x0 in line:
            seq += 1
            rows.append((source, day, doc_id, page, seq, text, float(x0), top + 15 * i))
    return rows


WORD = (
    "source string, run_date date, doc_id string, page int, seq long, text string, x0 double, "
    "top double"
)


def golden_words():
    line = lambda ref, date, text, qty, amount: (
        [(ref, 45), (date, 130)]
        + [(w, 210 + 30 * i) for i, w in enumerate(text.split())]
        + [(qty, 360), (amount, 420)]
    )
    body = [line(*r) for r in GOLDEN_DOCUMENT]
    head = [[("TRANSACTION", 45), ("DETAIL", 120)],
            [("Reference", 45), ("Date", 130), ("Description", 210), ("Amount", 420)]]
    return words_of([*head, *body, [("END", 45), ("OF", 70), ("REPORT", 90)]])


def golden_sheet(spark, day=DAY):
    names = ("reference", "date", "description", "quantity", "amount")
    rows = [dict(zip(names, r, strict=True)) for r in GOLDEN_SHEET]
    return records(spark, [], rows, source="ACME_SUPPLIES", day=day)
