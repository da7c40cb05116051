"""Column builders that bring dates, numbers and text to one canonical spelling.

Every builder takes a Column (or a column name) holding the value as it was read and returns a
string Column that is never NULL: two values are the same exactly when their canonical strings are
equal, and anything that cannot be interpreted falls back to its cleaned, upper-cased text.

Each builder is a *linear* chain: a step refers to the previous one once (twice at the end), so the
expression stays small when the optimizer copies it into filters and join keys, and it compiles
into whole-stage code. No Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two readings of a date with two numbers up to 12.
DAY_FIRST = "day_first"
MONTH_FIRST = "month_first"
DATE_ORDERS = (DAY_FIRST, MONTH_FIRST)

# Whitespace: what has the Unicode property, and the four separator control characters.
_WS = r"[\s\x1c-\x1f]"
# Any run of whitespace but a single plain space, which is already as it should be.
_UNTIDY_SPACE = rf"(?U)[\s\x1c-\x1f&&[^ ]]{_WS}*| {_WS}+"
# Found in any text that has something to collapse, and in all that is not printable ASCII.
_UNTIDY = r"[^ -~]|^ | (?: |\z)"

#: The only character normalised text can never contain that is still printable in logs as a
#: separator: every whitespace-like control character has been collapsed to a space.
KEY_SEPARATOR = "\x1f"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _rr(value: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(value, F.lit(pattern), F.lit(replacement))


def collapse(value: Column | str) -> Column:
    """Whitespace runs become one space, ends trimmed, NULL becomes the empty string."""
    text = F.coalesce(_col(value).cast("string"), F.lit(""))
    return F.trim(_rr(text, _UNTIDY_SPACE, " "))


def norm_text(value: Column | str) -> Column:
    """Free text: whitespace collapsed, upper-cased. Tidy ASCII text is only upper-cased."""
    text = F.coalesce(_col(value).cast("string"), F.lit(""))
    return F.upper(F.when(F.rlike(text, F.lit(_UNTIDY)), collapse(text)).otherwise(text))


# --------------------------------------------------------------------------------------------
# numbers
# --------------------------------------------------------------------------------------------

# A number written plainly or with ordinary comma groups, perhaps with a short currency code at one
# end, needs none of the clean-up below.
_CURRENCY = "(?:[A-Za-z]{1,4}|[$€£¥%])"
_PLAIN_NUMBER = (
    rf"^(?:{_CURRENCY} ?)?(-?(?:[0-9]+|[0-9]{{1,3}}(?:,[0-9]{{3}})+)(?:\.[0-9]+)?)"
    rf"(?: ?{_CURRENCY})?\z"
)

# Numbers whose canonical form is in their text: integers as they are; with groups and decimals, what
# is left of the zeros at the end (group 1) without the commas. At most fifteen digits, six of them
# decimals, which a double holds exactly as they are written.
_INTEGER = r"^(?:0|-?[1-9][0-9]{0,14})\z"
_EXACT_NUMBER = (
    rf"^(?:{_CURRENCY} ?)?((?:0|-?[1-9][0-9]{{0,8}}|-?[1-9][0-9]{{0,2}}(?:,[0-9]{{3}}){{1,2}})"
    rf"(?:\.[0-9]{{0,5}}[1-9](?!\.))?)(?:\.0{{1,6}}|(?<=\.[0-9]{{1,6}})0{{1,6}})?(?: ?{_CURRENCY})?\z"
)

# A number as it is written: words or a currency in front, a sign, digits with their separators, and
# behind the last digit either separators alone or a unit; a sign may close a single line. Groups:
# brackets (marked \x01 before), nothing (set on a single line only), the sign in front, the digits,
# separators at the end, the closing sign behind them, the closing sign behind a unit.
_FRONT = r"[^\p{Nd}+\-(.]*+"
_DIGITS = r"[0-9., '’]*[0-9]"
_UNIT = r"[^\p{Nd}.,)]*"
_WRITTEN_NUMBER = (
    rf"(?s)^(\x01?)(?:(?!.*\n)())?+{_FRONT}([+-]?)[ '’]*({_DIGITS})"
    rf"(?:([., '’]*)(?:(?U){_WS}*\2([+-]))?|{_UNIT}?\2([+-])|{_UNIT})\z"
)
_UNDERSTOOD, _NEGATIVE = "\x02", "\x03"

# Digits with separators are a number when they are one of: digits with dots, digits with commas,
# dot groups then a decimal comma, comma groups then a decimal dot.
_NUMBER_SHAPE = (
    rf"{_NEGATIVE}?(?=.*[0-9])(?:[0-9.]*|[0-9,]*|[0-9.]*,[0-9]*|[0-9,]*\.[0-9]*)\z"
)


def format_number_text(number: Column) -> Column:
    """At most six decimals, no trailing zeros, no negative zero."""
    text = F.call_function("format_number", number, F.lit("0.######"))
    return F.replace(_rr(text, "^-0$", "0"), F.lit("∞"), F.lit("inf"))


def _number_body(text: Column) -> Column:
    r"""Digits and separators of a written number, \x03 before them if it is negative; else 'x'.

    Brackets around all of it, a minus in front and a minus behind each make it negative.
    """
    t = F.translate(text, f"\x01{_UNDERSTOOD}{_NEGATIVE}", "~~~")
    t = _rr(t, f"(?U)^{_WS}+|{_WS}+$", "")
    t = _rr(t, rf"(?sU)^\({_WS}*(.*?){_WS}*\)$", "\x01$1")
    t = _rr(t, _WRITTEN_NUMBER, f"{_UNDERSTOOD}$1$3$4$5$6$7")
    t = _rr(t, rf"(?s)^(?!{_UNDERSTOOD}).*$", "x")
    t = _rr(t, rf"^{_UNDERSTOOD}(?=.*[\x01\-])", _NEGATIVE)
    t = F.translate(t, f"\x01{_UNDERSTOOD}+- '’", "")
    return _rr(t, rf"(?s)^(?!{_NUMBER_SHAPE}).*$", "x")


def unify_separator(body: Column) -> Column:
    """Decide which separator is the decimal point; ';' stands for it while deciding."""
    t = _rr(body, r",(?=.*\.)", "")
    t = _rr(t, r"^([^,.]*\.[^,]*),", "$1;")
    t = _rr(t, r"^([^,]*),(?![0-9]{3}$)([^,;]*)$", "$1;$2")
    t = _rr(t, r"^([^.;]*)\.([^.;]*)$", "$1;$2")
    return F.translate(t, ";,.", ".")


def norm_number(value: Column | str) -> Column:
    """Canonical decimal text with at most six decimals, or the cleaned text if not a number."""
    text = F.coalesce(_col(value).cast("string"), F.lit(""))
    signed = F.replace(unify_separator(_number_body(text)), F.lit(_NEGATIVE), F.lit("-"))
    plain = F.replace(F.regexp_extract(text, _PLAIN_NUMBER, 1), F.lit(","), F.lit(""))
    exact = F.replace(_rr(text, _EXACT_NUMBER, "$1"), F.lit(","), F.lit(""))
    return (
        F.when(F.rlike(text, F.lit(_INTEGER)), text)
        .when(F.rlike(text, F.lit(_EXACT_NUMBER)), exact)
        .otherwise(
            F.coalesce(
                format_number_text(plain.try_cast("double")),
                format_number_text(signed.try_cast("double")),
                norm_text(text),
            )
        )
    )


def norm_quantity(value: Column | str) -> Column:
    """A count: as a number, and text ending in '.0' loses that ending."""
    return _rr(norm_number(value), r"\.0$", "")


def norm_numeric(value: Column | str) -> Column:
    """Canonical text of a value that is already numeric; NULL and NaN are blank."""
    number = _col(value).cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit("")).otherwise(
        format_number_text(number)
    )


def norm_boolean(value: Column | str) -> Column:
    """TRUE or FALSE; NULL is blank."""
    return F.coalesce(F.upper(_col(value).cast("string")), F.lit(""))


_FLOAT_TEXT = r"^[+-]?([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)(E[+-]?[0-9]+)?$"


def total_value(normalised: Column | str) -> Column:
    """What a normalised value adds to a side total, as an exact decimal or NULL.

    Canonical numbers have at most six decimals, so the decimal sum is exact and does not depend on
    the order in which partitions are merged.
    """
    text = _col(normalised)
    return F.when(
        F.rlike(text, F.lit(_FLOAT_TEXT)), F.replace(text, F.lit("_"), F.lit(""))
    ).try_cast("decimal(28,6)")


def total_overflow(normalised: Column | str) -> Column:
    """The rare finite value too large for the exact decimal, as a double; otherwise NULL."""
    text = _col(normalised)
    number = F.when(
        F.rlike(text, F.lit(_FLOAT_TEXT)), F.replace(text, F.lit("_"), F.lit(""))
    ).try_cast("double")
    return F.when((F.abs(number) >= F.lit(1e22)) & (F.abs(number) < F.lit(float("inf"))), number)


# --------------------------------------------------------------------------------------------
# dates
# --------------------------------------------------------------------------------------------

# The accepted spellings of each part of a date, in small letters.
_YEAR = r"((?!0000)[0-9]{4})"
_MONTH = r"(1[0-2]|0[1-9]|[1-9])"
_DAY = r"(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])"
_DAY_NO_MONTH = r"(3[01]|2[0-9]|1[3-9])"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH_NAME = (
    rf"({'|'.join(_MONTHS)})"
    r"(?:(?<=jan)uary|(?<=feb)ruary|(?<=mar)ch|(?<=apr)il|(?<=jun)e|(?<=jul)y"
    r"|(?<=aug)ust|(?<=sep)tember|(?<=oct)ober|(?<=nov)ember|(?<=dec)ember)?"
)
# The spellings that may end in a two-digit year: 69-99 are 1969-1999, 00-68 are 2000-2068.
_BEFORE_SHORT_YEAR = (
    r"^([0-9]{1,2}([-/]) ?[0-9]{1,2}\2|[0-9]{1,2}-[a-z]{3}-|[a-z]{3} [0-9]{1,2}, )"
)
# The commonest spellings are recognised before any rewriting. The first needs no parsing at all: a
# real date is its own canonical form, and an impossible one stays as it was written.
_ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
_NAMED_DATE = r"^[0-9]{2}-[A-Za-z]{3}-[1-9][0-9]{3}\z"
_NUMERIC_DATE = r"^[0-9]{2}([-/.])[0-9]{2}\1[1-9][0-9]{3}\z"
# Each spelling is rewritten to \x01 year-month-day; a month still by name is marked \x02.
_DATE_REWRITES = (
    (_BEFORE_SHORT_YEAR + r"(69|[7-9][0-9])$", r"$1\19$3"),
    (_BEFORE_SHORT_YEAR + r"([0-9]{2})$", r"$1\20$3"),
    (rf"^{_YEAR}([-/.]){_MONTH}\2{_DAY}$", "\x01$1-$3-$4"),
    (rf"^{_YEAR}{_MONTH}{_DAY}$", "\x01$1-$2-$3"),
    (rf"^{_DAY}([- ]){_MONTH_NAME}\2{_YEAR}$", "\x01$4-\x02$3-$1"),
    (rf"^{_MONTH_NAME} {_DAY}, {_YEAR}$", "\x01$3-\x02$1-$2"),
    (rf"^{_DAY_NO_MONTH}([-/.]){_MONTH}\2{_YEAR}$", "\x01$4-$3-$1"),
    (rf"^{_MONTH}([-/.])({_DAY_NO_MONTH[1:-1]}| [1-9])\2{_YEAR}$", "\x01$4-$1-$3"),
)
_TWO_READINGS = rf"^{_MONTH}([-/.]){_MONTH}\2{_YEAR}$"
_READ_DAY_FIRST, _READ_MONTH_FIRST = "\x01$4-$3-$1", "\x01$4-$1-$3"


def _parse(value: Column, pattern: str) -> Column:
    return F.call_function("try_to_date", value, F.lit(pattern))


def norm_date(value: Column | str, order: Column | str = DAY_FIRST) -> Column:
    """ISO date, or the cleaned text when the value is no date in any accepted spelling.

    ``order`` is ``'day_first'``, ``'month_first'`` or a Column holding one of them. It matters
    only where both readings are possible, so for two numbers up to 12 before the year.
    """
    raw = F.coalesce(_col(value).cast("string"), F.lit(""))
    text = collapse(raw)
    # a date cell read as a moment carries a midnight time; only the date part counts then
    head = _rr(text, r"^([^ ]*)(?: .*)? 00:00:00.*$", "$1")
    order = F.lit(order) if isinstance(order, str) else order
    reading = F.when(order == MONTH_FIRST, _READ_MONTH_FIRST).otherwise(_READ_DAY_FIRST)

    canonical = F.lower(F.translate(head, "\x01\x02", "~~"))
    for pattern, replacement in _DATE_REWRITES:
        canonical = _rr(canonical, pattern, replacement)
    canonical = F.regexp_replace(canonical, F.lit(_TWO_READINGS), reading)
    canonical = F.translate(canonical, " ", "")
    for number, name in enumerate(_MONTHS, start=1):
        canonical = F.replace(canonical, F.lit(f"\x02{name}"), F.lit(str(number)))
    parsed = _parse(canonical, "'\x01'yyyy-M-d")

    return (
        F.when(F.rlike(raw, F.lit(_ISO_DATE)), raw)
        .when(
            F.rlike(raw, F.lit(_NAMED_DATE)),
            F.coalesce(_parse(raw, "dd-MMM-yyyy").cast("string"), F.upper(raw)),
        )
        .when(F.rlike(raw, F.lit(_NUMERIC_DATE)), F.coalesce(_numeric_date(raw, order), raw))
        .otherwise(F.coalesce(parsed.cast("string"), F.upper(text)))
    )


def _numeric_date(raw: Column, order: Column) -> Column:
    """ISO text of 'nn-nn-yyyy', the configured reading first; NULL when neither exists."""

    def reading(month_at: int, day_at: int) -> Column:
        parts = [F.substring(raw, at, n) for at, n in ((7, 4), (month_at, 2), (day_at, 2))]
        return F.concat_ws("-", *parts).try_cast("date")

    day_first, month_first = reading(4, 1), reading(1, 4)
    chosen = F.when(order == MONTH_FIRST, F.coalesce(month_first, day_first)).otherwise(
        F.coalesce(day_first, month_first)
    )
    return chosen.cast("string")


def norm_date_value(value: Column | str) -> Column:
    """ISO date of a value that is already a date or timestamp; NULL is blank."""
    return F.coalesce(F.date_format(_col(value).cast("date"), "yyyy-MM-dd"), F.lit(""))


# --------------------------------------------------------------------------------------------
# by kind
# --------------------------------------------------------------------------------------------

def canonical(kind: str, value: Column | str, order: Column | str = DAY_FIRST) -> Column:
    """The canonical form of a value of this kind; ``order`` matters for dates alone."""
    match kind:
        case "date":
            return norm_date(value, order)
        case "number":
            return norm_number(value)
        case "count":
            return norm_quantity(value)
    return norm_text(value)


def mask_shape(value: Column | str) -> Column:
    """Digits become 9, capitals A, small letters a; everything else is kept."""
    text = _rr(F.coalesce(_col(value).cast("string"), F.lit("")), r"\p{Nd}", "9")
    text = _rr(text, r"(?U)\p{Lu}", "A")
    return _rr(text, r"(?U)[\p{Ll}&&[^a]]", "a")
