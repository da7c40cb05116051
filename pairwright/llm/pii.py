"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Kinds: email, ip, card and phone (base kinds), iban, and secret (a key, token or password with a value
of letters and digits, the whole assignment). Matches of a kind are the leftmost ones
that do not overlap; a match that fails its check is dropped and its text is not tried again. A span
has a score from 0 to 1: what its kind is worth, raised or lowered by words just before it.

Everything is built-in functions. Positions come from marking the matches: the text is cut at the
marks, every second piece is a match, and the lengths of the pieces before it are its position, in
code points. The quantifiers are possessive and tied to the start of a run of characters where a
plain one would try every place of a long run again or overflow the stack; what matches is the same.

Defined results: a NULL or empty text has no spans; texts of any length are read whole; repeated
rows each get their spans; an empty table gives none; other columns of the input are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import put

#: Marks a match; a text's own use of it is read as the next one, which no pattern matches either.
MARK, NOT_MARK = "\ufdd0", "\ufdd1"
#: Characters before a span in which context words count.
CONTEXT = 40
#: Change of the score by a context word.
RAISE, LOWER = 0.2, 0.3

SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,score:double>"
#: Pieces of a text that are read in one run, at least; even.
RUN = 64


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    worth: float
    for_it: str
    against_it: str


KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.8,
        r"mail|contact|write to",
        r"example of|noreply",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        0.6,
        r"\bip\b|address|host|server|login",
        r"version|release|section|\bv\.?\s*$",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        0.7,
        r"card|credit|debit|visa|payment|konto|carte|tarjeta",
        r"order|serial|isbn|tracking",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        0.7,
        r"phone|call|mobile|\btel|fax|whatsapp",
        r"score|result",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
        r"(?![A-Za-z0-9_])",
        0.8,
        r"iban|account|bank|konto|compte|cuenta",
        r"serial|part no",
    ),
    Kind(
        "secret",
        r"(?:[Kk]ey|KEY|[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD)[\"']?\x20{0,3}[=:]"
        r"\x20{0,3}[\"']?[A-Za-z0-9+/_=-]{16,}+",
        0.8,
        r"api|auth|access|private|config",
        r"example of|dummy",
    ),
)
BASE = tuple(k.name for k in KINDS[:4])


def luhn(digits: Column) -> Column:
    """Whether up to 20 digits pass Luhn's check."""
    padded = F.lpad(digits, 20, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    total = F.lit(0)
    for place in range(1, 21):
        total = total + F.substring(doubled if place % 2 else padded, place, 1).cast("int")
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether letters and digits pass the mod-97 check, the first four moved to the end."""
    turned = F.concat(iban.substr(5, 99), iban.substr(1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc)
        .when(c < "A", (acc * 10 + c.cast("int")) % 97)
        .otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(
            r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
            r"(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
        )
    if kind == "card":
        digits = F.regexp_replace(match, "[^0-9]", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    if kind == "secret":
        return match.rlike("[=:].*[0-9]") & match.rlike("[=:].*[A-Za-z]")
    return F.lit(True)


def no_spans() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def spans_of_pieces(pieces: Column, rank: int) -> Column:
    """Characters of some pieces, the first of which is no match, and the spans in them."""
    kind = KINDS[rank]
    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.lit(False).alias("odd"),
        F.lit("").alias("before"),
        no_spans().alias("spans"),
    )

    def step(acc: Column, piece: Column) -> Column:
        tail = F.lower(F.right(acc["before"], F.lit(CONTEXT)))
        score = (
            F.lit(kind.worth)
            + F.when(tail.rlike(kind.for_it), RAISE).otherwise(0.0)
            - F.when(tail.rlike(kind.against_it), LOWER).otherwise(0.0)
        )
        end = acc["at"] + F.length(piece)
        found = F.struct(
            acc["at"].alias("start"),
            F.lit(rank).alias("rank"),
            end.alias("end"),
            F.lit(kind.name).alias("kind"),
            score.alias("score"),
        )
        spans = F.when(
            acc["odd"] & passes(kind.name, piece),
            F.concat(acc["spans"], F.array(found).cast(f"array<{SPAN}>")),
        ).otherwise(acc["spans"])
        return F.struct(
            end.cast("long").alias("at"),
            (~acc["odd"]).alias("odd"),
            piece.alias("before"),
            spans.alias("spans"),
        )

    return F.aggregate(pieces, start, step, lambda acc: F.struct(acc["at"], acc["spans"]))


def moved(spans: Column, by: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            (s["start"] + by).alias("start"),
            s["rank"].alias("rank"),
            (s["end"] + by).alias("end"),
            s["kind"].alias("kind"),
            s["score"].alias("score"),
        ),
    )


def spans_of_kind(text: Column, rank: int) -> Column:
    """The spans of one kind, from the left.

    Appending copies what is there already, so a text with many pieces is read in about as many
    runs of pieces as a run has pieces, and the spans of a run are appended at once.
    """
    marked = F.split(F.regexp_replace(text, KINDS[rank].pattern, f"{MARK}$0{MARK}"), MARK)

    def in_runs(pieces: Column) -> Column:
        # an even number of pieces, so that no run begins with a match
        width = F.greatest(F.lit(RUN), 2 * F.ceil(F.sqrt(F.size(pieces)) / 2)).cast("int")
        runs = F.transform(
            F.sequence(F.lit(1), F.size(pieces), width),
            lambda first: spans_of_pieces(F.slice(pieces, first, width), rank),
        )
        start = F.struct(F.lit(0).cast("long").alias("at"), no_spans().alias("spans"))
        return F.aggregate(
            runs,
            start,
            lambda acc, run: F.struct(
                (acc["at"] + run["at"]).alias("at"),
                F.concat(acc["spans"], moved(run["spans"], acc["at"])).alias("spans"),
            ),
            lambda acc: acc["spans"],
        )

    # one element, so that the pieces have a name and are made once
    return F.element_at(F.transform(F.array(marked), in_runs), 1)


def find_spans(text: Column) -> Column:
    """All spans of a text as an array of structs, by start, then kind as listed."""
    whole = F.coalesce(text, F.lit(""))
    clean = F.when(whole.contains(MARK), F.translate(whole, MARK, NOT_MARK)).otherwise(whole)
    return F.array_sort(F.concat(*[spans_of_kind(clean, rank) for rank in range(len(KINDS))]))


def personal_data(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Documents with an array of spans: start, rank, end, kind, score."""
    return put(docs, {out: find_spans(F.col(f"`{text_col}`"))})


def joined(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    wanted = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
