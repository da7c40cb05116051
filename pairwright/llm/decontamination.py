"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are lower-cased (A-Z) and every character that is neither a letter, a digit nor beyond ASCII
becomes a space. The patterns are the windows of 13 consecutive words of every test item, a shorter
item being one window. One pass over a text finds all windows in it; words inside them are hit, and
runs of hit words are mapped back to code point offsets in the original text.

The benchmark is collected: its size is checked against ``MOST_CHARS`` first. An automaton holds
patterns of ``PATTERN_CHARS`` characters at most; a benchmark with more is split between several
automata, each scanning all texts in a pass of its own, and the hits are put together.

Defined results: a NULL or wordless text has no words and no hits; an item without words has no
window; items with a NULL id count under the empty id; items that share a window are all found;
repeated rows are scanned one by one; empty tables give no rows, or no hits; a column of documents
named like the result column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import fresh, put
from pairwright.session import materialize

WINDOW = 13
#: Characters of test items the driver takes.
MOST_CHARS = 50_000_000
#: Characters of the windows of one automaton: about 100 MB in each worker.
PATTERN_CHARS = 2_000_000

#: Byte for byte, so places stay the same: A-Z to a-z, ASCII other than letters and digits to space.
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)

HITS = (
    "n_words bigint, n_hit bigint, items array<string>, "
    "spans array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
)


def words_of(text: str | None) -> tuple[bytes, list[bytes]]:
    plain = (text or "").encode("utf-8", "surrogatepass").translate(PLAIN)
    return plain, plain.split()


def windows_of(text: str | None, size: int = WINDOW) -> list[bytes]:
    words = words_of(text)[1]
    if not words:
        return []
    return [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]


def pattern_groups(
    items: list[tuple[str, str]], size: int = WINDOW, most: int = PATTERN_CHARS
) -> list[list[tuple[bytes, list[str]]]]:
    """The windows with the ids of the items they occur in, in groups one automaton can hold."""
    owners: dict[bytes, set[str]] = {}
    for ident, text in items:
        for window in windows_of(text, size):
            owners.setdefault(window, set()).add(ident)
    groups: list[list[tuple[bytes, list[str]]]] = [[]]
    room = most
    for window, ids in owners.items():
        if len(window) > room and groups[-1]:
            groups.append([])
            room = most
        room -= len(window)
        groups[-1].append((window, sorted(ids)))
    return groups


def automaton_of(patterns: list[tuple[bytes, list[str]]]) -> ahocorasick.Automaton:
    """Matches whole words: a text's words are joined by single spaces, with one at either end."""
    automaton = ahocorasick.Automaton()
    for window, ids in patterns:
        automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, ids))
    if patterns:
        automaton.make_automaton()
    return automaton


def scan(text: str | None, automaton: ahocorasick.Automaton) -> tuple[int, int, list, list]:
    """Words, hit words, ids of the items found, and runs of hit words with their offsets."""
    plain, words = words_of(text)
    if not words or not len(automaton):
        return len(words), 0, [], []
    joined = f" {b' '.join(words).decode('latin-1')} "
    hit = None
    items: set[str] = set()
    seen, spaces = 0, 0
    for end, (length, ids) in automaton.iter(joined):
        if hit is None:
            hit = np.zeros(len(words) + 2, np.int8)
        spaces += joined.count(" ", seen, end)
        seen = end
        hit[spaces - length + 1 : spaces + 1] = 1  # word k stands at k + 1
        items.update(ids)
    if hit is None:
        return len(words), 0, [], []
    edges = np.flatnonzero(np.diff(hit))
    runs = list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))
    return len(words), int(hit.sum()), sorted(items), located(plain, text, runs)


def located(plain: bytes, text: str, runs: list[tuple[int, int]]) -> list[tuple]:
    """Runs of words with their code point offsets in the original text, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    starts = np.array([m.span() for m in re.finditer(rb"[^ ]+", plain)])
    points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [
        (a, b, int(points[starts[a][0]]) - 1, int(points[starts[b][1] - 1])) for a, b in runs
    ]


def merged(parts: list) -> tuple[int, int, list, list]:
    """The hits of several passes over one text put together."""
    hit: set[int] = set()
    places: dict[int, tuple[int, int]] = {}
    items: set[str] = set()
    for part in parts:
        items.update(part["items"])
        for span in part["spans"]:
            hit.update(range(span["first"], span["last"] + 1))
            places[span["first"]] = (span["start"], places.get(span["first"], (0, 0))[1])
            places[span["last"]] = (places.get(span["last"], (0, 0))[0], span["end"])
    spans = []
    for k in sorted(hit):
        if k - 1 not in hit:
            spans.append([k, k, places[k][0], 0])
        if k + 1 not in hit:
            spans[-1][1], spans[-1][3] = k, places[k][1]
    return parts[0]["n_words"], len(hit), sorted(items), [tuple(s) for s in spans]


def scanner(patterns: list[tuple[bytes, list[str]]]):
    def scan_texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = automaton_of(patterns)
        for texts in batches:
            yield pd.DataFrame(
                [scan(t, automaton) for t in texts], columns=["n_words", "n_hit", "items", "spans"]
            )

    return F.pandas_udf(scan_texts, HITS)


def merge_passes(passes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        [merged(list(p)) for p in passes], columns=["n_words", "n_hit", "items", "spans"]
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "hits",
    pattern_chars: int = PATTERN_CHARS,
) -> DataFrame:
    """Documents with a struct: n_words, n_hit, items (ids as strings) and spans of hit words."""
    wanted = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"),
        F.col(item_text).alias("text"),
    )
    total = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if total > MOST_CHARS:
        raise ValueError(f"test items of {total} characters; at most {MOST_CHARS} are supported")
    items = sorted((r.id, r.text or "") for r in wanted.collect())
    groups = pattern_groups(items, WINDOW, pattern_chars)
    text = F.col(f"`{text_col}`")
    if len(groups) == 1:
        return put(docs, {out: scanner(groups[0])(text)})
    passes = []
    frame = docs
    for group in groups:
        passes.append(fresh(frame, "_pass"))
        frame = materialize(frame.withColumn(passes[-1], scanner(group)(text)), "pass")
    return put(frame, {out: F.pandas_udf(merge_passes, HITS)(F.array(*passes))}).drop(*passes)


def contaminated(hits: str = "hits"):
    """At least one word in twenty lies inside a window of the benchmark."""
    n_hit, n_words = F.col(f"{hits}.n_hit"), F.col(f"{hits}.n_words")
    return (n_hit > 0) & (20 * n_hit >= n_words)
