"""Runs of repeating words: maximal stretches in which words a period apart are the same.

Online, over diagonals. A diagonal is a lag: it matches at a word when the word that far back is the
same, so the earlier occurrences of a word are the lags that match at it. They are kept as the bits
of one integer (bit q: lag q), and the lags that match now meet those that have matched so far in
one operation. A diagonal that has matched LEAST times in a row becomes active; when it breaks, or
the text ends, its match length is known, and if that is long enough its run is emitted at once.
Only occurrences are looked at, no pair of words is compared, and what is kept is one integer for
each different word and the active lags.

A stretch of period q and n words is a diagonal of lag q that matches n - q times. It must be at
least ``least`` words and two periods long. Of the diagonals that break at one place with one start,
the smallest lag is the period and the others are its multiples, so they are left out.

Defined results: a NULL, empty or blank text has no words and no runs, and its collapsed text is
empty; repeated rows are each judged; an empty table gives no rows; a column named like the result
gives way to it. Time grows with the square of the words of one text, in steps of a machine word of
lags; memory with its words times its different words, an eighth of a byte each at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import put

#: Words a run has at least.
LEAST_WORDS = 12

RUN_TYPE = "array<struct<start bigint, length bigint, period bigint>>"


def lags_of(bits: int) -> list[int]:
    """The places of the bits that are set, in ascending order."""
    if bits.bit_count() < 8:
        found = []
        while bits:
            low = bits & -bits
            found.append(low.bit_length() - 1)
            bits ^= low
        return found
    raw = np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def find_runs(words: list, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, by start and period."""
    n = len(words)
    # a run of period q has max(least - q, q) matches: no fewer than this for any q
    fewest = max(1, (least + 1) // 2)
    seen: dict = {}  # word: its places so far, counted back from the last word
    recent = [0] * fewest  # lags that matched at the last places
    active, began = 0, {}
    runs = []

    def close(ended: int, end: int) -> None:
        """Emit what breaks before place ``end``."""
        starts = set()
        for lag in lags_of(ended):
            start = began.pop(lag)
            # the smallest lag of a stretch is its period; larger ones are multiples
            if start not in starts and end - start >= max(least, 2 * lag):
                starts.add(start)
                runs.append((start, end - start, lag))

    for i, word in enumerate(words):
        places = seen.get(word, 0)
        matching = places >> (n - 1 - i)
        seen[word] = places | (1 << (n - 1 - i))
        recent[i % fewest] = matching
        if active:
            ended = active & ~matching
            if ended:
                close(ended, i)
                active &= matching
        if matching:
            steady = matching & ~active
            for other in recent:
                if not steady:
                    break
                steady &= other
            if steady:
                for lag in lags_of(steady):
                    began[lag] = i - fewest + 1 - lag
                active |= steady
    close(active, n)
    runs.sort(key=lambda run: (run[0], run[2]))
    return runs


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run repeats: those outside runs and the first period of each."""
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [word for word, stays in zip(words, keep.tolist()) if stays]


def run_finder(least: int):
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                words = (text or "").encode("utf-8", "surrogatepass").split()
                runs = find_runs(words, least)
                kept = collapse(words, runs) if runs else words
                out.append((len(words), runs, b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["n_words", "runs", "collapsed"])

    return F.pandas_udf(judge, f"n_words bigint, runs {RUN_TYPE}, collapsed string")


def mark_runs(
    docs: DataFrame, text_col: str = "text", out: str = "repeats", least: int = LEAST_WORDS
) -> DataFrame:
    """Documents with a struct: n_words, runs (start, length, period) and the collapsed text."""
    return put(docs, {out: run_finder(least)(F.col(f"`{text_col}`"))})
