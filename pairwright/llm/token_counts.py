"""Token counts by greedy longest match, in time linear in the text.

The vocabulary is a trie. A node keeps where matching goes on when no child fits (its failure link)
and how many tokens are complete by then; both are worked out once, from shallow nodes to deep ones.
Counting a word then reads each byte once and never goes back, and no piece is built.

Words are runs of anything but ASCII white space. Pieces that begin a word and pieces that go on in
one are told apart: in a byte-level vocabulary those with a leading space begin a word. The space
alone is one of them, so a word with no other beginning is that piece and pieces that go on.

Defined results: NULL, empty and blank texts have no words and no tokens; a word that the vocabulary
cannot spell is one unknown token; repeated rows count alike; an empty table gives no rows; a column
named like the result is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import put

#: Words whose counts a worker remembers.
REMEMBERED = 500_000


def byte_of_character() -> dict[str, int]:
    """The bytes that stand for themselves in a byte-level vocabulary, and the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(shifted)}


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that begin a word (without their space) and pieces that go on, of a tokenizer file.

    The space alone is the empty beginning.
    """
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    table = byte_of_character()
    begin, go_on = [], []
    for piece in vocabulary:
        if not all(c in table for c in piece):
            continue
        plain = bytes(table[c] for c in piece)
        if plain == b" " or plain[:1] == b" " and plain.split() == [plain[1:]]:
            begin.append(plain[1:])
        elif plain.split() == [plain]:
            go_on.append(plain)
    return begin, go_on


@dataclass
class Automaton:
    """Nodes are numbers: 0 is the start of a word, 1 the place after a complete token."""

    steps: dict[int, int] = field(default_factory=dict)  # node * 256 + byte: child
    failure: list[int] = field(default_factory=lambda: [-1, -1])
    popped: list[int] = field(default_factory=lambda: [0, 0])

    def count(self, word: bytes) -> int:
        """The number of tokens of a word; 1 for one that cannot be spelled."""
        node, tokens = 0, 0
        steps, failure, popped = self.steps, self.failure, self.popped
        for byte in word:
            child = steps.get(node * 256 + byte)
            while child is None:
                tokens += popped[node]
                node = failure[node]
                if node < 0:
                    return 1
                child = steps.get(node * 256 + byte)
            node = child
        while node != 1:
            tokens += popped[node]
            node = failure[node]
            if node < 0:
                return 1
        return tokens


def build(begin: Iterable[bytes], go_on: Iterable[bytes]) -> Automaton:
    made = Automaton()
    complete = set()
    parent: dict[int, tuple[int, int]] = {}
    depth: list[list[int]] = []
    for root, pieces in ((0, begin), (1, go_on)):
        for piece in pieces:
            node = root
            for k, byte in enumerate(piece):
                child = made.steps.get(node * 256 + byte)
                if child is None:
                    child = len(made.failure)
                    made.steps[node * 256 + byte] = child
                    made.failure.append(-1)
                    made.popped.append(0)
                    parent[child] = (node, byte)
                    while len(depth) <= k:
                        depth.append([])
                    depth[k].append(child)
                node = child
            if piece:
                complete.add(node)
            elif root == 0:  # a token of no bytes of the word, taken where no other beginning fits
                made.failure[0], made.popped[0] = 1, 1
    for level in depth:
        for node in level:
            if node in complete:
                made.failure[node], made.popped[node] = 1, 1
                continue
            above, byte = parent[node]
            tokens, back = made.popped[above], made.failure[above]
            while back >= 0 and (back * 256 + byte) not in made.steps:
                tokens += made.popped[back]
                back = made.failure[back]
            if back >= 0:
                made.failure[node] = made.steps[back * 256 + byte]
                made.popped[node] = tokens
    return made


class Counts(dict):
    """Token counts of words, remembered while there are not too many."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = self.automaton.count(word)
        return value


def counter(automaton: Automaton):
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counts = Counts(automaton)
        for texts in batches:
            out = []
            for text in texts:
                words = (text or "").encode("utf-8", "surrogatepass").split()
                out.append((len(words), sum(map(counts.__getitem__, words))))
            yield pd.DataFrame(out, columns=["n_words", "n_tokens"], dtype="int64")

    return F.pandas_udf(count, "n_words bigint, n_tokens bigint")


def count_tokens(
    docs: DataFrame, automaton: Automaton, text_col: str = "text", out: str = "tokens"
) -> DataFrame:
    """Documents with a struct: n_words, n_tokens."""
    return put(docs, {out: counter(automaton)(F.col(f"`{text_col}`"))})
