"""Language of code-switched text by a linear-chain conditional random field.

Each word is a node. Its features are the character sequences of one to four letters of the word
with its ends marked, so affixes are among them, and the word itself where it is in the lexicon, the
commonest words of each language in the training texts. Transitions between the languages of
neighbouring words are learned, from training lines in which pieces of texts of different languages
follow each other. A run of more than ``PIECE`` letters,
as in scripts without spaces, is several nodes: pieces of it, whose inner cuts are not marked as
ends. Forward-backward gives each word its probabilities, over the chain of a whole
text, and a text gets the language with the highest mean probability; that mean is its score.

A chain is long and the states are few, so forward-backward runs over the texts of a batch at once:
the chain is cut into blocks, the product of a block's transitions is computed for all blocks
together, the blocks are chained by these products, and then all blocks are filled in together. This
is exact, and the time does not depend on how long the single texts are.

Training sees a bounded sample (about ``SAMPLE`` texts a language, of at most ``SAMPLE_BYTES``; of a
language that has longer texts only, about ``LONG_SAMPLE`` of those, whole); prediction reads whole
texts. All languages are learned. Texts are handled in batches that shrink as the languages grow.

Defined results: a NULL text and a text without letters are ``und`` with score 0; rows with a NULL
language are not learned from; if there is nothing to learn from, all texts are ``und``; repeated
rows get the same result; an empty table gives no rows; a column named like the result is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import put

SAMPLE, SAMPLE_BYTES, LONG_SAMPLE = 400, 20_000, 10
#: Hashed features, lexicon words of each language, and the longest character sequence.
FEATURES, LEXICON, SEQUENCE = 2**15, 500, 4
#: Training lines a language, their words, and rounds over them.
LINES, LINE_WORDS, ROUNDS = 400, 24, 4
#: The most characters of a word that are one node, and the mark of a cut inside a word.
PIECE, CUT = 32, "\0"
#: Words of a block, and the most words a worker remembers and handles at a time.
BLOCK, REMEMBERED, AT_A_TIME = 128, 200_000, 500_000
#: The most numbers, a word's for each language, that it remembers or handles at a time.
NUMBERS = 4_000_000

# Letters with the marks that stand on them; numerals such as ½, ² or Ⅷ are none.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+(?:['’]\p{L}[\p{L}\p{M}]*+)*+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; of a longer one than a piece its pieces, marked where it was cut."""
    found = WORD.findall((text or "").lower())
    if max(map(len, found), default=0) <= PIECE:
        return found
    return [piece for word in found for piece in pieces(word)]


def pieces(word: str) -> list[str]:
    count = -(-len(word) // PIECE)
    bounds = [len(word) * k // count for k in range(count + 1)]
    return [
        (CUT if a else "") + word[a:b] + (CUT if b < len(word) else "")
        for a, b in pairwise(bounds)
    ]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character sequences of words: feature numbers, and where each word's begin."""
    marked = [f"^{w}$" for w in words]
    marked = [w.replace(f"^{CUT}", "").replace(f"{CUT}$", "") if CUT in w else w for w in marked]
    width = max(map(len, marked))
    rows = np.array(marked, f"U{width}").view(np.uint32).reshape(len(words), width)
    rows = np.pad(rows, ((0, 0), (0, SEQUENCE)))
    found, there = [], []
    code = np.zeros((len(words), width), np.uint32)
    for size in range(1, SEQUENCE + 1):
        last = rows[:, size - 1 : size - 1 + width]
        code = (code ^ last) * np.uint32(0x9E3779B1)
        code ^= code >> 15
        found.append(code % np.uint32(FEATURES))
        here = last != 0
        there.append(here if size == 1 else there[-1] & here)
    number = np.concatenate(found, axis=1)
    present = np.concatenate(there, axis=1)
    starts = np.concatenate([[0], np.cumsum(present.sum(axis=1))])
    return number[present].astype(np.int64), starts


@dataclass
class Model:
    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # a row for each hashed feature, then one for each lexicon word
    moves: np.ndarray  # transition weights
    first: np.ndarray  # weights of a text's first word

    def emissions(self, words: list[str]) -> np.ndarray:
        """The weight of each language for each word."""
        number, starts = word_features(words)
        total = np.add.reduceat(self.weights[number], starts[:-1], axis=0)
        total /= np.maximum(np.diff(starts), 1)[:, None] ** 0.5
        known = np.array([self.lexicon.get(w, -1) for w in words])
        total[known >= 0] += self.weights[FEATURES + known[known >= 0]]
        return total


def softened(x: np.ndarray) -> np.ndarray:
    return np.exp(x - x.max(axis=-1, keepdims=True))


def scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(
    emissions: np.ndarray, begins: np.ndarray, moves: np.ndarray, first: np.ndarray
) -> np.ndarray:
    """The probability of each state for each word of chains laid end to end."""
    return forward_backward(emissions, begins, moves, first)[0]


def forward_backward(
    emissions: np.ndarray,
    begins: np.ndarray,
    moves: np.ndarray,
    first: np.ndarray,
    with_pairs: bool = False,
) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities of words, and how often each state is expected to follow each other.

    Chains are laid end to end; ``begins`` marks their first words. The probability of a pair of
    states is forward weight, transition, emission and backward weight, over their sum. Pairs are
    only added up if asked for.
    """
    count, states = emissions.shape
    blocks = -(-count // BLOCK)
    extra = blocks * BLOCK - count
    seen = softened(np.pad(emissions, ((0, extra), (0, 0)))).reshape(blocks, BLOCK, states)
    begins = np.pad(begins, (0, extra), constant_values=True).reshape(blocks, BLOCK)
    move = np.exp(moves - moves.max())
    start = scaled(softened(first))
    # the product of a block's steps, one row for each state before it
    through = np.broadcast_to(np.eye(states), (blocks, states, states)).copy()
    for k in range(BLOCK):
        step = through @ move
        fresh = begins[:, k]
        step[fresh] = through[fresh].sum(axis=2, keepdims=True) * start
        through = step * seen[:, k, None, :]
        through /= through.sum(axis=(1, 2), keepdims=True)
    before = np.empty((blocks, states))
    after = np.empty((blocks, states))
    state = start
    for b in range(blocks):
        before[b] = state
        state = state @ through[b]
        state = state / state.sum()
    state = np.full(states, 1.0 / states)
    for b in range(blocks - 1, -1, -1):
        after[b] = state
        state = through[b] @ state
        state = state / state.sum()
    ahead = np.empty((blocks, BLOCK, states))
    state = before
    for k in range(BLOCK):
        step = state @ move
        step[begins[:, k]] = start
        state = scaled(step * seen[:, k])
        ahead[:, k] = state
    state = after
    pairs = np.zeros((states, states))
    for k in range(BLOCK - 1, -1, -1):
        ahead[:, k] = scaled(ahead[:, k] * state)
        step = seen[:, k] * state
        fresh = begins[:, k]
        if with_pairs and not fresh.all():
            # the forward weights of the word before are not yet joined with the backward ones
            left = (ahead[:, k - 1] if k else before)[~fresh]
            joint = left[:, :, None] * move * step[~fresh][:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        state = step @ move.T
        state[fresh] = (step[fresh] @ start)[:, None]
        state = scaled(state)
    return ahead.reshape(-1, states)[:count], pairs


def training_lines(
    texts: list[tuple[str, str]], languages: list[str]
) -> list[tuple[list[str], np.ndarray]]:
    """Lines of words with their languages; half of them change language once or twice."""
    draw = np.random.default_rng(11)
    words = {lang: [w for t, g in texts if g == lang if (w := words_of(t))] for lang in languages}
    number = {lang: k for k, lang in enumerate(languages)}
    usable = [lang for lang in languages if words[lang]]
    lines = []
    for lang in usable:
        for k in range(LINES):
            parts = [lang]
            if k % 2 and len(usable) > 1:
                parts += [usable[int(x)] for x in draw.integers(0, len(usable), 1 + k % 4 // 2)]
            size = LINE_WORDS // len(parts)
            line: list[str] = []
            tags: list[int] = []
            for part in parts:
                text = words[part][int(draw.integers(0, len(words[part])))]
                at = int(draw.integers(0, max(1, len(text) - size + 1)))
                piece = text[at : at + size]
                line += piece
                tags += [number[part]] * len(piece)
            lines.append((line, np.array(tags)))
    return lines


def fit(texts: list[tuple[str, str]]) -> Model | None:
    """Maximise the likelihood of the languages of training lines by adaptive gradient steps."""
    languages = sorted({g for _, g in texts})
    lines = training_lines(texts, languages)
    if not lines:
        return None
    common: dict[str, int] = {}
    for lang in languages:
        counts = Counter(w for t, g in texts if g == lang for w in set(words_of(t)))
        for word, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            common.setdefault(word, len(common))
    states = len(languages)
    model = Model(
        languages,
        common,
        np.zeros((FEATURES + len(common), states)),
        np.zeros((states, states)),
        np.zeros(states),
    )
    weight_power = np.full(model.weights.shape, 1e-3)
    move_power, first_power = np.full((states, states), 1e-3), np.full(states, 1e-3)
    order = np.random.default_rng(13)
    for turn in range(ROUNDS):
        rate = 0.3 / (1 + turn)
        shuffled = order.permutation(len(lines))
        for at in range(0, len(lines), 32):
            batch = [lines[k] for k in shuffled[at : at + 32]]
            words = [w for line, _ in batch for w in line]
            tags = np.concatenate([t for _, t in batch])
            begins = np.zeros(len(words), bool)
            begins[np.cumsum([0, *[len(line) for line, _ in batch[:-1]]])] = True
            emit = model.emissions(words)
            likely, pull = forward_backward(emit, begins, model.moves, model.first, True)
            wrong = likely.copy()
            wrong[np.arange(len(words)), tags] -= 1
            number, starts = word_features(words)
            sizes = np.diff(starts)
            owner = np.repeat(np.arange(len(words)), sizes)
            slope = np.zeros_like(model.weights)
            np.add.at(slope, number, (wrong / np.sqrt(np.maximum(sizes, 1))[:, None])[owner])
            known = np.array([common.get(w, -1) for w in words])
            np.add.at(slope, FEATURES + known[known >= 0], wrong[known >= 0])
            weight_power += slope**2
            model.weights -= rate * slope / np.sqrt(weight_power)
            # pairs of neighbours: expected by the model less seen
            inner = np.flatnonzero(~begins)
            np.add.at(pull, (tags[inner - 1], tags[inner]), -1.0)
            move_power += pull**2
            model.moves -= rate * pull / np.sqrt(move_power)
            heads = np.flatnonzero(begins)
            pull_first = likely[heads].sum(axis=0) - np.bincount(tags[heads], minlength=states)
            first_power += pull_first**2
            model.first -= rate * pull_first / np.sqrt(first_power)
    return model


class Emissions(dict):
    """Row numbers of words in a matrix of emissions that grows with new words."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.rows = np.zeros((0, len(model.languages)))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.rows) + len(self.new)
        self.new.append(word)
        return number

    def settle(self) -> None:
        for k in range(0, len(self.new), 20_000):
            self.rows = np.concatenate([self.rows, self.model.emissions(self.new[k : k + 20_000])])
        self.new = []

    def forget(self) -> None:
        if len(self) > min(REMEMBERED, NUMBERS // len(self.model.languages)):
            self.clear()
            self.rows = self.rows[:0]


def label_words(model: Model, lines: list[list[str]], known: Emissions) -> np.ndarray:
    """The probabilities of each language for all words of the lines, one chain a line."""
    numbers = [known[w] for line in lines for w in line]
    known.settle()
    begins = np.zeros(len(numbers), bool)
    sizes = np.array([len(line) for line in lines])
    begins[np.concatenate([[0], np.cumsum(sizes)[:-1]])[sizes > 0]] = True
    return marginals(known.rows[np.array(numbers)], begins, model.moves, model.first)


def label_texts(model: Model, texts: list[str | None], known: Emissions) -> list[tuple[str, float]]:
    lines = [words_of(t) for t in texts]
    out = [("und", 0.0)] * len(texts)
    filled = [k for k, line in enumerate(lines) if line]
    if filled:
        likely = label_words(model, [lines[k] for k in filled], known)
        sizes = np.array([len(lines[k]) for k in filled])
        mean = np.add.reduceat(likely, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        best = mean.argmax(axis=1)
        for k, b, share in zip(filled, best, mean, strict=True):
            out[k] = (model.languages[b], float(min(share[b], 1.0)))
    return out


def labeller(model: Model | None):
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Emissions(model) if model else None
        most = min(AT_A_TIME, NUMBERS // len(model.languages)) if model else AT_A_TIME
        for texts in batches:
            out: list[tuple[str, float]] = []
            held: list[str | None] = []
            length = 0
            for text in [*texts, ...]:
                if text is not ...:
                    held.append(text)
                    length += len(text or "") // 6
                if held and (text is ... or length >= most):
                    out += label_texts(model, held, known) if model else [("und", 0.0)] * len(held)
                    if known is not None:
                        known.forget()
                    held, length = [], 0
            yield pd.DataFrame(out, columns=["lang", "score"])

    return F.pandas_udf(label, "lang string, score double")


def labelled_sample(
    docs: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    most: int = SAMPLE,
) -> list[tuple[str, str]]:
    """About ``most`` texts of each language, chosen by a hash of their ids."""
    rows = docs.filter(learn_from & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    short = F.octet_length("text") <= SAMPLE_BYTES
    counts = (
        rows.filter("text is not null")
        .groupBy("lang")
        .agg(F.count_if(short).alias("n_short"), F.count(F.lit(1)).alias("n"))
    )
    some_short = F.col("n_short") > 0
    shares = counts.select(
        "lang",
        some_short.alias("only_short"),
        F.when(some_short, most / F.col("n_short")).otherwise(LONG_SAMPLE / F.col("n")).alias("share"),
    )
    lot = F.pmod(F.xxhash64("id"), F.lit(10**6)) / 10.0**6
    chosen = rows.join(shares, "lang").filter((lot < F.col("share")) & (short | ~F.col("only_short")))
    found = chosen.dropDuplicates(["id"]).select("id", "text", "lang").collect()
    found.sort(key=lambda r: (r.id, r.lang, r.text))
    return [(r.text, r.lang) for r in found]


def label_documents(
    docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "language"
) -> DataFrame:
    """Documents with a struct: lang, score."""
    return put(docs, {out: labeller(model)(F.col(f"`{text_col}`"))})
