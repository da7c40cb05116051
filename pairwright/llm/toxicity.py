"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two strings sums over the subsequences of three letters they share, each weighted by
how far it is spread in either string, so an insult with letters in between, cut by dots or carrying
an ending is still close to the plain one. Spaced out letters are read as one word. It is divided by
powers of the strings' kernels with themselves, so that long words with many letters gain nothing.

A sentence is compared with a landmark through the word of it that is closest, and the Nyström map
turns the landmark similarities into coordinates in which a linear machine is trained. Landmarks are
the character sequences that tell toxic from clean documents best, grown as far as they go together,
and common clean words; there are as many as the evidence gives. Words of up to three letters can be
landmarks as a whole, and only equal words are similar to them.

Labels are those of documents, so a toxic document is a bag with at least one toxic sentence: the
machine starts from the sentence closest to the toxic landmarks and takes the highest scored one in
the next turn. Sentences with a landmark that hardly any clean document has are toxic in every turn,
and so are clean sentences with such a landmark that has a character put in, at every place; a third of these forms is kept for
the scale. The negative sentences are the highest scored ones of clean documents. A document's score is that of its highest scored sentence, put on a 0 to 1 scale by Platt's method on documents
the machine was not trained on.

Training sees a bounded sample of the labelled rows (``SAMPLE`` a label, texts of at most
``SAMPLE_BYTES``); scoring reads whole texts.

Defined results: NULL, empty and wordless texts get the score of a sentence without any similarity;
rows with a NULL label are not learned from; without both labels everything scores 0.5; repeated
rows score alike; an empty table gives no rows; a column named like the result is replaced.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import put
from pairwright.llm.near_duplicates import WordHashes, minima, shingles

#: Labelled documents taken for each label, about, and the longest text among them.
SAMPLE, SAMPLE_BYTES = 2000, 20_000
#: Letters of a shared subsequence, and the weight of each place it spreads over.
ORDER, DECAY = 3, 0.9
#: Landmarks of clean text, and the longest one of either. Shorter ones than SHORT are whole words.
CLEAN_MARKS, LONGEST_MARK, SHORT = 8, 9, 4
#: Letters put into landmarks to train on.
PUT_IN = "xzqaeionrst*."
#: Clean sentences that each such form is put into.
CONTEXTS = 6
#: Log likelihood ratio a toxic landmark must have: among a million sequences one by chance.
LEAST_EVIDENCE = 14.0
#: How many times as common as in clean documents a sure one is in toxic documents.
PURE = 50
#: Words are compared in pieces of this many characters, overlapping by half.
PIECE = 24
#: A word must share this part of a landmark's distinct letters to be compared with it.
SHARED = 0.7
#: The power of a word's own kernel that its similarities are divided by; a half is cosine.
ENDING = 0.5
#: The similarity is raised to this power, which is a kernel as well.
POWER = 3
#: Words of a text whose similarities a worker remembers, and words handled at a time.
REMEMBERED, AT_A_TIME = 200_000, 400_000
#: Similarities are gathered for so many words at a time.
GATHERED = 50_000

SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
SPACED_OUT = re.compile(r"(?<=(?<!\S)\S) (?=\S(?!\S))")


def sentences(text: str | None) -> list[list[str]]:
    """Lower-cased words of each sentence; letters set apart by single spaces are one word."""
    plain = SPACED_OUT.sub("", (text or "").lower())
    return [words for part in SENTENCE_END.split(plain) if (words := part.split())]


def pieces(word: str) -> list[str]:
    """A word, also without what parts its letters, cut where it is long."""
    inner = word.strip(string.punctuation)
    if not inner.isalpha():
        letters = "".join(c for c in inner if c.isalpha())
        if letters:
            return [*cut(inner), *cut(letters)]
    return cut(inner)


def cut(word: str) -> list[str]:
    if len(word) <= PIECE:
        return [word]
    return [word[k : k + PIECE] for k in range(0, len(word) - PIECE // 2, PIECE // 2)]


def codes(strings: list[str], width: int) -> np.ndarray:
    """Character codes, one row a string, 0 after its end."""
    return np.array(strings, f"U{width}").view(np.uint32).reshape(len(strings), width)


def letter_bits(rows: np.ndarray) -> np.ndarray:
    """Which letters a string has, as bits; rare letters may share one."""
    bits = np.left_shift(np.uint64(1), (rows * np.uint32(2654435769) >> np.uint32(26)).astype(np.uint64))
    bits[rows == 0] = 0
    return np.bitwise_or.reduce(bits, axis=1)


def raw_kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The subsequence kernel of row pairs, both as character codes.

    ``upto[i]`` holds, for each prefix of right, the weight of common subsequences of i letters in
    the prefixes read so far, spread up to their ends; one more letter of left is read at a time.
    """
    count, width = right.shape
    gap = np.arange(width)
    # spread[k, j]: what a match at place k weighs from place j on
    spread = np.where(gap[None, :] >= gap[:, None], DECAY ** (gap[None, :] - gap[:, None] + 2.0), 0)
    spread = spread.astype(np.float32)
    upto = [np.ones((count, width), np.float32)]
    upto += [np.zeros((count, width), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(count, np.float32)
    before = np.empty((count, width), np.float32)
    for place in range(left.shape[1]):
        letter = left[:, place]
        same = (right == letter[:, None]) & (letter != 0)[:, None]
        for i in range(ORDER - 1, -1, -1):
            if i == 0:
                before[:] = 1
            else:
                before[:, 0] = 0
                before[:, 1:] = upto[i][:, :-1]
            fresh = same * before
            if i == ORDER - 1:
                total += fresh.sum(axis=1) * DECAY**2
            else:
                later = upto[i + 1]
                later *= DECAY
                later += fresh @ spread
    return total


class Similarity:
    """Similarities of words with a list of landmarks, from 0 to 1."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.width = max(map(len, landmarks), default=1)
        self.marks = codes(landmarks, self.width)
        self.bits = letter_bits(self.marks)
        self.needed = np.ceil(SHARED * np.bitwise_count(self.bits)).astype(np.uint8)
        # short landmarks are words, and only an equal word is similar to them
        self.short = {m: k for k, m in enumerate(landmarks) if len(m) < SHORT}
        self.needed[list(self.short.values())] = 255
        self.own = np.maximum(raw_kernel(self.marks, self.marks), DECAY ** (2 * ORDER))

    def of_words(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        owner, parts = [], []
        for k, word in enumerate(words):
            for part in pieces(word):
                owner.append(k)
                parts.append(part)
                if part in self.short:
                    out[k, self.short[part]] = 1
        owner = np.array(owner)
        length = np.array([len(p) for p in parts])
        for low, high in ((ORDER - 1, 8), (8, 12), (12, PIECE)):
            chosen = np.flatnonzero((length > low) & (length <= high))
            for start in range(0, len(chosen), 20_000):
                some = chosen[start : start + 20_000]
                rows = codes([parts[k] for k in some], high)
                bits = letter_bits(rows)
                shared = np.bitwise_count(bits[:, None] & self.bits[None, :])
                which, mark = np.nonzero(shared >= self.needed[None, :])
                own = np.zeros(len(rows), np.float32)
                used = np.unique(which)
                for at in range(0, len(used), 5_000):
                    own[used[at : at + 5_000]] = raw_kernel(*[rows[used[at : at + 5_000]]] * 2)
                for at in range(0, len(which), 20_000):
                    w, m = which[at : at + 20_000], mark[at : at + 20_000]
                    value = raw_kernel(rows[w], self.marks[m]) / self.own[m]
                    # what else the word holds counts against it, but an ending not much
                    rest = np.maximum(own[w], self.own[m]) / self.own[m]
                    value = np.minimum(value * rest**-ENDING, 1) ** POWER
                    np.maximum.at(out, (owner[some[w]], m), value)
        return out


class Remembered(dict):
    """Row numbers of words in a matrix of similarities that grows with new words."""

    def __init__(self, similarity: Similarity):
        super().__init__()
        self.similarity = similarity
        self.rows = np.zeros((0, len(similarity.landmarks)), np.float32)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.rows) + len(self.new)
        self.new.append(word)
        return number

    def settle(self) -> None:
        if self.new:
            self.rows = np.concatenate([self.rows, self.similarity.of_words(self.new)])
            self.new = []

    def forget(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()
            self.rows = self.rows[:0]


def sentence_rows(numbers: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each sentence and landmark the highest similarity of its words."""
    out = np.empty((len(starts), rows.shape[1]), np.float32)
    bounds = np.append(starts, len(numbers))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + GATHERED, "right")) - 1)
        span = numbers[bounds[first] : bounds[last]]
        if last == first + 1 and len(span) > GATHERED:  # one very long sentence
            parts = [rows[span[k : k + GATHERED]].max(axis=0) for k in range(0, len(span), GATHERED)]
            out[first] = np.max(parts, axis=0)
        else:
            out[first:last] = np.maximum.reduceat(rows[span], starts[first:last] - starts[first], axis=0)
        first = last
    return out


def features(texts: list[str | None], known: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Sentence rows of the texts, and the text each belongs to."""
    numbers: list[int] = []
    starts: list[int] = []
    owner: list[int] = []
    for k, text in enumerate(texts):
        for words in sentences(text):
            starts.append(len(numbers))
            owner.append(k)
            numbers.extend(map(known.__getitem__, words))
    known.settle()
    if not starts:
        return np.zeros((0, known.rows.shape[1]), np.float32), np.zeros(0, int)
    return sentence_rows(np.array(numbers), np.array(starts), known.rows), np.array(owner)


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, texts: list[str | None], known: Remembered) -> np.ndarray:
        rows, owner = features(texts, known)
        best = np.full(len(texts), self.bias)
        np.maximum.at(best, owner, rows @ self.weights + self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -500, 500)))


def unlike(texts: list[str]) -> list[str]:
    """The texts without near copies of earlier ones, which would make chance words look telling."""
    hashes, seen, kept = WordHashes(), set(), []
    for text in texts:
        least = {(k, int(x)) for k, x in enumerate(minima(shingles(text, hashes))[:4])}
        if not least & seen:
            kept.append(text)
        seen |= least
    return kept


def word_counts(texts: list[str]) -> Counter:
    """In how many texts each word of letters occurs."""
    counts: Counter = Counter()
    for text in texts:
        counts.update(set(re.findall(r"[^\W\d_]+", text.lower())))
    return counts


def choose_landmarks(toxic: list[str], clean: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Letter sequences that tell the two apart best, common clean words, and the sure ones of the first.

    The best sequence is taken, the words it is part of are set aside, and so on: each landmark
    stands for words that no earlier one is part of.
    """
    toxic, clean = unlike(toxic), unlike(clean)
    there, here = word_counts(toxic), word_counts(clean)
    part_toxic = len(toxic) / (len(toxic) + len(clean))
    # so often at least must a sequence occur to have the evidence needed, and so must its start
    least = max(4, int(LEAST_EVIDENCE / -np.log(part_toxic)))
    counts: dict[str, list[int]] = {}
    for size in range(SHORT, LONGEST_MARK + 1):
        found: Counter = Counter()
        for word, n in there.items():
            for k in range(len(word) - size + 1):
                if size == SHORT or word[k : k + size - 1] in counts:
                    found[word[k : k + size]] += n
        counts |= {part: [n, 0] for part, n in found.items() if n >= least}
    short = {w: n for w, n in there.items() if len(w) < SHORT and n >= least}
    counts |= {word: [n, here[word]] for word, n in short.items()}
    inside: dict[str, set[str]] = {part: {part} & short.keys() for part in counts}
    for words, place in ((there, 0), (here, 1)):
        for word, n in words.items():
            for size in range(SHORT, LONGEST_MARK + 1):
                for k in range(len(word) - size + 1):
                    if (part := word[k : k + size]) in counts:
                        if place:
                            counts[part][1] += n
                        else:
                            inside[part].add(word)

    def worth(part: str) -> float:
        """The log likelihood ratio of a sequence being as common in both, if it isn't."""
        a, b = counts[part]
        if a < least or a * (1 - part_toxic) < 4 * b * part_toxic:
            return 0.0
        ratio = a * np.log(a / ((a + b) * part_toxic))
        if b:
            ratio += b * np.log(b / ((a + b) * (1 - part_toxic)))
        return ratio * (1 + 0.05 * len(part)) if ratio >= LEAST_EVIDENCE else 0.0

    marks: list[str] = []
    telling: list[str] = []
    value = {part: worth(part) for part in counts}
    while value:
        best = max(value, key=lambda part: (value[part], part))
        if value[best] <= 0:
            break
        marks.append(best)
        a, b = counts[best]
        sure = value[best] >= 2 * LEAST_EVIDENCE
        if sure and a * (1 - part_toxic) >= PURE * b * part_toxic:
            telling.append(best)
        for word in list(inside[best]):
            for size in range(SHORT, LONGEST_MARK + 1):
                for k in range(len(word) - size + 1):
                    part = word[k : k + size]
                    if part in value and word in inside[part]:
                        inside[part].discard(word)
                        counts[part][0] -= there[word]
                        counts[part][1] -= here[word]
                        value[part] = worth(part)
        value.pop(best)
    words = {w: n for w, n in here.items() if SHORT <= len(w) <= LONGEST_MARK}
    common = sorted(words, key=lambda w: (-words[w], w))[:CLEAN_MARKS]
    return marks, common, telling


def with_letter_put_in(mark: str) -> list[str]:
    """A landmark with one character put in, at every place after the first; each place gets three."""
    return [
        mark[:k] + PUT_IN[(3 * k + n) % len(PUT_IN)] + mark[k:]
        for k in range(1, len(mark) + 1)
        for n in range(3)
    ]


def train_machine(rows: np.ndarray, signs: np.ndarray, turns: int = 30) -> tuple[np.ndarray, float]:
    """A linear support vector machine by coordinate descent on its dual; both sides weigh alike."""
    x = np.column_stack([rows, np.ones(len(rows))]).astype(float)
    cost = np.where(signs > 0, len(signs) / (2 * (signs > 0).sum()), len(signs) / (2 * (signs < 0).sum()))
    norm = (x**2).sum(axis=1)
    alpha = np.zeros(len(x))
    w = np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(turns):
        for k in order.permutation(len(x)):
            slack = signs[k] * (x[k] @ w) - 1
            new = min(max(alpha[k] - slack / norm[k], 0.0), cost[k])
            if new != alpha[k]:
                w += (new - alpha[k]) * signs[k] * x[k]
                alpha[k] = new
    return w[:-1], float(w[-1])


def platt(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through smoothed targets, by Newton's method."""
    yes, no = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.column_stack([values, np.ones(len(values))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (p - target) + 1e-3 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        w -= step / max(1.0, np.abs(step).max() / 5)
    return float(w[0]), float(w[1])


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """Train on documents and their labels; None unless there are both kinds."""
    marked = np.array(labels)
    if len(set(labels)) < 2:
        return None
    toxic, clean, telling = choose_landmarks(
        [t for t, y in zip(texts, labels, strict=True) if y],
        [t for t, y in zip(texts, labels, strict=True) if not y],
    )
    landmarks = list(dict.fromkeys(toxic + clean)) or ["none"]
    known = Remembered(Similarity(landmarks))
    rows, owner = features(texts, known)
    # Nyström: coordinates in which the inner product is the kernel between landmarks
    between = known.similarity.of_words(landmarks).astype(float)
    between = (between + between.T) / 2
    value, vector = np.linalg.eigh(between)
    roots = np.where(value > 1e-3, 1 / np.sqrt(np.maximum(value, 1e-3)), 0)
    to_space = (vector * roots) @ vector.T
    space = rows @ to_space
    held = np.arange(len(texts)) % 3 == 2  # for the scale, not for the machine
    leading = rows[:, : len(toxic)].sum(axis=1) if toxic else rows.sum(axis=1)
    # insults seen in hardly any clean document: what holds one is a toxic sentence of a toxic
    # document, and so is a clean one into which it is put with one more character
    forms = [form for m in telling if len(m) >= SHORT for form in with_letter_put_in(m)]
    around = np.flatnonzero(marked[owner] == 0)
    altered = space[:0]
    if forms and len(around):
        drawn = np.random.default_rng(5).choice(around, (CONTEXTS, len(forms)))
        alike = known.similarity.of_words(forms)
        altered = np.concatenate([np.maximum(alike, rows[some]) for some in drawn]) @ to_space
    kept_back = np.tile(np.arange(len(forms)) % 3 == 2, CONTEXTS)[: len(altered)]
    columns = [landmarks.index(m) for m in telling]
    plain = np.flatnonzero((rows[:, columns] > 0.999).any(axis=1) & (marked[owner] == 1))
    plain = plain[~held[owner[plain]]]
    weights, bias = np.zeros(len(landmarks)), 0.0
    for _ in range(3):
        order = np.lexsort((-leading, owner))
        top = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        second = order[np.r_[False, owner[order][1:] == owner[order][:-1]]]
        more = second[marked[owner[second]] == 0][:: max(1, len(second) // 4000)]
        use = np.concatenate([top[~held[owner[top]]], more[~held[owner[more]]], plain])
        use = np.unique(use)
        signs = np.where(marked[owner[use]] == 1, 1.0, -1.0)
        if len(set(signs.tolist())) < 2:
            break
        learned = altered[~kept_back]
        weights, bias = train_machine(
            np.concatenate([space[use], learned]), np.append(signs, np.ones(len(learned)))
        )
        leading = space @ weights + bias
    best = np.full(len(texts), bias)
    np.maximum.at(best, owner, leading if len(leading) else np.zeros(0))
    scale = held if len(set(marked[held].tolist())) == 2 and held.sum() >= 50 else ~held
    # forms the machine was not trained on belong to the scale as well
    unseen = altered[kept_back] @ weights + bias
    slope, offset = platt(
        np.append(best[scale], unseen), np.append(marked[scale], np.ones(len(unseen)))
    )
    return Model(landmarks, to_space @ weights, bias, slope, offset)


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = SAMPLE,
) -> list[tuple[str, int]]:
    """About ``most`` labelled texts of each label, chosen by a hash of their ids.

    An id with both labels counts as toxic; of repeated ids one row is taken.
    """
    marked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .filter("y in (0, 1) and id is not null")
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    count = {r.y: r.n for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("y") == 1, most / max(count.get(1, 0), 1)).otherwise(
        most / max(count.get(0, 0), 1)
    )
    lot = F.pmod(F.xxhash64("id"), F.lit(10**6)) / 10.0**6
    chosen = marked.filter(lot < share)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = (
        # the ids chosen are about 2 * most rows, whatever the size of the tables
        texts.filter(F.octet_length("text") <= SAMPLE_BYTES)
        .join(F.broadcast(chosen), "id")
        .dropDuplicates(["id"])
        .collect()
    )
    found.sort(key=lambda r: (r.id, r.text))
    return [(r.text, r.y) for r in found]


def scorer(model: Model | None):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Remembered(Similarity(model.landmarks)) if model else None
        for texts in batches:
            if model is None:
                yield pd.Series(np.full(len(texts), 0.5))
                continue
            out = []
            held: list[str | None] = []
            length = 0
            for text in [*texts, ...]:
                if text is not ...:
                    held.append(text)
                    length += len(text or "") // 6
                if held and (text is ... or length >= AT_A_TIME):
                    out.append(model.scores(held, known))
                    known.forget()
                    held, length = [], 0
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return F.pandas_udf(score, "double")


def score_documents(
    docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score"
) -> DataFrame:
    """Documents with a score from 0 to 1; higher means likelier toxic."""
    return put(docs, {out: scorer(model)(F.col(f"`{text_col}`"))})


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model | None:
    sample = labelled_sample(docs, labels, label_col, id_col, text_col)
    return fit([t for t, _ in sample], [y for _, y in sample])
