"""Piece ids of texts and texts of piece ids, each distinct marked word segmented once.

A text is marked: a space becomes the marker, and one marker goes before it. No piece of the
vocabulary has a marker after another character (building the model checks it), so no piece crosses
from a word into the markers of the next: a text falls into chunks, a run of markers with the word
behind it, that are segmented apart. Digits, line ends and tabs are chunks of their own where no
longer piece contains them. Each batch of texts becomes a table of its distinct chunks; a chunk the
worker has not met yet is segmented there, once, and the ids are joined back to the places where
chunks stand. Nothing is shuffled, a lost task is simply run again, and a worker keeps at most
``REMEMBERED`` chunks.

A chunk is segmented by merging: of all neighbouring symbols that make a piece, the pair with the
best score, then the leftmost, becomes one symbol, until none does. Symbols without a piece are
written as their bytes.

Decoding puts pieces together again: control pieces say nothing, bytes in a row are read as UTF-8
with a replacement character for each that cannot be read, markers become spaces, and the one that
was put before the text goes.

Defined results: a NULL text is read as empty; an empty text has no pieces besides the end id, and
NULL ids decode to the empty text; repeated rows are each encoded; an empty table gives no rows; a
column named like the result gives way to it.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import put

MARK = "▁"
#: Chunks a worker keeps.
REMEMBERED = 600_000
#: Characters of a chunk whose best pair is found by looking at all pairs.
FEW = 48
NONE = float("-inf")
#: Characters that are chunks of their own where no longer piece contains them.
APART = "0123456789\n\t"
#: Fixed value: what an id without a meaning decodes to.
UNKNOWN_TEXT = " ⁇ "


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("pairwright_each_byte", _each_byte)


@dataclass(frozen=True)
class Pieces:
    """A vocabulary of pieces; plain values, so that it travels to the workers."""

    ids: dict[str, int]  # pieces that texts are made of
    scores: dict[str, float]
    byte_ids: list[int]  # by byte; empty without byte pieces
    texts: list[str]  # by id
    kinds: bytes  # by id: p(iece), b(yte), c(ontrol) or u(nknown)
    unknown: int
    end: int
    apart: str
    shown: list[str | None] = field(init=False, default_factory=list)  # by id, if it can be alone

    def __post_init__(self) -> None:
        for text, kind in zip(self.texts, self.kinds):
            if kind == 98:  # b
                byte = int(text[1:-1], 16)
                self.shown.append(chr(byte) if byte < 128 else None)
            elif kind == 99:  # c
                self.shown.append("")
            else:
                self.shown.append(text.replace(MARK, " ") if kind == 112 else UNKNOWN_TEXT)
        crossing = next((p for p in self.ids if MARK in p.lstrip(MARK)), None)
        if crossing is not None:
            raise ValueError(f"the piece {crossing!r} crosses a marker: words cannot be cut apart")

    def chunks(self):
        """A pattern that takes a text apart; spaces stand for markers."""
        if not self.apart:
            return re.compile(" +[^ ]*|[^ ]+")
        apart = re.escape(self.apart)
        return re.compile(f" +[^ {apart}]*|[{apart}]|[^ {apart}]+")

    def segment(self, chunk: str) -> list[int]:
        """The ids of one chunk; spaces stand for markers."""
        symbols = list(chunk.replace(" ", MARK))
        symbols = self.merge_few(symbols) if len(symbols) <= FEW else self.merge_many(symbols)
        out: list[int] = []
        for symbol in symbols:
            known = self.ids.get(symbol)
            if known is not None:
                out.append(known)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in symbol.encode("utf-8"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def merge_few(self, symbols: list[str]) -> list[str]:
        """The best pair, then the leftmost, is found by looking at all."""
        get = self.scores.get
        pairs = [get(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while pairs:
            best = max(pairs)
            if best == NONE:
                break
            k = pairs.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = get(symbols[k] + symbols[k + 1], NONE)
            if k:
                pairs[k - 1] = get(symbols[k - 1] + symbols[k], NONE)
        return symbols

    def merge_many(self, symbols: list[str]) -> list[str]:
        """The same by a queue of pairs, for chunks of any length."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        scores = self.scores
        queue: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n:
                joined = symbols[left] + symbols[right]
                score = scores.get(joined)
                if score is not None:
                    heapq.heappush(queue, (-score, left, joined))

        for left in range(n - 1):
            offer(left)
        while queue:
            _, left, joined = heapq.heappop(queue)
            right = after[left]
            # an offer is out of date when one of its symbols has been merged with another
            if not symbols[left] or right >= n or symbols[left] + symbols[right] != joined:
                continue
            symbols[left], symbols[right] = joined, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [symbol for symbol in symbols if symbol]

    def decode(self, ids: Sequence[int]) -> str:
        try:
            text = "".join(map(self.shown.__getitem__, ids))
        except TypeError:  # a byte that is no character by itself
            text = self.decode_bytes(ids)
        # the marker before the first piece that says anything goes
        first = next((i for i in ids if self.kinds[i] != 99), None)
        marked = first is not None and self.kinds[first] == 112 and self.shown[first][:1] == " "
        return text[1:] if marked else text

    def decode_bytes(self, ids: Sequence[int]) -> str:
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if self.kinds[i] == 98:
                raw.append(int(self.texts[i][1:-1], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "pairwright_each_byte"))
                raw.clear()
            out.append(self.shown[i])
        out.append(raw.decode("utf-8", "pairwright_each_byte"))
        return "".join(out)


def read_pieces(path: str) -> Pieces:
    """The vocabulary of a piece model that merges by score and leaves texts as they are."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids: dict[str, int] = {}
    scores: dict[str, float] = {}
    byte_ids: list[int] = []
    texts: list[str] = []
    kinds = bytearray()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        texts.append(piece)
        if model.is_unknown(i):
            kinds += b"u"
        elif model.is_control(i):
            kinds += b"c"
        elif model.is_byte(i):
            kinds += b"b"
            byte_ids.append(i)
        else:
            kinds += b"p"
            ids[piece] = i
            scores[piece] = model.get_score(i)
    longer = set(chain.from_iterable(p for p in ids if len(p) > 1))
    return Pieces(
        ids=ids,
        scores=scores,
        byte_ids=byte_ids,
        texts=texts,
        kinds=bytes(kinds),
        unknown=model.unk_id(),
        end=model.eos_id(),
        apart="".join(c for c in APART if c not in longer),
    )


class ChunkTable(dict):
    """Ids of the distinct chunks met so far, by chunk, as the bytes of 32-bit numbers."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.pattern = pieces.chunks()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[chunk] = array("i", self.pieces.segment(chunk)).tobytes()
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text: those of its chunks, joined back by place."""
        if not text:
            return b""
        chunks = self.pattern.findall(" " + text.replace(MARK, " "))
        return b"".join(map(self.__getitem__, chunks))


def encoder(pieces: Pieces, with_end: bool):
    end = array("i", [pieces.end] if with_end else []).tobytes()

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ChunkTable(pieces)
        for texts in batches:
            flat, places = bytearray(), array("i", [0])
            for text in texts:
                flat += table.encode(text.as_py())
                flat += end
                places.append(len(flat) // 4)
            yield pa.ListArray.from_arrays(
                pa.array(memoryview(places), pa.int32()),
                pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)]),
            )

    return F.arrow_udf(encode, "array<int>")


def decoder(pieces: Pieces):
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            # one list at a time: all numbers of a batch as objects would fill the memory
            yield pa.array(
                (pieces.decode(ids.values.to_numpy().tolist() if ids.is_valid else ()) for ids in lists),
                pa.string(),
                size=len(lists),
            )

    return F.arrow_udf(decode, "string")


def encode_texts(
    docs: DataFrame,
    pieces: Pieces,
    text_col: str = "text",
    out: str = "ids",
    with_end: bool = True,
) -> DataFrame:
    """Documents with the ids of their text, and an end id unless told otherwise."""
    return put(docs, {out: encoder(pieces, with_end)(F.col(f"`{text_col}`"))})


def decode_ids(
    docs: DataFrame, pieces: Pieces, ids_col: str = "ids", out: str = "decoded"
) -> DataFrame:
    """Documents with the text their ids stand for."""
    return put(docs, {out: decoder(pieces)(F.col(f"`{ids_col}`"))})
