"""Pieces against the library that defines them."""

import hashlib
import random

import corpus
import public_tokenizers
import pytest
import sentencepiece

from pairwright.llm import sentence_pieces
from pairwright.llm.queries import QUERIES
from pairwright.llm.sentence_pieces import ChunkTable, Pieces, decode_ids, encode_texts, read_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARKS = [
    *"ab e\n\t 1 2▁▁  .\r\0é日本𝔘🙂ﬁ<>/s", "é", "the ", "    ", "</s>", "<unk>", "<0x41>", "﻿",
    " ", "　",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def pieces():
    return read_pieces(MODEL)


def numbers(ids):
    return list(memoryview(ids).cast("i"))


def test_random_texts_encode_and_decode_as_in_the_library(library, pieces):
    rng = random.Random(3)
    table = ChunkTable(pieces)
    texts = ["".join(rng.choices(MARKS, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, "▁" * 1000, " " * 1000, "0" * 300, "日" * 500]
    texts += [r[1] for r in corpus.documents()[0]]
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert [*numbers(table.encode(text)), pieces.end] == ids, text
        assert pieces.decode(ids) == library.decode(ids), text


def test_any_ids_decode_as_in_the_library(library, pieces):
    rng = random.Random(4)
    for _ in range(3000):
        ids = [
            rng.choice([rng.randrange(32000), rng.randrange(260), 259, 28705, 0, 1, 2])
            for _ in range(rng.randint(0, 12))
        ]
        assert pieces.decode(ids) == library.decode(ids), ids


def test_a_table_that_is_full_starts_again(library, pieces, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 3)
    table = ChunkTable(pieces)
    text = "one two three four five six one two"
    assert numbers(table.encode(text)) == library.encode(text)
    assert len(table) <= 3


def test_a_piece_across_a_marker_is_refused():
    with pytest.raises(ValueError, match="crosses a marker"):
        Pieces({"a▁b": 0}, {"a▁b": 0.0}, [], ["a▁b"], b"p", 0, 0, "")


def test_columns_and_odd_texts(spark, library, pieces):
    rows = [(1, None), (2, ""), (3, " "), (4, "two words"), (4, "two words"), (None, "日\n1")]
    docs = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "'x' AS Ids")
    encoded = encode_texts(docs, pieces)
    assert encoded.columns == ["id", "text", "ids"]
    got = decode_ids(encoded, pieces).collect()
    assert [list(r.ids) for r in got] == [[*library.encode(t or ""), 2] for _, t in rows]
    assert [r.decoded for r in got] == [t or "" for _, t in rows]
    assert encode_texts(docs, pieces, with_end=False).first().ids == []
    nothing = spark.createDataFrame([(None,)], "ids array<int>")
    assert decode_ids(nothing, pieces).first().decoded == ""
    assert encode_texts(docs.limit(0), pieces).collect() == []


def test_query_against_the_library(spark, tmp_path, library):
    rows, _ = corpus.documents(seed=12)
    root = corpus.write_tables(spark, tmp_path, rows + corpus.odd_documents())
    got = QUERIES["op11_sentence_pieces"](spark, root).collect()
    assert len(got) == len(rows) + len(corpus.odd_documents())

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def expected(doc_id, text):
        ids = library.encode(text or "", add_eos=True)
        return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))

    want = [expected(r[0], r[1]) for r in rows + corpus.odd_documents()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
