"""Every query and stage on odd rows, on repeated ones and on empty tables."""

import random

import corpus
import pytest

import corpus_pipeline
from pairwright.llm.queries import QUERIES

PER_DOCUMENT = [n for n in QUERIES if not n.startswith(("op4_", "op12_"))]
NOT_FINITE = float("nan"), float("inf"), 0.0


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(3)
    good = [rng.gauss(0, 1) for _ in range(8)]
    vectors = [
        (1, None, 1), (2, [], 1), (3, [0.0] * 8, 1), (4, [None, *good[1:]], 1),
        (5, [NOT_FINITE[0], *good[1:]], 1), (6, [NOT_FINITE[1], *good[1:]], 1), (7, good, None),
        (8, good, 1), (9, good, 1), (9, good, 1), (10, [3 * x for x in good], 1),
        (11, good[:4], 1), (12, good, 2), (None, good, 1),
    ]
    benchmark = [(1, None), (2, " ,; "), (3, "Same text here for all"), (None, "one"), (3, "one")]
    root = tmp_path_factory.mktemp("odd")
    return corpus.write_tables(
        spark, root, corpus.odd_documents(), {5}, benchmark, vectors
    )


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return corpus.write_tables(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_odd_documents_give_one_row_each(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    assert len(rows) == len(corpus.odd_documents())
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d[0]) for d in corpus.odd_documents())
    assert "kept" not in {v for r in rows for v in r}


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_values_for_null_and_empty_texts(spark, odd):
    def rows(name):
        return {r.doc_id: r for r in QUERIES[name](spark, odd).collect() if r.doc_id in (1, 2, 3)}

    assert len({r.score for r in rows("op1_toxicity").values()}) == 1
    assert {(r.size, r.taken) for r in rows("op2_mix_sources").values()} == {(0, 0)}
    assert {(r.n_words, r.contaminated) for r in rows("op3_decontaminate").values()} == {(0, False)}
    assert {r.n_removed for r in rows("op5_line_dedup").values()} == {0}
    assert {(r.lang_pred, r.score) for r in rows("op6_language_id").values()} == {("und", 0.0)}
    assert {k: r.size for k, r in rows("op7_virtual_slots").items()} == {1: 1, 2: 1, 3: 5}
    assert {(r.n_words, r.n_tokens) for r in rows("op8_token_counts").values()} == {(0, 0)}
    assert {r.spans for r in rows("op9_personal_data").values()} == {""}
    near = rows("op10_minhash_near_dedup")
    assert {k: (r.n_shingles, r.component_id) for k, r in near.items()} == {
        1: (0, 1), 2: (0, 2), 3: (0, 3)}


def test_repeated_rows_and_copies(spark, odd):
    near = QUERIES["op10_minhash_near_dedup"](spark, odd).collect()
    assert {r.component_id for r in near if r.doc_id in (7, 8)} == {7}
    assert [r.component_id for r in near if r.doc_id is None] == [None, None]
    assert all(r.kept for r in near if r.doc_id is None)
    # the repeated line stays in the first document, and in the one without an id
    lines = QUERIES["op5_line_dedup"](spark, odd).collect()
    assert {r.doc_id: r.n_removed for r in lines if r.doc_id != 9} == {
        1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 1, None: 0}


def test_embeddings_that_cannot_link(spark, odd):
    got = QUERIES["op4_embedding_links"](spark, odd).collect()
    linked = {r.vec_id: (r.n_links, r.component_id) for r in got if r.n_links}
    assert linked == {8: (2, 8), 9: (2, 8), 10: (2, 8)}
    assert {r.vec_id: r.component_id for r in got if not r.n_links} == {
        k: k for k in (1, 2, 3, 4, 5, 6, 7, 11, 12, None)}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("which", ["odd", "empty"])
def test_stages_on_odd_and_empty_tables(spark, request, name, which):
    root = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, root)
    rows = got.collect()
    if name != "sharding":
        assert got.columns == docs.columns
    if which == "empty":
        assert rows == []
    elif name == "near_duplicates":
        assert sorted(str(r.doc_id) for r in rows) == sorted(
            ["1", "2", "3", "4", "5", "6", "7", "9", "None", "None"])
    elif name == "decontamination":
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, None} and len(rows) == 7
    elif name == "sharding":
        assert len(rows) == len(corpus.odd_documents())


def test_pipeline_runs_on_odd_and_empty_tables(spark, odd, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert {r.law for r in corpus_pipeline.run(spark, odd).collect()} == {"bytes"}
