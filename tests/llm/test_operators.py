"""The corpus operators against brute force on small tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairwright.llm import (
    decontamination,
    embedding_links,
    graph,
    language_id,
    line_dedup,
    mixing,
    near_duplicates,
    pii,
    sharding,
    token_counts,
    toxicity,
)
from pairwright.llm.queries import QUERIES, VOCABULARY


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rows, toxic = corpus.documents()
    rng = random.Random(8)
    items = []
    for k in range(12):
        words = rows[rng.randrange(len(rows))][1].split()
        start = rng.randrange(max(1, len(words) - 20))
        items.append((k, " ".join(words[start : start + rng.choice([5, 13, 18])]).upper()))
    root = corpus.write_tables(spark, tmp_path_factory.mktemp("small"), rows, toxic, items)
    return root, rows, toxic, items


# -- toxicity and language -------------------------------------------------------------------


def test_string_kernel_equals_its_definition():
    def by_definition(s, t):
        def spread(x):
            found = defaultdict(float)
            for places in itertools.combinations(range(len(x)), toxicity.ORDER):
                word = "".join(x[p] for p in places)
                found[word] += toxicity.DECAY ** (places[-1] - places[0] + 1)
            return found

        a, b = spread(s), spread(t)
        return sum(v * b[k] for k, v in a.items() if k in b)

    rng = random.Random(1)
    pairs = [tuple("".join(rng.choices("abc", k=rng.randint(1, 8))) for _ in "st") for _ in range(60)]
    left, right = (toxicity.codes([p[k] for p in pairs], 8) for k in (0, 1))
    got = toxicity.raw_kernel(left, right)
    np.testing.assert_allclose(got, [by_definition(s, t) for s, t in pairs], rtol=1e-4, atol=1e-6)


def test_toxicity_on_documents_not_trained_on():
    rows, toxic = corpus.documents(seed=21, count=600)
    learn, check = rows[:400], rows[400:]
    model = toxicity.fit([r[1] for r in learn], [int(r[0] in toxic) for r in learn])
    known = toxicity.Remembered(toxicity.Similarity(model.landmarks))
    scores = model.scores([r[1] for r in check], known)
    right = [(s >= 0.7) == (r[0] in toxic) for s, r in zip(scores, check, strict=True)]
    assert sum(right) / len(right) > 0.97
    plain = "ouing theer onst " * 5
    gapped = ["you i.d.i.o.t", "you i d i o t", "you m-o-r-o-n", "you loser!!"]
    scores = model.scores([plain, *[f"{plain}{g} {plain}" for g in gapped]], known)
    assert scores[0] < 0.3 and (scores[1:] > 0.7).all()


def test_insults_with_a_letter_put_in_at_every_place():
    rows, toxic = corpus.documents(seed=21, count=600)
    learn, check = rows[:400], rows[400:]
    model = toxicity.fit([r[1] for r in learn], [int(r[0] in toxic) for r in learn])
    known = toxicity.Remembered(toxicity.Similarity(model.landmarks))
    clean = [r[1] for r in check if r[0] not in toxic]
    assert (model.scores(clean, known) >= 0.7).mean() < 0.03
    forms = [
        word[:k] + letter + word[k:]
        for word in ("idiot", "moron", "loser")
        for k in range(1, len(word))
        for letter in "abcdfghjkuvwy"
    ]
    scores = model.scores([f"onst theer {form} ouing" for form in forms], known)
    assert (scores >= 0.7).mean() >= 0.9


def test_insult_of_three_letters():
    rng = random.Random(5)

    def documents(count):
        lines = [corpus.prose(rng, "en", 30).split() for _ in range(count)]
        for line in lines[::2]:
            line.insert(rng.randrange(len(line)), "oaf")
        return [" ".join(line) for line in lines], [1 - k % 2 for k in range(count)]

    model = toxicity.fit(*documents(400))
    assert "oaf" in model.landmarks
    known = toxicity.Remembered(toxicity.Similarity(model.landmarks))
    texts, labels = documents(100)
    right = [(s >= 0.7) == bool(y) for s, y in zip(model.scores(texts, known), labels, strict=True)]
    assert sum(right) >= 98
    assert model.scores(["loaf of oats", "you oaf!"], known).round().tolist() == [0, 1]


def test_forward_backward_equals_enumeration(monkeypatch):
    rng = np.random.default_rng(2)
    emit, moves, first = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    begins = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    expected = np.zeros((7, 3))
    for a, b in ((0, 4), (4, 7)):
        total = np.zeros((b - a, 3))
        for tags in itertools.product(range(3), repeat=b - a):
            w = first[tags[0]] + sum(emit[a + k, t] for k, t in enumerate(tags))
            w += sum(moves[x, y] for x, y in itertools.pairwise(tags))
            for k, t in enumerate(tags):
                total[k, t] += np.exp(w)
        expected[a:b] = total / total.sum(axis=1, keepdims=True)
    for block in (1, 3, 128):
        monkeypatch.setattr(language_id, "BLOCK", block)
        np.testing.assert_allclose(language_id.marginals(emit, begins, moves, first), expected)


def test_slopes_of_transitions_equal_enumeration(monkeypatch):
    rng = np.random.default_rng(3)
    emit, moves, first = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    begins = np.array([1, 0, 0, 0, 1, 0, 0], bool)

    def log_total(moves):
        out = 0.0
        for a, b in ((0, 4), (4, 7)):
            weights = [
                first[tags[0]]
                + sum(emit[a + k, t] for k, t in enumerate(tags))
                + sum(moves[x, y] for x, y in itertools.pairwise(tags))
                for tags in itertools.product(range(3), repeat=b - a)
            ]
            out += np.logaddexp.reduce(weights)
        return out

    step = 1e-5
    slopes = np.zeros((3, 3))
    for x, y in itertools.product(range(3), repeat=2):
        more, less = moves.copy(), moves.copy()
        more[x, y] += step
        less[x, y] -= step
        slopes[x, y] = (log_total(more) - log_total(less)) / (2 * step)
    for block in (1, 3, 128):
        monkeypatch.setattr(language_id, "BLOCK", block)
        pairs = language_id.forward_backward(emit, begins, moves, first, True)[1]
        np.testing.assert_allclose(pairs, slopes, rtol=1e-6)


def test_every_language_is_sampled(spark):
    rows = [(k, f"word{k}", f"l{k % 230:03}") for k in range(460)]
    rows += [(1000 + k, "long " * 5000, "only-long") for k in range(3)] + [(2000, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(lang for _, lang in language_id.labelled_sample(docs, F.lit(True)))
    assert len(got) == 231 and got["only-long"] == 3 and got["l007"] == 2


def test_words_are_letters_with_their_marks():
    assert language_id.words_of("½ ① ² Ⅷ 12 _ '’") == []
    assert language_id.words_of("x² हिन्दी o’clock d'’y") == ["x", "हिन्दी", "o’clock", "d", "y"]
    assert language_id.words_of("e\u0301te\u0301") == ["e\u0301te\u0301"]


def test_language_of_texts_and_of_words_in_mixed_text():
    rows, _ = corpus.documents(seed=4, count=300)
    model = language_id.fit([(r[1], r[2]) for r in rows[:200] if "changed" not in r[1]])
    known = language_id.Emissions(model)
    rng = random.Random(9)
    texts = [(corpus.prose(rng, g), g) for g in ("en", "de", "es") for _ in range(30)]
    got = language_id.label_texts(model, [t for t, _ in texts], known)
    assert sum(x[0] == g for x, (_, g) in zip(got, texts, strict=True)) >= 88
    line = language_id.words_of(f"{corpus.prose(rng, 'de', 12)} {corpus.prose(rng, 'es', 12)}")
    tags = [model.languages[k] for k in language_id.label_words(model, [line], known).argmax(axis=1)]
    assert Counter(tags[:10]).most_common(1)[0][0] == "de"
    assert Counter(tags[-10:]).most_common(1)[0][0] == "es"


def test_long_letter_runs_are_read_whole():
    rows, _ = corpus.documents(seed=4, count=300)
    model = language_id.fit([(r[1], r[2]) for r in rows[:200] if "changed" not in r[1]])
    known = language_id.Emissions(model)
    rng = random.Random(9)
    german, spanish = ("".join(rng.choices(corpus.SYLLABLES[g], k=200)) for g in ("de", "es"))
    # German in the middle, Spanish only at the ends
    run = spanish[:20] + german + spanish[-20:]
    words = language_id.words_of(run)
    assert "".join(words).replace(language_id.CUT, "") == run and len(words) > 10
    assert language_id.label_texts(model, [run], known)[0][0] == "de"
    assert language_id.words_of("x" * 32) == ["x" * 32]


# -- mixing and sharding ---------------------------------------------------------------------


def test_mix_reaches_targets_and_reruns_agree(spark, small):
    root, rows, _, _ = small
    got = QUERIES["op2_mix_sources"](spark, root).collect()
    again = QUERIES["op2_mix_sources"](spark, root).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    size = {r[0]: len(corpus.WORD.findall(r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    total = Counter()
    for d, s in source.items():
        total[s] += size[d]
    weight = dict(zip(sorted(total), itertools.cycle([5, 2, 1])))
    target, left, open_ = {}, 1.5 * sum(total.values()), set(total)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], total[s])
        assert r.target == pytest.approx(target[s]) and r.taken in (
            0, size[r.doc_id], 2 * size[r.doc_id])
        taken[s] += r.taken
        if target[s] >= total[s]:
            assert r.taken >= size[r.doc_id]  # a complete epoch comes first
    for s in total:
        assert abs(taken[s] - target[s]) <= max(size.values()) / 2 + 1


def test_shards_are_even_and_growing_moves_slots_only_into_the_new_one(spark, small):
    root, rows, _, _ = small
    got = QUERIES["op7_virtual_slots"](spark, root).collect()
    by_shard = defaultdict(list)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        by_shard[r.shard].append(r)
        assert r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert r["size"] == len(text[r.doc_id].encode()) + 1
    sizes = [sum(r["size"] for r in x) for x in by_shard.values()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= max(r["size"] for r in got)
    for x in by_shard.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    rng = random.Random(2)
    loads = [sharding.Load(k, rng.randrange(50, 100), 1) for k in range(sharding.SLOTS)]
    owner = sharding.balanced_map(loads, 16)
    grown = sharding.grown_map(owner, loads, 17)
    moved = [k for k in range(sharding.SLOTS) if grown[k] != owner[k]]
    assert moved and {grown[k] for k in moved} == {16}
    held = Counter()
    for x in loads:
        held[grown[x.slot]] += x.bytes
    assert max(held.values()) < 1.01 * min(held.values())


def test_records_are_placed_by_the_latest_map_and_rebalancing_stores_the_next(spark, tmp_path):
    rng = random.Random(6)
    # one id holds a third of the rows, with texts of its own; ids of any kind for the others
    rows = [(7 if k % 3 == 0 else k, "x" * rng.randrange(60) + str(k)) for k in range(1500)]
    rows += [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"{tmp_path}/map"

    def places():
        got = sharding.shard_documents(docs, 4, slots=256, path=path).collect()
        by_shard = defaultdict(list)
        for r in got:
            by_shard[r.shard].append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
        assert len({r.map_version for r in got}) == 1 and len(got) == len(rows)
        return got[0].map_version, {r.virtual_slot: r.shard for r in got}

    first, owner = places()
    assert first == 1 and places() == (1, owner)
    loads = sharding.slot_loads(sharding.part_loads(docs, slots=256))
    assert sum(x.bytes for x in loads) == sum(len(t or "") + 1 for _, t in rows)
    assert sharding.rebalance(spark, path, loads, 5) == 2
    second, grown = places()
    assert second == 2
    assert {grown[s] for s in grown if grown[s] != owner[s]} == {4}
    # new loads: the slots of one shard, not that of the hot id, have become four times as heavy
    hot = max(loads, key=lambda x: x.bytes).slot
    grew = min(s for s in range(5) if s != grown[hot])
    heavier = [
        sharding.Load(x.slot, x.bytes * (4 if grown[x.slot] == grew else 1), x.rows) for x in loads
    ]
    assert sharding.rebalance(spark, path, heavier, 5) == 3
    _, evened = places()

    def spread(owner):
        held = Counter()
        for x in heavier:
            held[owner[x.slot]] += x.bytes if x.slot != hot else 0
        rest = [held[s] for s in range(5) if s != owner[hot]]
        return max(rest) - min(rest)

    assert spread(evened) < spread(grown)
    assert sharding.rebalance(spark, path, heavier, 5) == 3
    with pytest.raises(ValueError):
        sharding.rebalance(spark, path, loads, 2)


def test_a_mix_of_texts_under_one_id_is_the_same_in_every_order(spark):
    rows = [(1, f"{'abcdefgh'[k % 8]} {k}", "s") for k in range(200)]
    taken = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
        got = mixing.mix(docs, share=0.5).select("text", "taken").collect()
        taken.append(sorted(map(tuple, got)))
    assert taken[0] == taken[1] and 0 < sum(x[1] > 0 for x in taken[0]) < 200


# -- decontamination, near copies, lines -----------------------------------------------------


def brute_contamination(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {k: k + 32 for k in range(65, 91)}
    windows = defaultdict(set)
    for k, text in items:
        words = word.findall(text.translate(lower))
        for at in range(max(1, len(words) - 12)):
            windows[tuple(words[at : at + 13])].add(str(k))
    out = {}
    for d, text, *_ in rows:
        words = word.findall(text.translate(lower))
        hit, found = set(), set()
        for window, ids in windows.items():
            for at in range(len(words) - len(window) + 1):
                if tuple(words[at : at + len(window)]) == window:
                    hit.update(range(at, at + len(window)))
                    found |= ids
        out[d] = (len(words), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("pattern_chars", [10**6, 150])
def test_contamination_and_its_offsets(spark, small, pattern_chars):
    """Also with several automata, whose hits are put together."""
    root, rows, _, items = small
    docs = spark.read.parquet(f"{root}/documents.parquet")
    tests = spark.read.parquet(f"{root}/benchmark.parquet")
    found = decontamination.find_contamination(docs, tests, pattern_chars=pattern_chars).collect()
    expected = brute_contamination(rows, items)
    text = {r[0]: r[1] for r in rows}
    plain = decontamination.words_of
    some = 0
    for r in found:
        n_words, n_hit, ids = expected[r.doc_id]
        assert (r.hits.n_words, r.hits.n_hit, r.hits["items"]) == (n_words, n_hit, ids)
        words = plain(text[r.doc_id])[1]
        for s in r.hits.spans:
            some += 1
            assert plain(text[r.doc_id][s.start : s.end])[1] == words[s.first : s.last + 1]
    assert some
    for r in QUERIES["op3_decontaminate"](spark, root).collect():
        n_words, n_hit, ids = expected[r.doc_id]
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert r.contaminated == (n_hit > 0 and 20 * n_hit >= n_words)


def shingle_set(text):
    words = text.encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_near_copies(rows):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    groups = corpus.Groups(sets)
    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            groups.link(a, b)
    return sets, groups


@pytest.mark.parametrize("tile", [near_duplicates.TILE, 3])
def test_near_copies(spark, monkeypatch, tile):
    """Also with keys cut into small tiles, and with a group of many near copies."""
    monkeypatch.setattr(near_duplicates, "TILE", tile)
    rng = random.Random(3)
    rows, _ = corpus.documents(seed=12, count=120)
    base = corpus.prose(rng, "en", 60)
    rows += [(1000 + k, corpus.altered(rng, base, 1 + k % 3), "en", "x", 0) for k in range(40)]
    sets, groups = brute_near_copies(rows)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, corpus.DOCUMENT)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        d: (len(s), groups.find(d), groups.find(d) == d) for d, s in sets.items()}


def test_second_step_finds_links_between_components():
    """Two pairs of equal documents, linked only through one pair across."""
    import pandas as pd

    sets = [set(range(0, 80)), set(range(0, 80)), set(range(10, 90)), set(range(40, 120))]
    signature = np.zeros((4, 64), np.uint8)
    tile = pd.DataFrame({
        "key": 1, "i": 0, "j": 0, "chunk": 0, "rep": [1, 2, 3, 4],
        "signature": [s.tobytes() for s in signature], "component": [1, 1, 3, 4],
        "set": [np.array(sorted(s)) for s in sets],
    })
    found = near_duplicates.links_of_tile(tile, 0.55, 75)
    assert [tuple(x) for x in found.to_numpy()] == [(1, 3)]


def test_estimates_follow_similarity():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.5, 0.75, 0.9):
        n = 2000
        cut = round(n * (1 - share) / (1 + share))
        one, two = values[:n], values[cut : cut + n]
        packed = near_duplicates.packed(
            np.stack([near_duplicates.minima(one), near_duplicates.minima(two)])
        )
        rows = np.ascontiguousarray(packed).view(np.uint64)
        assert abs(near_duplicates.similarity(rows[0], rows[1:])[0] - share) < 0.15


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def edited(rng, line, times, letters="abc"):
    line = list(line)
    for _ in range(times):
        at = rng.randrange(len(line) + 1)
        match rng.randrange(3):
            case 0:
                line.insert(at, rng.choice(letters))
            case 1 if line:
                line.pop(min(at, len(line) - 1))
            case 2 if line:
                line[min(at, len(line) - 1)] = rng.choice(letters)
    return "".join(line)


def test_banded_distance():
    rng = random.Random(6)
    for _ in range(4000):
        a = "".join(rng.choices("ab", k=rng.randrange(10)))
        b = edited(rng, a, rng.randrange(6))
        edits = rng.randrange(5)
        assert line_dedup.within(a, b, edits) == (distance(a, b) <= edits)


def test_different_texts_under_one_id(spark):
    """No link is lost, no clean text goes, and of linked texts one stays, in every run."""
    rng = random.Random(29)
    one, two, three = (corpus.prose(rng, "en", 60) for _ in range(3))
    rows = [
        (1, one), (1, two), (3, two + " more"), (4, three), (4, three), (4, three.upper()),
        (4, three + " end"), (5, three), (5, one), (6, None), (6, ""), (None, three),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("version", F.lit(0))
    got = [tuple(r) for r in near_duplicates.near_duplicates(docs.repartition(3)).collect()]
    assert sorted((i, c) for i, _, c, _ in got if i) == [
        (1, 1), (1, 1), (3, 1), (4, 4), (4, 4), (4, 4), (4, 4), (5, 1), (5, 4), (6, 6), (6, 6),
    ]
    stay = [
        sorted(str(tuple(r)) for r in corpus_pipeline.drop_near_copies(spark, d, "").collect())
        for d in (docs, docs.orderBy(F.desc("text")).repartition(4))
    ]
    assert stay[0] == stay[1]
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert {(r.doc_id, r.text) for r in kept} >= {(1, one), (1, two), (6, None), (6, ""), (None, three)}
    assert sorted(str(r.doc_id) for r in kept) == ["1", "1", "4", "6", "6", "None"]


@pytest.mark.parametrize("tile", [line_dedup.TILE, 3])
def test_lines_removed(spark, monkeypatch, tile):
    monkeypatch.setattr(line_dedup, "TILE", tile)
    rng = random.Random(7)
    base = ["".join(rng.choices("abcdefgh ", k=rng.randint(38, 60))).strip() for _ in range(25)]
    rows = []
    for d in range(40):
        lines = [edited(rng, rng.choice(base), rng.randrange(4)) for _ in range(rng.randint(1, 6))]
        lines += ["", "short", "ß" * 45 + rng.choice("xyz")]
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines), "en", "s", 0))
    first, places = {}, defaultdict(list)
    for d, text, *_ in rows:
        for k, line in enumerate(text.split("\n")):
            if line.strip(" "):
                first.setdefault(line, (d, k))
                places[line].append((d, k))
    order = sorted(first, key=first.get)
    groups = corpus.Groups(range(len(order)))
    for a, b in itertools.combinations(range(len(order)), 2):
        if min(len(order[a]), len(order[b])) >= line_dedup.LEAST_LENGTH:
            if abs(len(order[a]) - len(order[b])) <= 2 and distance(order[a], order[b]) <= 2:
                groups.link(a, b)
    removed = defaultdict(set)
    for k, line in enumerate(order):
        for d, place in places[line]:
            if (d, place) != first[order[groups.find(k)]]:
                removed[d].add(place)
    docs = spark.createDataFrame(rows, corpus.DOCUMENT)
    for r in line_dedup.without_repeats(docs).collect():
        lines = rows[r.doc_id][1].split("\n")
        assert set(r.removed) == removed[r.doc_id] and r.n_lines == len(lines)
        assert r.text == "\n".join(x for k, x in enumerate(lines) if k not in removed[r.doc_id])
    assert sum(map(len, removed.values())) > 20


def test_lines_of_all_lengths_have_an_edit_budget(spark):
    """Near the lengths at which the budget changes, too; a line of 300 may have three edits."""
    rng = random.Random(17)
    letters = "abcdefghijklmnopqrstuvwxyz "
    lines = ["Are, is anwh reenen.", "Are. Is anwh reenen.", "With and.", "With, and.", "St.", "Sr."]
    for size in [*range(6, 19), *range(38, 42), *range(298, 302)] * 2:
        base = "x" + "".join(rng.choices(letters, k=size - 2)) + "y"
        lines += [base, *(edited(rng, base, k, letters) for k in (1, 2, 3, 4))]
    lines = list(dict.fromkeys(x for x in lines if x.strip()))
    groups = corpus.Groups(range(len(lines)))
    for a, b in itertools.combinations(range(len(lines)), 2):
        least = min(len(lines[a]), len(lines[b]))
        edits = 3 if least >= 300 else 2 if least >= 15 else 1 if least >= 8 else 0
        one, two = Counter(lines[a]), Counter(lines[b])
        unlike = max((one - two).total(), (two - one).total())  # at most the distance
        if unlike <= edits and distance(lines[a], lines[b]) <= edits:
            groups.link(a, b)
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.without_repeats(docs).collect() if r.n_removed}
    assert got == {k for k in range(len(lines)) if groups.find(k) != k}
    assert {lines.index("Are. Is anwh reenen."), lines.index("With, and.")} <= got


def test_lines_of_different_texts_under_one_id(spark):
    """Only the text that has the repeated line at a place loses it."""
    shared = "a line that several of the documents have in common"
    rows = [
        (1, f"{shared}\nsomething of the first document alone"),
        (2, f"an opening that is found nowhere else at all\n{shared}"),
        (2, f"{shared}\nan ending that is found nowhere else, either"),
        (2, f"{shared}\nan ending that is found nowhere else, either"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in line_dedup.without_repeats(docs).collect())
    assert got == sorted(
        [
            rows[0],
            (2, "an opening that is found nowhere else at all"),
            (2, "an ending that is found nowhere else, either"),
            (2, "an ending that is found nowhere else, either"),
        ]
    )


# -- embeddings ------------------------------------------------------------------------------


@pytest.mark.parametrize("tile", [embedding_links.TILE, 7])
def test_embedding_links(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_links, "TILE", tile)
    rng = np.random.default_rng(5)
    vectors = []
    for k in range(160):
        x = rng.normal(size=20)
        if vectors and rng.random() < 0.6:
            x = np.array(vectors[rng.integers(len(vectors))][1]) + rng.normal(size=20) * 0.3
        vectors.append((k * 2 + 1, [float(np.float32(v)) for v in x], int(rng.integers(3))))
    vectors += [(1000 + k, vectors[3][1], vectors[3][2]) for k in range(5)]
    unit = np.array([v[1] for v in vectors])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([v[2] for v in vectors])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    ids = [v[0] for v in vectors]
    groups = corpus.Groups(ids)
    for a, b in zip(*np.nonzero(near), strict=True):
        groups.link(ids[a], ids[b])
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_links.link_embeddings(frame).collect()}
    assert near.sum() > 100
    for k, v in enumerate(ids):
        row = got[v]
        assert (row.n_links, row.component_id) == (near[k].sum(), groups.find(v))
        assert row.kept == (groups.find(v) == v)


def test_components_of_long_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(0, 300)]
    star = [(1000, 1001 + k) for k in range(200)]
    links = spark.createDataFrame(chain + star + [(5000, 5000)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert {got[k] for k in range(301)} == {0}
    assert {got[1000 + k] for k in range(201)} == {1000} and got[5000] == 5000


# -- tokens and personal data ----------------------------------------------------------------


def test_token_counts_equal_greedy_matching():
    rng = random.Random(10)
    for _ in range(300):
        def pieces(n):
            return {
                bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, n))
            }

        begin, go_on = pieces(8), pieces(8)
        made = token_counts.build(begin, go_on)
        for _ in range(20):
            word = bytes(rng.choices(b"abc", k=rng.randint(1, 9)))
            at, tokens = 0, 0
            while at < len(word):
                known = go_on if at else begin
                end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
                if end is None:
                    tokens = 1
                    break
                at, tokens = end, tokens + 1
            assert made.count(word) == tokens


def test_token_counts_of_words_without_a_beginning_of_their_own():
    """Such words are the bare space and pieces that go on, as in a greedy count of ' ' + word."""
    begin, go_on = token_counts.byte_level_pieces(VOCABULARY)
    made = token_counts.build(begin, go_on)
    known = {b" ", *go_on, *(b" " + x for x in begin)}
    words = "собака рыба я это ярко 中文 你好 한국 ไทย the house naïve Übermut 😀 ﷺ".split()
    words += ["中文没有空格的一句话" * 20, "대한민국" * 20, *map(chr, range(0x100, 0x3000, 41))]
    for word in words:
        spelled = b" " + word.encode()
        at, tokens = 0, 0
        while at < len(spelled):
            ends = range(min(len(spelled), at + 200), at, -1)
            at = next(e for e in ends if spelled[at:e] in known)
            tokens += 1
        assert made.count(word.encode()) == tokens, word
    assert made.count(("中文没有空格的一句话" * 20).encode()) > 100
    # a vocabulary without the bare space spells fewer words
    assert token_counts.build({b"a"}, {b"b"}).count(b"bb") == 1
    assert token_counts.build({b"a", b""}, {b"b"}).count(b"bb") == 3


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        total = sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(digits[::-1]))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(11)
    bits = ["a@b.co", "x.y@q-r.com.", "@", "..", "4111 1111 1111 1111", "4111-1111", "1.2.3.4", "300.",
            "001.02.255.0", ".7", "+1 (988) 555-2485", "+49", " ", "é😀", "-", "7", "12", "_", "a.b", "\n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(1500)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = pii.personal_data(docs).select("doc_id", pii.joined(F.col("spans"), pii.BASE).alias("s"))
    for r in found.collect():
        expected = [
            (m.start(), rank, f"{kind}:{m.start()}:{m.end()}")
            for rank, (kind, pattern) in enumerate(BASE.items())
            for m in re.finditer(pattern, texts[r.doc_id])
            if valid(kind, m[0])
        ]
        assert r.s == ",".join(x[2] for x in sorted(expected)), texts[r.doc_id]


def test_secrets_and_texts_with_many_spans(spark):
    many = " ".join(f"u{k}@mail{k % 7}.org" for k in range(3000))
    texts = [
        'token = "24be64439e3e49cf46b2d7c90f3602a3" end',
        "api_key: Zm9vYmFyMTIzNDU2Nzg5 and password=short1",
        "the token = somethingwithoutdigits here",
        many,
    ]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    found = [[texts[k][s.start : s.end] for s in got[k] if s.kind == "secret"] for k in range(3)]
    assert found == [
        ['token = "24be64439e3e49cf46b2d7c90f3602a3'], ["key: Zm9vYmFyMTIzNDU2Nzg5"], []]
    emails = [(m.start(), m.end()) for m in re.finditer(BASE["email"], many)]
    assert [(s.start, s.end) for s in got[3] if s.kind == "email"] == emails and len(emails) == 3000


def test_bank_numbers_and_context(spark):
    texts = [
        "iban: GB82 WEST 1234 5698 7654 32 ok",
        "DE89370400440532013000",
        "DE89370400440532013001",
        "credit card 4111 1111 1111 1111",
        "order serial 4111 1111 1111 1111",
    ]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert [[(s.kind, s.start, s.end) for s in got[k] if s.kind == "iban"] for k in range(3)] == [
        [("iban", 6, 33)], [("iban", 0, 22)], []]
    assert got[3][0].score > 0.8 > 0.5 > got[4][0].score


# -- the pipeline ----------------------------------------------------------------------------


def test_pipeline_equals_plain_python(spark, small):
    root, rows, _, items = small
    scores = {r.doc_id: r.predicted for r in QUERIES["op1_toxicity"](spark, root).collect()}
    rest = [r for r in rows if not scores[r[0]]]
    _, groups = brute_near_copies(rest)
    rest = [r for r in rest if groups.find(r[0]) == r[0]]
    found = brute_contamination(rest, items)
    rest = [r for r in rest if not (found[r[0]][1] and 20 * found[r[0]][1] >= found[r[0]][0])]
    got = corpus_pipeline.run(spark, root).collect()
    text = {r[0]: r[1] for r in rest}
    times = Counter(r.doc_id for r in got)
    assert set(times) <= set(text) and set(times.values()) <= {1, 2}
    words = sum(len(corpus.WORD.findall(text[r.doc_id])) for r in got)
    assert abs(words - 1.5 * sum(len(corpus.WORD.findall(t)) for t in text.values())) < 300
    assert all(text[r.doc_id] == r.text for r in got)
    for shard in range(16):
        places = sorted(r.slot for r in got if r.shard == shard)
        assert places == list(range(len(places)))
