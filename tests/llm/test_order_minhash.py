import random

import numpy as np
from helpers import MESSY, empty, messy
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import order_minhash as M
from brindle.llm.common import utf8_buffers, word_hashes, words_of
from brindle.llm.components import classes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=12), st.lists(st.integers(0, 2), max_size=12), st.integers(0, 12))
def test_banded_distance(a, b, most):
    d = distance(a, b)
    assert M.banded_distance(a, b, most) == (d if d <= most else None)


def test_shingles_and_occurrences():
    import pyarrow as pa

    words, at = word_hashes(*utf8_buffers(pa.array(["a b c d e f", "A b, c d e", "a", None, "x x x x x x x"])))
    runs, before = M.shingles(words, at)
    assert np.diff(before).tolist() == [2, 1, 1, 0, 3]
    assert runs[0] == runs[2] and len(set(runs[4:7].tolist())) == 1
    assert len(set(M.label_occurrences(runs, before)[4:7].tolist())) == 3


def test_sketch_keeps_text_order():
    labelled = np.arange(1, 3, dtype=np.uint64)
    assert (M.sketch(labelled) != M.sketch(labelled[::-1])).all()
    assert (M.sketch(labelled[:1]) == M.sketch(labelled[:1])).all()


def corpus(seed, groups=12, copies=6, size=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    passage = rng.choices(vocabulary, k=60)
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.randrange(3, size)) + (passage if g % 2 else [])
        for c in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(text) // 25) + 1) if c else 0):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(1, 3))
            docs.append(" ".join(text) + ("." if c % 2 else ""))
    return [(i * 3, t) for i, t in enumerate(docs)] + [(1, ""), (2, "  ...")]


def roots(items, linked):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def test_classes_agree_with_brute_force(spark):
    docs = corpus(8)
    ids = {}
    words = {i: [ids.setdefault(w, len(ids)) for w in words_of(t.encode())] for i, t in docs}
    want = roots(sorted(words), lambda a, b: M.similar(np.array(words[a], np.int64), np.array(words[b], np.int64)))
    assert 10 < len(set(want.values())) < len(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = M.near_duplicates(df).collect()
    assert {r.doc_id: r.class_id for r in rows} == want
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in rows)
    assert {r.doc_id for r in M.kept_documents(df).collect()} == set(want.values())


def against_brute_force(spark, texts):
    ids = {}
    words = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t.encode())], np.int64) for t in texts]
    want = roots(range(len(texts)), lambda a, b: M.similar(words[a], words[b]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.class_id for r in M.near_duplicates(df).collect()}, want


def test_a_star_of_copies_that_are_unlike_each_other_is_one_class(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for c in range(300):
        copy = list(base)
        for part in range(3):
            at = rng.randrange(200 - 11)
            copy[at : at + 11] = [f"c{c}p{part}x{k}" for k in range(11)]
        texts.append(" ".join(copy))
    got, want = against_brute_force(spark, texts)
    assert len(set(want.values())) == 1
    assert got == want


def test_near_copies_meet_among_many_unlike_texts_of_one_passage(spark):
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(110)]
    texts = []
    for g in range(60):
        own = [f"g{g}w{i}" for i in range(50)]
        texts.append(" ".join(passage + own))
        for at in rng.sample(range(50), 14):
            own[at] = f"g{g}e{at}"
        texts.append(" ".join(passage + own))
    got, want = against_brute_force(spark, texts)
    assert len(set(want.values())) == 60
    assert got == want


def test_recall_with_edits_all_over_the_text(spark):
    rng = random.Random(13)
    texts, pairs = [], 200
    for e, edits in enumerate((40, 30, 20)):
        for g in range(pairs):
            base = [f"e{e}g{g}w{i}" for i in range(200)]
            texts.append(" ".join(base))
            for at in rng.sample(range(200), edits):
                base[at] += "x"
            texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = [r.doc_id // (2 * pairs) for r in M.near_duplicates(df).collect() if r.doc_id % 2 and not r.kept]
    recall = [found.count(e) / pairs for e in range(3)]
    print("recall at 0.80, 0.85, 0.90:", recall)
    assert recall[0] >= 0.97 and recall[1] >= 0.99 and recall[2] == 1


def test_recall_by_length(spark):
    """Scattered substitutions, and insertions and deletions, down to a similarity of 0.80."""
    rng = random.Random(14)
    lengths, pairs, texts = (5, 8, 10, 15, 20, 39, 50, 200), 100, []
    for n in lengths:
        for g in range(pairs):
            base = [f"n{n}g{g}w{i}" for i in range(n)]
            copy, edits = list(base), n // 5
            if g % 2:
                for at in rng.sample(range(n), edits):
                    copy[at] += "x"
            else:
                for k in range(edits):
                    at = rng.randrange(len(copy))
                    copy[at : at + 1] = [] if k % 2 or n < 10 else [copy[at], f"n{n}g{g}y{k}"]
            texts += [" ".join(base), " ".join(copy)]
    words = [np.array([hash(w) for w in t.split()]) for t in texts]
    assert all(M.similar(words[i], words[i + 1]) for i in range(0, len(words), 2))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = [lengths[r.doc_id // (2 * pairs)] for r in M.near_duplicates(df).collect() if r.doc_id % 2 and not r.kept]
    recall = {n: found.count(n) / pairs for n in lengths}
    print("recall at 0.80 by length:", recall)
    assert all(recall[n] == 1 for n in lengths if n < M.SHORT) and recall[50] >= 0.95 and recall[200] >= 0.97


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_short_similar_texts_share_a_piece(data):
    n = data.draw(st.integers(5, M.SHORT - 1))
    a = data.draw(st.lists(st.integers(0, 3), min_size=n, max_size=n))
    b = list(a)
    for _ in range(data.draw(st.integers(0, n // 5))):
        at = data.draw(st.integers(0, max(len(b) - 1, 0)))
        b[at : at + data.draw(st.integers(0, 1))] = data.draw(st.lists(st.integers(0, 3), max_size=1))
    x, y = (np.array(t, np.uint64) + np.uint64(1) for t in (a, b))
    if a != b and b and max(len(a), len(b)) < M.SHORT and M.similar(x, y):
        assert set(M.piece_keys(M.mixed(x)).tolist()) & set(M.piece_keys(M.mixed(y)).tolist())


def test_full_counters_do_not_hide_a_pair(spark):
    """Texts of one word a thousand times: the counters end at 255."""
    texts = ["a " * 1000 + "b " * 40, "a " * 1000 + "c " * 60, "d " * 700, "a " * 790, "a " * 1500]
    got, want = against_brute_force(spark, texts)
    assert got == want


def candidates_of(monkeypatch):
    seen = []
    original = M._candidates

    def counted(*args):
        found = original(*args)
        seen.extend((r.a, r.b) for r in found.collect())
        return found

    monkeypatch.setattr(M, "_candidates", counted)
    return seen


def test_unlike_long_texts_of_one_passage_are_no_candidates(spark, monkeypatch):
    seen = candidates_of(monkeypatch)
    passage = [f"p{i}" for i in range(800)]
    texts = [" ".join(passage + [f"g{g}w{i}" for i in range(6000)]) for g in range(40)]
    got, want = against_brute_force(spark, texts)
    assert got == want and len(set(got.values())) == 40
    assert not seen


def test_a_pair_of_an_earlier_bucket_is_left_out():
    pairs = np.array([[0, 1], [0, 2], [1, 2], [3, 0]])
    assert M._met_before(pairs, [[5, 7], [7], [9], []]).tolist() == [True, False, False, False]
    assert M._met_before(pairs, [[], [], [], []]).tolist() == [False] * 4
    assert M._met_before(np.empty((0, 2), np.int64), [[5], [5]]).tolist() == []


def test_blocks_of_a_large_bucket_give_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 300)
    monkeypatch.setattr(M, "STEPS", 500)
    test_near_copies_meet_among_many_unlike_texts_of_one_passage(spark)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_similar_texts_share_rarest_words(data):
    a = data.draw(st.lists(st.integers(0, 9), min_size=1, max_size=60))
    b = list(a)
    for _ in range(data.draw(st.integers(0, len(a) // 5))):
        at = data.draw(st.integers(0, max(len(b) - 1, 0)))
        b[at : at + data.draw(st.integers(0, 1))] = data.draw(st.lists(st.integers(0, 9), max_size=1))
    longer = max(len(a), len(b))
    if not b or not M.similar(np.array(a), np.array(b)):
        return
    rare = [sorted(t)[: int(M._edits(np.array([len(t)]), M.SIMILARITY)[0]) + M.SHARED] for t in (a, b)]
    word, at = M._labelled_words([np.array(t, "<u4").tobytes() for t in rare])
    x, y = (set(word[i:j].tolist()) for i, j in zip(at, at[1:], strict=False))
    assert len(x & y) >= min(M.SHARED, longer - int(M._edits(np.array([longer]), M.SIMILARITY)[0]))


def test_a_common_passage_does_not_join_documents(spark):
    rng = random.Random(3)
    passage = "the same passage stands in all of these texts and is a good part of each one of them".split()
    docs = [(i, " ".join(rng.choices([f"v{k}" for k in range(3000)], k=12) + passage)) for i in range(60)]
    rows = M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.class_id == r.doc_id for r in rows)


def test_contraction_of_long_chains(spark):
    from pyspark.sql import functions as F

    chain = spark.range(300).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    other = spark.range(1000, 1003).select(F.xxhash64("id").alias("a"), F.xxhash64(F.lit(1000).cast("long")).alias("b"))
    out = classes(chain.union(other))
    assert out.count() == 304 and out.select("root").distinct().count() == 2
    assert classes(chain.limit(0)).count() == 0


def test_nulls_repeats_clashing_columns_and_empty_table(spark):
    rows = M.near_duplicates(messy(spark)).collect()
    assert len(rows) == len(MESSY)
    assert {r.class_id for r in rows if r.doc_id in (2, 3)} == {2}
    assert {r.class_id for r in rows if r.doc_id in (1, None)} == {1}
    assert sorted((r.class_id, r.kept) for r in rows if r.doc_id == 4) == [(1, False), (1, False), (4, True)]
    kept = M.kept_documents(messy(spark))
    assert kept.columns == messy(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5, 6]
    assert M.near_duplicates(empty(spark)).collect() == []
