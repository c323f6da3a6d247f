import hashlib
import random
import re

import pytest
from helpers import CLASHING, empty, messy
from pyspark.sql import functions as F

from brindle.llm import prefix_trees as p
from brindle.session import Tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least):
    """(doc_id, words, kept words) by a table of all windows."""
    texts = [(i if i is not None else p.LAST, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, words in texts:
        for k in range(len(words) - least + 1):
            w = tuple(words[k : k + least])
            first[w] = min(first.get(w, i), i)
    out = []
    for (doc, _), (i, words) in zip(rows, texts, strict=True):
        gone = set()
        for k in range(len(words) - least + 1):
            if first[tuple(words[k : k + least])] < i:
                gone |= set(range(k, k + least))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc, len(words), len(gone), kept))
    return out


def found(df):
    rows = df.collect()
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in rows)
    return [(r.doc_id, r.n_words, sum(r.ends) - sum(r.starts), r.kept) for r in rows]


def corpus(seed, texts, vocabulary):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["é", "\x00", "x\x00", " "]
    pool = [rng.choices(words, k=rng.randrange(3, 60)) for _ in range(5)]
    out = []
    for i in range(texts):
        parts = [q[rng.randrange(len(q)) :] if rng.random() < 0.7 else rng.choices(words, k=7) for q in rng.choices(pool, k=rng.randrange(0, 5))]
        out.append((rng.randrange(texts), rng.choice([" ", "\n", "\t \x0b"]).join(w for part in parts for w in part)))
    return out


def same(spark, rows, least=13, **sizes):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(found(p.dedup_passages(docs, least, **sizes)), key=key) == sorted(brute(rows, least), key=key)


@pytest.mark.parametrize("seed, vocabulary, least", [(1, 2, 3), (2, 3, 5), (3, 40, 13), (4, 1, 4), (5, 400, 13)])
def test_agrees_with_brute_force(spark, seed, vocabulary, least):
    same(spark, corpus(seed, 60, vocabulary), least)


@pytest.mark.parametrize("seed, group_text", [(1, 300), (2, 900), (3, 5000)])
def test_small_groups_chunks_and_buckets_give_the_same(spark, seed, group_text):
    """Prefixes grow word by word, beyond the length of a window, until their groups fit."""
    same(spark, corpus(seed, 50, 2), 3, group_text=group_text, chunk_text=700, codes=64)


def test_copies_and_overlaps(spark):
    """Whole copies, a copy that begins inside another, and a passage within unlike texts."""
    rng = random.Random(7)
    base = [f"t{k}" for k in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[50:90] + base[10:40])), (0, " ".join(base[80:100]))]
    rows += [(10 + k, " ".join(rng.choices(["u", "v", "z"], k=9) + base[200:214] + rng.choices(["m", "n"], k=5))) for k in range(40)]
    same(spark, rows)
    same(spark, rows, chunk_text=400, codes=32, group_text=500)


def test_messy_input(spark):
    docs = messy(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = p.dedup_passages(docs, 5)
    assert sorted(found(got), key=key) == sorted(brute(rows, 5), key=key)
    assert not set(CLASHING) - {"kept"} - {"n_words"} & set(got.columns)
    assert p.dedup_passages(empty(spark)).collect() == []
    with pytest.raises(TypeError):
        p.dedup_passages(docs.withColumn("doc_id", F.lit("a")))


def test_a_long_text(spark):
    """Two million words, and one word of a megabyte."""
    long = " ".join(str(k * k % 9973) for k in range(400_000))
    rows = [(1, long), (2, "x" * 1_000_000), (3, "x" * 1_000_000 + " " + long[:200]), (4, long[-5000:])]
    same(spark, rows)


def test_tree_finds_longest_earlier_prefix():
    bodies = [b"a b c d ", b"a b c ", b"a b c d e ", b"a b x ", b"q "]
    import numpy as np

    assert p.earlier_words(bodies, np.array([5, 4, 3, 9, 1]), 2).tolist() == [4, 3, 0, 2, 0]


def test_query_agrees_with_brute_force(spark):
    from brindle.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in Tables(spark, sf).documents.collect()]
    want = sorted((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(rows, 13))
    got = QUERIES["op11_prefix_suffix_trees"](spark, sf).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed for r in got) > 0
