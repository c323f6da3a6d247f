import random

from helpers import MESSY, empty, messy
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import decontaminate as D
from brindle.llm.common import words_of


def brute(words, items, window):
    hit, found = set(), set()
    for item, text in items:
        pattern = words_of(text)
        size = min(window, len(pattern))
        for at in range(len(pattern) - size + 1) if size else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == pattern[at : at + size]:
                    hit |= set(range(i, i + size))
                    found.add(item)
    return hit, sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=8), max_size=4), st.integers(1, 5))
def test_search_agrees_with_brute_force(words, patterns, window):
    items = sorted((str(i), b" ".join(p)) for i, p in enumerate(patterns))
    starts, ends, found = D.search(words, D.build(items, window))
    hit, want = brute(words, items, window)
    assert {i for s, e in zip(starts, ends, strict=True) for i in range(s, e)} == hit
    assert found == want and all(e < s for e, s in zip(ends, starts[1:], strict=False))


def tables(spark):
    rng = random.Random(4)
    words = "alpha Beta gamma dé 7 eps".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(80)))) for i in range(40)]
    bench = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(12)] + [(50, None), (None, "alpha beta gamma"), (3, "alpha 7")]
    return docs, bench, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")


def test_tables_in_one_pass_and_in_blocks(spark):
    docs, bench, d, b = tables(spark)
    items = [("" if i is None else str(i), (t or "").encode()) for i, t in bench]
    want = {i: brute(words_of(t.encode()), items, 4) for i, t in docs}
    for size in (D.BLOCK_BYTES, 60):
        rows = D.decontaminate(d, b, 4, size).withColumn("n_hit", D.hit_words()).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == {i: (len(words_of(t.encode())), len(want[i][0]), want[i][1]) for i, t in docs}
        assert {r.doc_id: [i for s, e in zip(r.starts, r.ends, strict=True) for i in range(s, e)] for r in rows} == {i: sorted(w[0]) for i, w in want.items()}


def test_nulls_repeated_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "two three four"), (2, "")], "item_id long, text string")
    for size in (D.BLOCK_BYTES, 8):
        rows = D.decontaminate(messy(spark), bench, 3, size).collect()
        assert sorted((r.doc_id or 0, r.n_words, len(r.starts)) for r in rows) == sorted((i or 0, len(words_of((t or "").encode())), int("two three" in (t or ""))) for i, t, _ in MESSY)
    assert D.decontaminate(empty(spark), bench).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.starts == [] for r in D.decontaminate(messy(spark), none).collect())
    clean = D.clean_documents(messy(spark), bench, 3)
    assert clean.columns == messy(spark).columns
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5, 6]
