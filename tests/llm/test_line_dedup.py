import random

import numpy as np
import pytest
from helpers import MESSY, empty, messy
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import line_dedup as L
from brindle.llm.common import words_of


def lines_of(text):
    return [(i, x.encode().strip(), len(words_of(x.encode()))) for i, x in enumerate((text or "").split("\n")) if words_of(x.encode())]


def brute(docs, least):
    """Numbers of the lines in a run of at least ``least`` words that also stands earlier."""
    first, out = {}, {}
    for doc, text in sorted(docs):
        k = lines_of(text)
        marked = set()
        for i in range(len(k)):
            for j in range(i + 1, len(k) + 1):
                if sum(x[2] for x in k[i:j]) >= least:
                    if first.setdefault(tuple(x[1] for x in k[i:j]), (doc, i)) != (doc, i):
                        marked |= set(range(i, j))
        runs = []
        for m in sorted(marked):
            if runs and runs[-1][1] == m:
                runs[-1][1] = m + 1
            else:
                runs.append([m, m + 1])
        out[doc] = [(k[a][0], k[b - 1][0] + 1) for a, b in runs]
    return out


def corpus(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("a bb c dé".split(), k=rng.choice([1, 2, 3, 9]))) for _ in range(12)] + ["", "  ", "--"]
    runs = [[rng.choice(pool) for _ in range(rng.randrange(1, 6))] for _ in range(5)]
    docs = []
    for i in range(40):
        lines = [x for _ in range(rng.randrange(5)) for x in rng.choice(runs)] + rng.choices(pool, k=rng.randrange(4))
        docs.append((i, "\n".join(rng.choice(["", " "]) + x for x in lines)))
    return docs


@pytest.mark.parametrize("seed, least", [(1, 4), (2, 8), (3, 1)])
def test_agrees_with_brute_force(spark, seed, least):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs, least)
    assert any(want.values())
    got = {r.doc_id: list(zip(r.starts, r.ends, strict=True)) for r in L.repeated_runs(df, least).collect()}
    assert got == want
    left = {r.doc_id: r for r in L.dedup_lines(df, least).collect()}
    for doc, text in docs:
        gone = {i for a, b in want[doc] for i in range(a, b)}
        assert left[doc].text == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
        assert (left[doc].n_removed, left[doc].n_runs) == (len(gone), len(want[doc]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=15), st.integers(1, 12))
def test_windows_cover_every_long_run(words, least):
    found = {tuple(w) for w in L.windows(np.array(words, np.int64), least).tolist()}
    assert all(sum(words[a:b]) >= least for a, b in found)
    for a in range(len(words)):
        for b in range(a + 1, len(words) + 1):
            if sum(words[a:b]) >= least:
                covered = {i for x, y in found if a <= x and y <= b for i in range(x, y)}
                assert covered == set(range(a, b))


def test_equal_windows_have_equal_fingerprints():
    a, b = np.array([5, 6, 7, 8], np.uint64), np.array([9, 6, 7, 3], np.uint64)
    words = np.array([1, 1, 1, 1])
    fa, wa = L.fingerprints(a, words, 2)
    fb, wb = L.fingerprints(b, words, 2)
    keys = lambda f, w: {tuple(x): tuple(y) for x, y in zip(f.tolist(), w.tolist(), strict=True)}
    shared = set(keys(fa, wa)) & set(keys(fb, wb))
    assert {keys(fa, wa)[s] for s in shared} == {(1, 3)}


def test_nulls_repeats_clashing_columns_and_empty_table(spark):
    out = L.dedup_lines(messy(spark), 5)
    rows = out.collect()
    assert len(rows) == len(MESSY) and set(messy(spark).columns) <= set(out.columns)
    assert sorted(r.text for r in rows if r.doc_id == 1) == ["one two three four five six seven"]
    assert [r.text for r in rows if r.doc_id is None] == [""]
    assert [r.text for r in rows if r.doc_id == 2] == [None]
    assert sorted(r.text for r in rows if r.doc_id == 4) == ["", "", "another text under the same number"]
    assert L.dedup_lines(empty(spark)).collect() == []
