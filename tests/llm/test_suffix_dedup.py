import hashlib

import numpy as np
import pytest
from helpers import MESSY, empty, messy, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import suffix_dedup as S
from brindle.llm.anchors import anchors_of


def brute(docs, least):
    """(removed, spans, digest) per document, by a set of all strings seen so far."""
    seen, out = set(), {}
    for doc, data in sorted(docs):
        hit = np.zeros(len(data), bool)
        for i in range(len(data) - least + 1):
            window = data[i : i + least]
            if window in seen:
                hit[i : i + least] = True
            seen.add(window)
        kept = bytes(np.frombuffer(data, np.uint8)[~hit])
        edges = np.diff(np.concatenate([[0], hit.astype(int)]))
        out[doc] = (int(hit.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest(), kept)
    return out


def run(spark, docs, least, **sizes):
    df = spark.createDataFrame([(d, t.decode()) for d, t in docs], "doc_id long, text string").repartition(3)
    rows = S.dedup_substrings(df, least, **sizes).collect()
    return {r.doc_id: (sum(r.ends) - sum(r.starts), len(r.starts), r.kept_sha256, bytes(r.kept)) for r in rows}


@pytest.mark.parametrize("least, sizes", [(20, {}), (20, {"hot": 1}), (45, {"bucket_text": 700}), (100, {"hot": 2, "bucket_text": 3000})])
def test_agrees_with_brute_force(spark, least, sizes):
    docs = [(i, t.encode()) for i, t in enumerate(prose(5, 40))]
    docs += [(100, b"ab" * 200), (101, b"x" * 300), (102, b"ab" * 90), (103, b""), (104, b"short")]
    want = brute(docs, least)
    assert any(w[0] for w in want.values())
    assert run(spark, docs, least, **sizes) == want


def test_first_copy_stays_and_characters_may_be_cut(spark):
    text = "é" * 30 + "0123456789" * 5
    docs = [(2, f"É{text}".encode()[1:].decode("utf-8", "replace").encode()), (1, text.encode())]
    assert run(spark, docs, 40) == brute(docs, 40)


def test_nulls_repeated_rows_and_clashing_columns(spark):
    rows = S.dedup_substrings(messy(spark), 20).collect()
    assert len(rows) == len(MESSY)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert [r.n_bytes for r in by_id[2] + by_id[3]] == [0, 0]
    assert by_id[1][0].starts == []
    assert by_id[None][0].ends == [33]
    twice = [r for r in by_id[4] if r.n_bytes == 33]
    assert len(twice) == 2 and all(r.starts == [0] for r in twice)


def test_empty_table(spark):
    assert S.dedup_substrings(empty(spark)).collect() == []


def test_long_text_goes_in_pieces():
    raw = np.frombuffer("".join(prose(9, 30)).encode(), np.uint8)
    whole = {(int(s), int(g)) for _, _, lo, hi, g, _ in [anchors_of(raw, np.array([0, len(raw)]), 50)] for a, b, g in zip(lo, hi, g, strict=True) for s in range(a, b + 1)}
    pieces = set()
    for at in range(0, len(raw), 500):
        part = raw[at : at + 549]
        _, _, lo, hi, gram, _ = anchors_of(part, np.array([0, len(part)]), 50)
        pieces |= {(at + s, int(g)) for a, b, g in zip(lo, hi, gram, strict=True) for s in range(a, b + 1)}
    assert pieces == whole


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 20))
def test_suffix_array_and_factors(data, depth):
    raw = np.frombuffer(data, np.uint8)
    starts = np.arange(max(0, len(raw) - depth + 1))
    order, lcp = S.suffix_array(raw, starts, depth)
    cut = [bytes(raw[s : s + depth]) for s in starts[order]]
    assert cut == sorted(cut)
    for i in range(1, len(cut)):
        same = next((k for k in range(depth) if cut[i][k] != cut[i - 1][k]), depth)
        assert lcp[i] == same
    factors = S.longest_previous_factors(starts[order], lcp)
    for s, f in zip(starts[order].tolist(), factors.tolist(), strict=True):
        earlier = [next((k for k in range(depth) if data[e + k] != data[s + k]), depth) for e in range(s)]
        assert f == max(earlier, default=0)


def test_united_spans():
    spans = {"did": np.array([1, 1, 1, 2]), "dk": np.zeros(4, np.int64), "lo": np.array([5, 0, 7, 0]), "hi": np.array([8, 5, 7, 2])}
    got = S.united(spans)
    assert list(zip(got["did"], got["lo"], got["hi"], strict=True)) == [(1, 0, 8), (2, 0, 2)]
