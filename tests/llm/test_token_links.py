import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from helpers import empty, messy
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm import token_links as t
from brindle.llm.queries import QUERIES
from brindle.session import Tables

A = Tokenizer.from_file(t.BYTE_LEVEL)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=t.PIECES)
LETTERS = t.byte_alphabet()
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256")


def tokens(text):
    """(id, bytes) of the tokens of the whole text, by both; None where they do not spell it."""
    if not text:
        return None
    a = [(i, bytes(LETTERS[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def ends(side):
    return np.cumsum([len(x) for _, x in side]).tolist()


def links_of(a, b):
    """Pairs of places that overlap, pairs within one group, groups as text."""
    ea, eb = ends(a), ends(b)
    cuts = sorted(set(ea) & set(eb))
    group = lambda e: next(k for k, c in enumerate(cuts) if e <= c)
    ga, gb = [group(e) for e in ea], [group(e) for e in eb]
    over = {}
    for i, (_, x) in enumerate(a):
        for j, (_, y) in enumerate(b):
            shared = min(ea[i], eb[j]) - max(ea[i] - len(x), eb[j] - len(y))
            if shared > 0:
                over[i, j] = shared
    shared = [(i, j) for i in range(len(a)) for j in range(len(b)) if ga[i] == gb[j]]
    text = ";".join(
        ",".join(str(a[i][0]) for i in range(len(a)) if ga[i] == k) + "|" + ",".join(str(b[j][0]) for j in range(len(b)) if gb[j] == k) for k in range(len(cuts))
    )
    return over, shared, text, len(cuts)


def fast_links(a, b):
    """Overlapping pairs by a walk along both sides, for longer texts."""
    ea, eb, out, i, j = ends(a), ends(b), [], 0, 0
    while i < len(a):
        out.append((i, j))
        if ea[i] == eb[j]:
            i, j = i + 1, j + 1
        elif ea[i] < eb[j]:
            i += 1
        else:
            j += 1
    return out


def brute(rows):
    docs, count = [], Counter()
    for key, text in rows:
        both = tokens(text)
        links = [(both[0][i][0], both[1][j][0]) for i, j in fast_links(*both)] if both else []
        count.update(set(links))
        docs.append((key, both, links))
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for key, both, links in docs:
        if not both:
            out.append((key, *[0] * 7, ""))
            continue
        a, b = both
        cuts = sorted(set(ends(a)) & set(ends(b)))
        ga, gb = (np.searchsorted(cuts, ends(x)) for x in (a, b))
        parts = [[[], []] for _ in cuts]
        for k, side in enumerate((a, b)):
            for g, (i, _) in zip((ga, gb)[k], side, strict=True):
                parts[g][k].append(str(i))
        text = ";".join(",".join(x) + "|" + ",".join(y) for x, y in parts)
        shared = sum(len(x) * len(y) for x, y in parts)
        best = sum(count[p] == highest[p[0]] for p in links)
        out.append((key, len(a), len(b), len(cuts), len(links), shared, best, sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


ODD = ["a", " ", "  ", "\n", "\t", "é", "日本", "\x00", "­", "​", " ", "▁", "<s>", "<|endoftext|>", "<0x41>", "’s", "'s", "12345", "word", "Word.", "🎉", "﻿", "́", "᠎"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=14).map("".join) | st.text(max_size=20))
def test_units_are_tokenised_as_the_whole(text):
    """Ids, groups and links of a text put together from its units are those of the whole text."""
    both = t.tokenizers(t.BYTE_LEVEL, t.PIECES)
    n, a, b, ga, gb, links, shared = t.linked(text, both)
    whole = tokens(text)
    if whole is None:
        assert (n, a, b) == (0, [], [])
        return
    assert (a, b) == tuple([i for i, _ in x] for x in whole)
    over, same_group, _, groups = links_of(*whole)
    assert {(x["a"], x["b"]): x["bytes"] for x in links} == over and len(links) == len(over)
    assert [(x["a"], x["b"]) for x in shared] == same_group and max(ga) + 1 == max(gb) + 1 == groups


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x24F), max_size=30), max_size=20))
def test_the_quick_engine_gives_the_same_ids(texts):
    both = t.tokenizers(t.BYTE_LEVEL, t.PIECES)
    assert both.plain is not None
    assert both._encode_a(texts) == [e.ids for e in both.a.encode_batch_fast(texts, add_special_tokens=False)]


def test_every_plain_character_is_taken_alike():
    both = t.tokenizers(t.BYTE_LEVEL, t.PIECES)
    plain = [c for c in map(chr, range(0x250)) if t.PLAIN.fullmatch(c)]
    texts = [f"{a}{c}{b}" for c in plain for a in ("x", " ", "1", ".", "\n", "'") for b in ("y", " ", "2", "!", "\n", "s")]
    assert both._encode_a(texts) == [e.ids for e in both.a.encode_batch_fast(texts, add_special_tokens=False)] and len(plain) > 400


@pytest.mark.parametrize("seed", range(4))
def test_gustavson_product_is_the_product(seed):
    rng = np.random.default_rng(seed)
    dense = [rng.integers(0, 4, (7, 9)) * (rng.random((7, 9)) < 0.4), rng.integers(0, 4, (9, 5)) * (rng.random((9, 5)) < 0.4)]
    a, b = (t.Csr(np.concatenate([[0], np.cumsum((m > 0).sum(axis=1))]), np.nonzero(m)[1], m[m > 0]) for m in dense)
    got = t.product(a, b)
    out = np.zeros((7, 5), int)
    out[got.rows, got.indices] = got.data
    assert (out == dense[0] @ dense[1]).all()
    v = rng.integers(0, 9, 9)
    assert (a.times(v) == dense[0] @ v).all()


def corpus(seed, texts):
    rng = random.Random(seed)
    return [(rng.randrange(texts), "".join(rng.choices([*ODD, "the ", "of ", "thing "], k=rng.randrange(0, 60)))) for _ in range(texts)]


@pytest.mark.parametrize("seed, sizes", [(1, {}), (2, {"chunk_text": 500, "pairs": 1}), (3, {"chunk_text": 3000, "pairs": 7})])
def test_agrees_with_brute_force(spark, seed, sizes):
    rows = [*corpus(seed, 60), (None, None), (7, ""), (8, "the the the"), (8, "the the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = t.align_documents(docs, **sizes).collect()
    assert ordered((r.doc_id, *[r[f] for f in FIELDS]) for r in got) == ordered(brute(rows))


def test_messy_input(spark):
    docs = messy(spark).withColumnRenamed("bucket", "chunk")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = t.align_documents(docs)
    assert ordered((r.doc_id, *[r[f] for f in FIELDS]) for r in got.collect()) == ordered(brute(rows))
    assert t.align_documents(empty(spark)).collect() == [] == t.link_documents(empty(spark)).collect()
    linked = t.link_documents(docs).collect()
    assert sorted(len(r.links) for r in linked) == sorted(r.n_links for r in got.collect())


def test_a_long_text_and_a_long_word(spark):
    rng = random.Random(5)
    rows = [(1, " ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(400_000))), (2, "xy" * 50_000), (3, "\n".join(["a b"] * 50_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = t.align_documents(docs).collect()
    assert ordered((r.doc_id, *[r[f] for f in FIELDS]) for r in got) == ordered(brute(rows))


def test_query_agrees_with_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in Tables(spark, sf).documents.collect()]
    got = QUERIES["op13_gustavson_token_links"](spark, sf).collect()
    assert ordered((r.doc_id, *[r[f] for f in FIELDS]) for r in got) == ordered(brute(rows))
