import numpy as np
import pytest
import sentencepiece
from helpers import MESSY, empty, messy

from brindle.llm import segmentations as G


@pytest.fixture(scope="module")
def vocabulary():
    return G.read_vocabulary()


def every(unit, v):
    """All segmentations of a unit with their log weights."""
    weights = dict(zip(v.texts, v.weights, strict=True))
    if not unit:
        return [((), 0.0)]
    out = []
    for n in range(1, min(v.longest, len(unit)) + 1):
        if unit[:n] in weights:
            out += [((unit[:n], *rest), weights[unit[:n]] + w) for rest, w in every(unit[n:], v)]
    if unit[0] not in weights:
        code = unit[0].encode()
        out += [((*code, *rest), len(code) * v.byte_weight + w) for rest, w in every(unit[1:], v)]
    return out


def chances(text, v):
    paths = [((), 0.0)]
    for u in G.units_of(text):
        paths = [(a + b, x + y) for a, x in paths for b, y in every(f" {u}", v)]
    total = np.logaddexp.reduce([w for _, w in paths])
    return {p: w - total for p, w in paths}


def names(draw, v):
    return tuple(v.bytes_of[i].decode() if i not in v.byte_ids else v.bytes_of[i][0] for i in draw["ids"].tolist())


@pytest.mark.parametrize("text", ["or it", "the\nis"])
def test_draws_follow_the_law_without_replacement(vocabulary, text):
    law = chances(text, vocabulary)
    n, k = 20000, 3
    drawn = G.segment([text] * n, np.arange(n), vocabulary, k)
    first, second, total = {}, {}, []
    for draws in drawn:
        paths = [names(d, vocabulary) for d in draws]
        assert len(set(paths)) == len(paths) == min(k, len(law))
        assert all(abs(law[p] - d["log_prob"]) < 1e-9 for p, d in zip(paths, draws, strict=True))
        assert all(a["perturbed"] > b["perturbed"] for a, b in zip(draws, draws[1:], strict=False))
        first[paths[0]] = first.get(paths[0], 0) + 1 / n
        second[paths[0], paths[1]] = second.get((paths[0], paths[1]), 0) + 1 / n
        total.append([np.exp(d["log_prob"] - d["log_inclusion"]) * len(d["ids"]) for d in draws])
    assert all(abs(first.get(p, 0) - np.exp(w)) < 0.015 for p, w in law.items())
    for (a, b), share in second.items():
        assert abs(share - np.exp(law[a] + law[b]) / (1 - np.exp(law[a]))) < 0.015
    # Inclusion scores weigh draws so that sums over them estimate sums over all segmentations.
    expected = sum(np.exp(w) * len(p) for p, w in law.items())
    sums = np.array([sum(t) for t in total])
    assert abs(sums.mean() - expected) < 5 * sums.std() / np.sqrt(n) + 1e-6


def test_all_segmentations_come_when_there_are_few(vocabulary):
    law = chances("a", vocabulary)
    (draws,) = G.segment(["a"], np.array([3]), vocabulary, 50)
    assert {names(d, vocabulary) for d in draws} == set(law) and all(d["log_inclusion"] == 0 for d in draws)


def test_round_trip_and_agreement_with_the_library(vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=G.MODEL)
    texts = ["", " ", "  a ", "a  b", "é\n你 xy 🎉z", "tab\there\r\n", "x" * 400, "▁ under", "ends in spaces   "]
    for text, draws in zip(texts, G.segment(texts, np.arange(len(texts)), vocabulary, 4), strict=True):
        for d in draws:
            assert vocabulary.decode(d["ids"].tolist()) == text
            codes = np.array([ord(c) for c in text], np.uint32)
            assert vocabulary.spell(d["ids"], text, codes) and not vocabulary.spell(d["ids"], text + "a", np.append(codes, np.uint32(97)))
            assert not len(text) or not vocabulary.spell(d["ids"], "~" + text[1:], np.append(np.uint32(126), codes[1:]).astype(np.uint32))
            if "▁" not in text:
                assert model.decode(d["ids"].tolist()).lstrip(" ") == text.lstrip(" ")
    assert [len(d) for d in G.segment([""], np.array([1]), vocabulary, 3)] == [1]


def test_a_text_draws_the_same_whatever_is_beside_it(vocabulary):
    one = G.segment(["some words here"], np.array([9]), vocabulary, 3)[0]
    two = G.segment(["other", "some words here", ""], np.array([1, 9, 2]), vocabulary, 3)[1]
    assert [d["ids"].tolist() for d in one] == [d["ids"].tolist() for d in two]


def test_a_long_text_of_rare_words_draws_the_same_behind_any_neighbours(vocabulary):
    rng = np.random.default_rng(5)
    rare = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxzaeiou"), rng.integers(6, 14))) for _ in range(600)]
    text = " ".join(rare)
    want = None
    for before in ([], ["one"], ["some words more here", " ".join(rare[300:] + rare[:9])], [" ".join(rare)] * 3):
        keys = np.array([*range(100, 100 + len(before)), 9, 8])
        draws = G.segment([*before, text, "after"], keys, vocabulary, 4)[len(before)]
        got = [(len(d["ids"]), d["ids"].tolist(), d["log_prob"], d["perturbed"], d["log_inclusion"]) for d in draws]
        want = want or got
        assert len(got) == 4 and got == want


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    rows = G.sample_segmentations(messy(spark), k=3, keep_ids=2).collect()
    assert len(rows) == len(MESSY) and all(r.decoded for r in rows)
    assert all(s.ids is None for r in rows for s in r.samples[2:])
    twice = [r.samples for r in rows if r.doc_id == 4 and r.samples[0].n_pieces < 40]
    assert len([s for s in twice if s == twice[0]]) >= 2 or len(twice) == 3
    assert [len(r.samples) for r in rows if r.doc_id in (2, 3)] == [1, 1]
    assert G.sample_segmentations(empty(spark)).collect() == []


def test_decode_operator(spark):
    from pyspark.sql import functions as F

    drawn = G.sample_segmentations(messy(spark), k=1).select("doc_id", F.get("samples.ids", F.lit(0)).alias("ids"))
    got = sorted((r.doc_id or 0, r.text) for r in G.decode_segmentations(drawn).collect())
    assert got == sorted((i or 0, t or "") for i, t, _ in MESSY)


def test_query_and_last_stage_give_the_ids_of_every_draw(spark, tmp_path, vocabulary):
    import hashlib

    import corpus_pipeline
    from brindle.llm import queries

    messy(spark).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = sorted(t or "" for _, t, _ in MESSY)
    for rows in (queries.op4_gumbel_top_k_segmentation(spark, str(tmp_path)).collect(), corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()):
        for r in rows:
            assert len(r.ids) == len(r.n_pieces) == len({tuple(i) for i in r.ids})
            assert [len(i) for i in r.ids] == r.n_pieces and len({vocabulary.decode(i) for i in r.ids}) == 1
            assert [hashlib.sha256(np.array(i, "<i4")).hexdigest() for i in r.ids] == r.ids_sha256
        assert sorted(vocabulary.decode(r.ids[0]) for r in rows) == texts
