import duckdb
import numpy as np
import pytest
from helpers import empty

import corpus_pipeline
from brindle.llm import line_dedup, order_minhash, quality, queries
from brindle.llm.common import words_of
from brindle.llm.decontaminate import build, search
from brindle.session import Tables
from test_line_dedup import brute as brute_lines
from test_order_minhash import roots
from tools.check_oracle import run_one

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    result = run_one(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(n for n in set(queries.QUERIES) - set(queries.ORACLES) if not n.startswith("op12_")))
def test_query_returns_a_row_per_document(spark, name):
    ids = [r.doc_id for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in Tables(spark, SF).documents.select("doc_id").collect())


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_agree_with_brute_force(spark):
    """Every stage on what the one before it kept, against a plain computation of its decisions."""
    t = Tables(spark, SF)
    docs = t.documents
    before = {r.doc_id: r.text for r in docs.collect()}
    after = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), t.documents.schema)
        assert docs.columns == t.documents.columns, name
        rows = docs.collect()
        assert all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id])
        after.append({r.doc_id: r.text for r in rows})
    good, lines, near, clean = after

    scores = {r.doc_id: r.predicted for r in quality.score_quality(t.documents, t.labels).collect()}
    assert set(good) == {i for i, p in scores.items() if p}

    gone = brute_lines(sorted(good.items()), line_dedup.LEAST_WORDS)
    for doc, text in good.items():
        left = "\n".join(x for i, x in enumerate(text.split("\n")) if not any(a <= i < b for a, b in gone[doc]))
        assert lines.get(doc, left if not left.strip() else None) == left

    ids = {}
    words = {i: np.array([ids.setdefault(w, len(ids)) for w in words_of(x.encode())], np.int64) for i, x in lines.items()}
    classes = roots(sorted(words), lambda a, b: order_minhash.similar(words[a], words[b]))
    assert set(near) == set(classes.values())

    searchers = build([(str(r.item_id), r.text.encode()) for r in t.benchmark.collect()], 10)
    assert set(clean) == {i for i, x in near.items() if not search(words_of(x.encode()), searchers)[0]}

    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in final} == set(clean) and all(r.decoded for r in final)


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and "ids" in out.columns
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_an_empty_table(spark):
    docs = empty(spark).selectExpr("doc_id", "text", "'' AS lang", "'' AS source", "0L AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_stages_keep_columns_of_their_own_names(spark):
    """Nulls, repeated rows, and columns that are named as the operators' results."""
    names = ("n_lines", "n_removed", "n_runs", "kept", "class_id", "row_key")
    lines = "\n".join(f"one two three four five six seven eight nine line {k}" for k in range(4))
    rows = [(1, lines + "\nfirst", 5), (2, "second\n" + lines, 5), (3, None, 0), (None, "", 0), (4, "short", 5), (4, "short", 5)]
    docs = spark.createDataFrame([(*r, "en", "s", *[-7] * len(names)) for r in rows], "doc_id long, text string, n_chars long, lang string, source string, " + ", ".join(f"{n} int" for n in names))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[n] == -7 for r in found for n in names)
