import hashlib
import re

import pytest
from helpers import MESSY, empty, messy
from pyspark.sql import functions as F

from brindle.llm import exact_stream as E


def want(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    groups = {}
    for (i, *_), n in zip(rows, norm, strict=True):
        groups.setdefault(n, []).append(i)
    keep = {n: min((i for i in g if i is not None), default=None) for n, g in groups.items()}
    return sorted(((i, keep[n], len(groups[n]), i == keep[n]) for (i, *_), n in zip(rows, norm, strict=True)), key=str)


ROWS = MESSY + [(i, f"text  {i % 5}\t\n of {i % 3}", "x") for i in range(10, 60)] + [(70, " a"), (71, "a"), (72, "\n a")]


def written(spark, tmp_path, files=4):
    df = spark.createDataFrame([(r[0], r[1]) for r in ROWS], "doc_id long, text string")
    df.select("*", F.lit(1).alias("digest"), F.lit("f").alias("file"), F.lit(2).alias("n")).repartition(files).write.parquet(str(tmp_path / "docs"))
    return str(tmp_path / "docs")


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def weak(text):
    return F.unhex(F.substring(F.sha2(E.normalised(text).cast("binary"), 256), 1, 1).cast("string"))


@pytest.mark.parametrize("options", [{}, {"max_files": 1}, {"digest": weak}, {"max_files": 2, "digest": weak}])
def test_any_batches_and_any_digest(spark, tmp_path, options):
    assert result(E.exact_dedup(spark, written(spark, tmp_path), **options)) == want(ROWS)


def test_digest_is_of_the_normalised_text(spark, tmp_path):
    rows = E.exact_dedup(spark, written(spark, tmp_path)).select("doc_id", F.lower(F.hex("digest")).alias("d")).collect()
    text = {r[0]: r[1] for r in ROWS if r[0] not in (4, None)}
    assert all(r.d == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text[r.doc_id] or "").encode()).hexdigest() for r in rows if r.doc_id in text)


def test_state_goes_on_after_a_restart(spark, tmp_path):
    path, folder = written(spark, tmp_path, 1), str(tmp_path / "state")
    E.exact_dedup(spark, path, folder=folder)
    more = spark.createDataFrame([(-5, "text 1 of 1")], "doc_id long, text string")
    more.select("*", F.lit(1).alias("digest"), F.lit("f").alias("file"), F.lit(2).alias("n")).write.mode("append").parquet(path)
    stream = spark.readStream.schema("doc_id long, text string").parquet(path)
    stream = stream.select("doc_id", E.digest_of("text").alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    state = E.first_of_each_digest(stream, folder)
    digest = bytes.fromhex(hashlib.sha256(b"text 1 of 1").hexdigest())
    row = state.filter(F.col("digest") == F.lit(digest)).first()
    assert row.keep_id == -5 and row.n == 1 + sum(1 for i in range(10, 60) if i % 5 == 1 and i % 3 == 1)


def test_clashing_columns_and_empty_table(spark, tmp_path):
    messy(spark).write.parquet(str(tmp_path / "m"))
    assert result(E.exact_dedup(spark, str(tmp_path / "m"))) == want(MESSY)
    empty(spark).write.parquet(str(tmp_path / "e"))
    assert E.exact_dedup(spark, str(tmp_path / "e")).collect() == []


def test_the_state_is_met_by_several_batches(spark, tmp_path):
    """Unless told otherwise, a table of several files takes several triggers."""
    import os

    path, folder = written(spark, tmp_path, 8), str(tmp_path / "state")
    assert result(E.exact_dedup(spark, path, folder=folder)) == want(ROWS)
    assert sum(n.startswith("batch=") for n in os.listdir(f"{folder}/touched")) >= 3
