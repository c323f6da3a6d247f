"""Codecs, JSON types, ranges and round trips; casts and text functions."""

import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import casts
from brindle.functions import text as tx
from brindle.session import Tables, scratch_path
from brindle.sources import files, text
from brindle.sources.json import merge_types, null_types_to_string, parse_json_column


def write_lines(spark, lines, label="lines"):
    path = scratch_path(spark, label)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


@pytest.mark.parametrize("low, high, parts", [(1, 100, 3), (0, 6, 7), (5, 5, 4), (-10, 9, 4), (0, 2**40, 9)])
def test_jdbc_ranges_cover_exactly(low, high, parts):
    edges = []
    for p in files.jdbc_range_predicates("id", low, high, parts):
        a, b = p.replace("id >= ", "").split(" AND id <= ")
        edges.append((int(a), int(b)))
    assert edges[0][0] == low and edges[-1][1] == high and len(edges) <= parts
    assert all(b + 1 == c for (_, b), (c, _) in zip(edges, edges[1:]))


def test_edge_list(spark, rows):
    path = write_lines(spark, ["# comment", "2 1", "3\t4", "", "1 2"])
    assert rows(text.read_edge_list(spark, path)) == [(1, 2), (2, 1), (3, 4)]
    assert rows(text.read_edge_list(spark, path, canonical=True)) == [(1, 2), (1, 2), (3, 4)]


def test_vectors_and_labeled_points(spark):
    rows = spark.createDataFrame([("[1.0, 2.5]",), ("(4,[1,3],[2.0,-1.0])",), ("1 2 3",)], "v string")
    assert [r[0] for r in rows.select(text.parse_vector(F.col("v"))).collect()] == [[1.0, 2.5], [0.0, 2.0, 0.0, -1.0], [1.0, 2.0, 3.0]]
    path = write_lines(spark, ["1,0.5 -2.0", "(0.0,[3.0,4.0])"])
    assert sorted((r.label, r.features) for r in text.read_labeled_points(spark, path).collect()) == [(0.0, [3.0, 4.0]), (1.0, [0.5, -2.0])]


def test_whole_files(spark):
    path = write_lines(spark, ["a", "b"])
    (row,) = text.read_whole_files(spark, path).filter(F.col("path").contains("part-")).collect()
    assert row.content == "a\nb\n"


def test_idx_pairs(spark, tmp_path):
    pixels = bytes([0, 31, 30, 255] * 3)
    (tmp_path / "t-images.idx").write_bytes(struct.pack(">IIII", 2051, 3, 2, 2) + pixels)
    (tmp_path / "t-labels.idx").write_bytes(struct.pack(">II", 2049, 3) + bytes([7, 8, 9]))
    out = files.read_idx_pairs(spark, f"{tmp_path}/*-images.idx", f"{tmp_path}/*-labels.idx").orderBy("i").collect()
    assert [r.label for r in out] == [7, 8, 9] and out[0].features == [0.0, 1.0, 0.0, 1.0]


def test_empty_table_flag(spark):
    path, schema = scratch_path(spark, "empty"), T.StructType([T.StructField("a", T.LongType())])
    assert files.create_empty_parquet(spark, path, schema).count() == 0
    files.create_empty_parquet(spark, path, schema, allow_existing=True)
    with pytest.raises(Exception):
        files.create_empty_parquet(spark, path, schema, allow_existing=False)


def test_type_merging():
    i, g, d, s, n = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.NullType()
    assert merge_types(i, g) == g and merge_types(g, d) == d and merge_types(n, i) == i and merge_types(i, s) == s
    assert merge_types(T.BooleanType(), i) == s
    a = T.StructType([T.StructField("x", i), T.StructField("y", s)])
    b = T.StructType([T.StructField("x", d)])
    assert merge_types(a, b).simpleString() == "struct<x:double,y:string>"
    assert merge_types(T.ArrayType(i), T.ArrayType(n)).simpleString() == "array<int>"
    assert merge_types(T.ArrayType(i), a) == s
    assert null_types_to_string(T.StructType([T.StructField("e", T.ArrayType(n))])).simpleString() == "struct<e:array<string>>"


def test_json_column_without_schema(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}',), ('{"a": 2.5}',), ('{"d": [1, 2]}',)], "j string")
    out = parse_json_column(df, "j")
    assert set(out.columns) == {"a", "b", "d"}
    assert sorted(float(r.a) for r in out.filter("a is not null").collect()) == [1.0, 2.5]


def test_casts(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    assert one(casts.string_to_int(F.lit("10.75"))) == 10 and one(casts.string_to_int(F.lit("x"))) is None
    assert one(casts.string_to_boolean(F.lit(""))) is False and one(casts.string_to_boolean(F.lit("false"))) is True
    assert one(casts.safe_divide(F.lit(1), F.lit(0))) is None and one(casts.safe_divide(F.lit(1), F.lit(4))) == 0.25
    top = 2**63 - 1
    assert one(casts.wrapping_add(F.lit(top), F.lit(1))) == -(2**63)
    assert one(casts.wrapping_add(F.lit(-(2**63)), F.lit(-1))) == top
    stamp = F.lit("2024-01-02 03:04:05.120").cast("timestamp_ntz")
    assert one(casts.trimmed_timestamp_text(stamp)) == "2024-01-02 03:04:05.12"
    assert one(casts.trimmed_timestamp_text(F.lit("2024-01-02 10:20:00").cast("timestamp_ntz"))) == "2024-01-02 10:20:00"


def test_text_functions(spark):
    df = spark.createDataFrame([("The cat sat. The cat ran.",), ("the dog sat",)], "t string")
    assert [(list(r.ngram), r.n) for r in tx.ngrams(df, "t", 2, 1).collect()] == [(["the", "cat"], 2)]
    got = tx.context_ngrams(df, "t", ["the", None], 5).collect()
    assert [(list(r.ngram), r.n) for r in got] == [(["cat"], 2), (["dog"], 1)]
    assert df.select(tx.bucket_hash(F.lit("val_238"))).first()[0] == java_hash("val_238")
    assert df.select(tx.field(F.lit("b"), F.lit("a"), F.lit("b"))).first()[0] == 2


def java_hash(s):
    h = 0
    for ch in s.encode():
        h = (31 * h + ch) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_scan_reads_only_what_is_asked(spark, capsys):
    t = Tables(spark, "/root/testdata/sf0.001")
    t.lineitem.filter("l_quantity > 30").select("l_orderkey").explain()
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan and "GreaterThan(l_quantity,30.0)" in plan
