"""Operators on small frames, hot keys and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators.approx import approx_count, approx_mean, approx_sum
from brindle.operators.grouping import cogroup, fold_by_key, group_lists, tree_aggregate
from brindle.operators.histogram import bound_histogram, even_histogram
from brindle.operators.ordered import average_rank, row_number_by, running_totals, sliding, zip_frames, zip_with_index
from brindle.operators.relational import (
    add_salt,
    auto_alias,
    bounded_cross,
    except_keep_duplicates,
    hot_keys,
    range_join,
    salted_join,
)
from brindle.operators.sampling import (
    bucket_sample,
    exact_stratified_sample,
    k_folds,
    reservoir_per_partition,
    take_sample,
    take_sample_with_replacement,
    unit_range_sample,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """4,000 rows, a third of them under key 0."""
    k = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)
    return spark.range(4000, numPartitions=6).select(k.alias("k"), F.col("id").alias("v"))


def test_zip_with_index_is_dense_and_ordered(spark):
    df = spark.range(1000, numPartitions=7).select((F.col("id") * 37 % 1000).alias("x"))
    out = zip_with_index(df, [F.col("x")], "i").collect()
    assert sorted((r.x, r.i) for r in out) == [(i, i) for i in range(1000)]


def test_zip_with_index_of_one_repeated_value(spark):
    out = zip_with_index(spark.range(500).select(F.lit(1).alias("x")), [F.col("x")], "i")
    assert sorted(r.i for r in out.collect()) == list(range(500))


def test_zip_with_index_of_nothing(spark):
    assert zip_with_index(spark.range(0), [F.col("id")], "i").count() == 0


def test_zip_frames_pairs_by_place(spark, rows):
    out = zip_frames(spark.range(5), spark.range(10, 15).toDF("y"), [F.col("id")], [F.desc("y")])
    assert rows(out, "id", "y") == [(i, 14 - i) for i in range(5)]


def test_row_number_in_hot_group(skewed):
    out = row_number_by(skewed, ["k"], [F.desc("v")], "n").collect()
    groups = {}
    for r in out:
        groups.setdefault(r.k, []).append((r.n, -r.v))
    assert len(out) == 4000
    for g in groups.values():
        g.sort()
        assert [n for n, _ in g] == list(range(1, len(g) + 1))
        assert [v for _, v in g] == sorted(v for _, v in g)


def test_running_totals_match_window(skewed, rows):
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("v")
    want = skewed.withColumn("s", F.sum("v").over(w))
    assert rows(running_totals(skewed, ["k"], [F.col("v")], {"s": F.col("v")}), "k", "v", "s") == rows(want, "k", "v", "s")


@pytest.mark.parametrize("size", [1, 2, 5])
def test_sliding_over_block_edges(spark, size):
    df = spark.range(103, numPartitions=5)
    out = sliding(df, [F.col("id")], size, F.col("id"), "w", block_rows=10).collect()
    assert sorted((r.start, list(r.w)) for r in out) == [(i, list(range(i, i + size))) for i in range(103 - size + 1)]


def test_sliding_longer_than_table_is_empty(spark):
    assert sliding(spark.range(3), [F.col("id")], 4, F.col("id")).count() == 0


def test_average_rank_shares_ties(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (2,), (2,), (5,)], "x int")
    assert rows(average_rank(df, "x", "r")) == [(1, 1.0), (2, 3.0), (2, 3.0), (2, 3.0), (5, 5.0)]


def test_except_keeps_left_duplicates_and_nulls(spark, rows):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (3, "y")], "k int, s string")
    b = spark.createDataFrame([(1, None), (3, "y"), (3, "y")], "a int, b string")
    assert rows(except_keep_duplicates(a, b)) == [(2, "x"), (2, "x")]


def test_auto_alias(spark):
    assert auto_alias(spark.range(1), "id", F.col("id") + 1, F.lit(2)).columns == ["id", "c1", "c2"]


def test_hot_keys_finds_only_the_hot_one(skewed):
    hot = hot_keys(skewed, ["k"], limit=10).collect()  # 0 holds 1,361 of 4,000 rows
    assert [r.k for r in hot] == [0]
    assert hot[0]["__salts"] >= 3


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(skewed, rows, how):
    small = skewed.sparkSession.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    got, want = salted_join(skewed, small, ["k"], how), skewed.join(small, "k", how)
    if how == "left":
        got, want = got.fillna(-1), want.fillna(-1)
    assert rows(got, *want.columns) == rows(want)


def test_range_join_equals_nested_loop(spark, rows):
    rng = random.Random(1)
    points = spark.createDataFrame([(rng.uniform(0, 100),) for _ in range(300)], "p double")
    ranges = spark.createDataFrame([(i, *sorted((rng.uniform(0, 100), rng.uniform(0, 100)))) for i in range(20)], "i int, lo double, hi double")
    want = points.join(ranges, (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi")))
    for width in (1.0, 7.5, 1000.0):
        assert rows(range_join(points, ranges, "p", "lo", "hi", width), "p", "i") == rows(want, "p", "i")


def test_bounded_cross_refuses_a_large_side(spark):
    assert bounded_cross(spark.range(3), spark.range(2).toDF("b"), 2).count() == 6
    with pytest.raises(ValueError):
        bounded_cross(spark.range(3), spark.range(3).toDF("b"), 2)


def test_group_lists_chunks_a_hot_key_without_loss(skewed):
    out = group_lists(skewed, "k", F.col("v"), "vs", max_rows=200).collect()
    assert sum(len(r.vs) for r in out) == 4000
    assert len([r for r in out if r.k == 0]) > 5
    assert max(len(r.vs) for r in out) < 400
    assert all(list(r.vs) == sorted(r.vs) for r in out)


def test_cogroup_fills_empty_sides(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    b = spark.createDataFrame([(2, 5), (3, 6)], "k int, v int")
    out = {r.k: (list(r.x), list(r.y)) for r in cogroup("k", {"x": (a, F.col("v")), "y": (b, F.col("v"))}).collect()}
    assert out == {1: (["a", "b"], []), 2: (["c"], [5]), 3: ([], [6])}


def test_cogroup_puts_all_values_of_a_side_beside_all_of_the_others(spark):
    a = spark.createDataFrame([(1, i % 20) for i in range(25)] + [(2, 7), (None, 1)], "k int, v int")
    b = spark.createDataFrame([(1, 100 + i) for i in range(3)] + [(3, 0)], "k int, v int")
    c = spark.createDataFrame([(1, "x")] * 12, "k int, v string")
    sides = {"x": (a, F.col("v")), "y": (b, F.col("v")), "z": (c, F.col("v")), "w": (b, F.col("v") + 1)}
    want = sorted((x, y, z) for x in [i % 20 for i in range(25)] for y in (100, 101, 102) for z in ["x"] * 12)
    for most in (5, 100):
        rows = cogroup("k", sides, most).filter("k = 1").collect()
        assert len({r.chunk for r in rows}) == len(rows) and max(len(r.x) for r in rows) <= (20 if most == 5 else 25)
        assert sorted((x, y, z) for r in rows for x in r.x for y in r.y for z in r.z) == want
        assert all(sorted(r.w) == [101, 102, 103] for r in rows)
    assert {(r.k, len(rows)) for r in cogroup("k", sides, 5).collect()} >= {(2, len(rows)), (3, len(rows))}


def test_lists_of_equal_values_are_split_and_placed_alike(spark):
    equal = spark.createDataFrame([(1, 5)] * 1000, "k int, v int").repartition(3)
    one, two = ({r.chunk: list(r.vs) for r in group_lists(equal.repartition(n), "k", F.col("v"), "vs", 100).collect()} for n in (2, 5))
    assert one == two and sum(map(len, one.values())) == 1000 and max(map(len, one.values())) < 200


def test_fold_by_key_of_a_hot_key(skewed, rows):
    def add(p):
        return p.groupby("k", as_index=False)[["v"]].sum()

    got = fold_by_key(skewed.select("k", "v"), ["k"], add, "k long, v long", fan_in=8, flush_rows=10)
    assert rows(got) == rows(skewed.groupBy("k").agg(F.sum("v").alias("v")))


def test_fold_over_null_keys_and_batches(spark, rows):
    """Keys that go over from batch to batch, null keys of two columns, and the order of the rows."""
    data = [(i % 7 or None, "ab"[i % 2] if i % 5 else None, i) for i in range(3000)]
    df = spark.createDataFrame(data, "k int, s string, v long").repartition(5)
    want = {}
    for k, s, v in data:
        want[k, s] = want.get((k, s), 0) + v
    add = lambda p: p.groupby(["k", "s"], dropna=False, as_index=False).v.sum()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = fold_by_key(df, ["k", "s"], add, "k int, s string, v long", fan_in=3, flush_rows=20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.k, r.s): r.v for r in got} == want and len(got) == len(want)


def test_fold_holds_one_batch_whatever_the_number_of_keys(spark):
    """Three million different keys in one partition: the task's memory is read where the rows are reduced."""

    def add(p):
        import resource

        out = p.groupby("k", as_index=False).agg(n=("n", "sum"), mb=("mb", "max"))
        out["mb"] = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
        return out

    keys = spark.range(0, 3_000_000, 1, 4).selectExpr("id AS k", "1L AS n", "0L AS mb")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = fold_by_key(keys, ["k"], add, "k long, n long, mb long").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.max("mb").alias("mb")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert (out.rows, out.n) == (3_000_000, 3_000_000) and out.mb < 500


@pytest.mark.parametrize("depth", [2, 3])
def test_tree_aggregate(skewed, depth):
    out = tree_aggregate(skewed, [F.sum("v").alias("s"), F.max("v").alias("m")], [F.sum("s").alias("s"), F.max("m").alias("m")], depth, 2)
    assert tuple(out.first()) == (sum(range(4000)), 3999)


def test_even_histogram_closes_the_last_bucket(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 10, 3)], "x double")
    assert [r.n for r in even_histogram(df, "x", 3).orderBy("bucket").collect()] == [4, 0, 1]


def test_even_histogram_of_one_value(spark):
    df = spark.createDataFrame([(4.0,)] * 3, "x double")
    assert [r.n for r in even_histogram(df, "x", 2).orderBy("bucket").collect()] == [3, 0]


def test_bound_histogram_ignores_what_is_outside(spark):
    df = spark.createDataFrame([(float(x),) for x in (-1, 0, 4, 5, 9, 10, 11)], "x double")
    assert [r.n for r in bound_histogram(df, "x", [0, 5, 10]).orderBy("bucket").collect()] == [2, 3]


def test_take_sample_sizes(spark):
    df = spark.range(100)
    assert take_sample(df, 30, 1).distinct().count() == 30
    assert take_sample(df, 300, 1).count() == 100
    assert take_sample_with_replacement(df, 150, 1).count() == 150


def test_exact_stratified_sample_sizes(skewed):
    out = exact_stratified_sample(skewed, "k", {0: 0.25, 1: 1.0, 2: 0.0}, [F.col("v")])
    sizes = {r.k: r["count"] for r in skewed.groupBy("k").count().collect()}
    got = {r.k: r["count"] for r in out.groupBy("k").count().collect()}
    assert got == {0: -(-sizes[0] // 4), 1: sizes[1]}


def test_folds_divide_the_table(spark):
    df = spark.range(200)
    seen = []
    for train, validation in k_folds(df, 3, 5):
        t, v = {r.id for r in train.collect()}, {r.id for r in validation.collect()}
        assert not t & v and len(t | v) == 200
        seen += list(v)
    assert sorted(seen) == list(range(200))


def test_unit_range_and_its_complement(spark):
    df = spark.range(500)
    a = {r.id for r in unit_range_sample(df, 0.1, 0.4, 3).collect()}
    b = {r.id for r in unit_range_sample(df, 0.1, 0.4, 3, complement=True).collect()}
    assert not a & b and len(a | b) == 500 and 100 < len(a) < 200


def test_bucket_samples_divide_the_table(spark):
    assert sum(bucket_sample(spark.range(100), i, 4, "id").count() for i in range(1, 5)) == 100


def test_reservoir_per_partition(spark):
    out = reservoir_per_partition(spark.range(90, numPartitions=3), 7, 1).collect()
    assert len(out) == 21 and {r.partition_rows for r in out} == {30}


def test_estimates_hold_the_truth(spark):
    df = spark.range(20000).select((F.col("id") % 2).alias("k"), (F.col("id") % 100).alias("v"))
    for r in approx_count(df, ["k"], 0.3, 0.999, 7).collect():
        assert r.low <= 10000 <= r.high
    r = approx_mean(df, "v", (), 0.3, 0.999, 7).first()
    assert r.low <= 49.5 <= r.high and r.high - r.low < 3
    r = approx_sum(df, "v", (), 0.3, 0.999, 7).first()
    assert r.low <= 990000 <= r.high


def test_equal_rows_of_a_hot_key_spread_over_all_salts(spark):
    equal = spark.range(20_000).select(F.lit(1).alias("k"), F.lit(2).alias("v")).unionAll(spark.range(5).select(F.lit(3).alias("k"), F.lit(4).alias("v")))
    hot = hot_keys(equal, ["k"])
    salts = hot.first()["__salts"]
    out = add_salt(equal, hot, ["k"])
    assert out.count() == 20_005
    assert out.filter("k = 1").select("__salt").distinct().count() > salts / 2
    joined = salted_join(equal, spark.createDataFrame([(1, "a"), (3, "b")], "k int, w string"), ["k"])
    assert {(r.w, r["count"]) for r in joined.groupBy("w").count().collect()} == {("a", 20_000), ("b", 5)}
