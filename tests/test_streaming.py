"""Streams replayed batch by batch against the batch answer."""

import datetime as dt
import os
import random
import re
import time
from collections import Counter
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.session import scratch_path
from brindle.learn import linear
from brindle.sources.inbox import Inbox, deliver, inbox_stream
from brindle.streaming.model import StreamedModel
from brindle.streaming.replay import file_stream, run_at_intervals, run_batches, run_to_table, state_on_disk
from brindle.streaming.sketch import CountMin, HeavyHitters
from brindle.streaming.sources import BatchQueue, Closing, by_side, constant_stream, together
from brindle.streaming.state import KeyedState, running_counts_with_timeout
from brindle.streaming.windows import panes, windowed, windows_from_panes

# Batches of (key, value): keys that grow, shrink and fall silent.
BATCHES = [
    [("a", 1)], [("a", 1), ("b", 1)], [("a", 1), ("b", 1), ("c", 1)], [("a", 1), ("b", 1)], [("a", 1)], [],
    [("a", 1)], [("a", 1), ("b", 1)], [("a", 1), ("b", 1), ("c", 1)], [("a", 1), ("b", 1)], [("a", 1)], [],
]


def queue(spark, batches, schema, label="q"):
    rows = [(i, *r) for i, b in enumerate(batches) for r in b]
    df = spark.createDataFrame(rows, f"b int, {schema}")
    return BatchQueue(df, F.col("b"), len(batches), label)


def timed(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=i), k, v) for i, b in enumerate(BATCHES) for k, v in b]
    return spark.createDataFrame(rows, "ts timestamp_ntz, k string, v int")


def test_each_feed_is_one_batch(spark):
    q, seen = queue(spark, BATCHES[:3], "k string, v int"), []
    run_batches(q.stream, lambda b, i: seen.append((i, b.count())), "seen", feeds=q.feeds)
    assert [n for _, n in seen if n] == [1, 2, 3]


def test_all_feeds_at_once_are_one_batch(spark):
    q, seen = queue(spark, BATCHES[:3], "k string, v int"), []
    for feed in q.feeds:
        feed()
    run_batches(q.stream, lambda b, i: seen.append(b.count()), "once")
    assert [n for n in seen if n] == [6]


def test_sliding_windows_from_panes_equal_recomputation(spark, rows):
    df = timed(spark)
    path = scratch_path(spark, "timed")
    df.repartition(3).write.parquet(path)
    aggs = {"n": F.lit(1), "s": F.col("v")}
    whole = windowed(df, "ts", "4 seconds", "2 seconds", ["k"], [F.sum(c).alias(n) for n, c in aggs.items()])
    kept = run_to_table(panes(file_stream(spark, path), "ts", "2 seconds", ["k"], aggs), "panes", "update", ["pane_end", "k"])
    got = windows_from_panes(kept, ["k"], ["n", "s"], "n", 4, 2)
    text = F.date_format("window_end", "HH:mm:ss")
    assert rows(got, text, "k", "n", "s") == rows(whole, text, "k", "n", "s")


def test_windows_leave_out_dead_keys(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 0), "a"), (dt.datetime(2024, 1, 1, 1, 0, 0), "a")], "ts timestamp_ntz, k string")
    got = windows_from_panes(panes(df, "ts", "2 seconds", ["k"], {"n": F.lit(1)}), ["k"], ["n"], "n", 4, 2)
    assert got.count() == 4


def test_state_is_updated_for_every_key_each_batch(spark, rows):
    """State counts the batches a key has lived through, silent ones included."""
    q = queue(spark, [[("a", 1)], [("a", 1), ("b", 1)], [("b", 1)], []], "k string, v int")
    keyed = KeyedState("k", {"v": "sum"}, lambda old, new: (old or 0) + 1, "bigint")
    table, checkpoint, out = keyed.run(q.stream, "lives", feeds=q.feeds[:3])
    assert rows(table) == [("a", 3), ("b", 2)]
    again, _, _ = keyed.run(q.stream, "lives", checkpoint, out, feeds=q.feeds[3:])  # restart
    assert rows(again) == [("a", 4), ("b", 3)]  # the empty batch visits both


def test_null_state_drops_the_key(spark, rows):
    """A key lives through three batches, then goes; seen again it starts anew."""
    q = queue(spark, [[("a", 1)], [("b", 1)], [("a", 1)], [("b", 1)], [("c", 1)]], "k string, v int")
    keyed = KeyedState("k", {"v": "sum"}, lambda old, new: 3 if new else old - 1 if old > 1 else None, "bigint")
    assert rows(keyed.run(q.stream, "drop", feeds=q.feeds)[0]) == [("a", 1), ("b", 2), ("c", 3)]


def test_restart_goes_on_from_the_checkpoint(spark, rows):
    q = queue(spark, BATCHES[:4], "k string, v int")
    counts = q.stream.groupBy("k").agg(F.sum("v").alias("n"))
    state, out = scratch_path(spark, "state"), scratch_path(spark, "out")
    first = run_to_table(counts, "r", "update", ["k"], state, out, q.feeds[:2])
    assert rows(first) == [("a", 2), ("b", 1)]
    second = run_to_table(counts, "r", "update", ["k"], state, out, q.feeds[2:])
    assert rows(second) == [("a", 4), ("b", 3), ("c", 1)]


def test_idle_key_is_closed(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in range(6)]
    batches = [[("a", t[0]), ("b", t[0])], [("b", t[2])], [("b", t[5])], [("b", t[5])]]
    q = queue(spark, batches, "k string, ts timestamp")
    counts = running_counts_with_timeout(q.stream.withWatermark("ts", "0 seconds"), "k", "ts", 3_600_000)
    out = scratch_path(spark, "idle")
    run_batches(counts, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b={i}"), "idle", "update", feeds=q.feeds)
    closed = spark.read.parquet(out).filter("closed").collect()
    assert ("a", 1) in {(r.k, r.n) for r in closed}


def test_complete_mode_keeps_the_last_table(spark, rows):
    q = queue(spark, BATCHES[:3], "k string, v int")
    assert rows(run_to_table(q.stream.groupBy("k").count(), "complete", "complete", feeds=q.feeds)) == [("a", 3), ("b", 2), ("c", 1)]


def test_constant_rows_for_every_tick(spark):
    q = queue(spark, [[(1,)], [(2,)]], "i int")
    out = run_to_table(constant_stream(q.stream.select("i"), spark.createDataFrame([("x",), ("y",)], "c string")), "constant", feeds=q.feeds)
    assert out.count() == 4


def test_state_reduces_where_rows_are_read(spark, rows):
    """Sum, least and largest per key, over a null key, null values and more rows than one Arrow batch has."""
    data = [(i % 5 or None, float(i), None if i % 5 == 3 else i) for i in range(25_000)]
    q = queue(spark, [data[:20_000], data[20_000:]], "k int, x double, y long")
    keep = lambda old, new: {"x": max(old["x"], new["x"]) if old else new["x"], "y": new["y"]}
    keyed = KeyedState("k", {"x": "max", "y": "min"}, lambda old, new: None if new is None else (*keep(old and old.asDict() if hasattr(old, "asDict") else old, new).values(),), "struct<x: double, y: long>")
    table, _, _ = keyed.run(q.stream, "reduce", feeds=q.feeds)
    want = {(k, max(r[1] for r in data if r[0] == k), min((r[2] for r in data[20_000:] if r[0] == k and r[2] is not None), default=None)) for k in (None, 1, 2, 3, 4)}
    assert {(r.k, r.state.x, r.state.y) for r in table.collect()} == want


def test_without_silent_keys_a_batch_touches_its_own(spark):
    q = queue(spark, [[(str(i), 1) for i in range(50)], [("7", 1)], [("7", 1), ("8", 1)]], "k string, v long")
    for silent, touched in ((False, [50, 1, 2]), (True, [50, 50, 50])):
        again = queue(spark, [[(str(i), 1) for i in range(50)], [("7", 1)], [("7", 1), ("8", 1)]], "k string, v long")
        keyed = KeyedState("k", {"v": "sum"}, lambda old, new: (old or 0) + (new["v"] if new else 0), "bigint", silent)
        table, _, out = keyed.run(again.stream, "own", feeds=again.feeds)
        batches = spark.read.parquet(out).groupBy("__batch").count().orderBy("__batch").collect()
        assert [r["count"] for r in batches if r["count"]] == touched
        assert {(r.k, r.state) for r in table.collect()} >= {("7", 3), ("8", 2), ("9", 1)}
    assert q.feeds


def test_queue_moves_each_batch_once(spark):
    q = queue(spark, [[("a", 1)], [], [("b", 1)]], "k string, v int")
    q.feeds[0]()
    q.feeds[0]()
    q.feeds[1]()
    assert spark.read.schema(q.schema).parquet(f"{q.folder}/*").count() == 1
    q.feeds[2]()
    assert spark.read.schema(q.schema).parquet(f"{q.folder}/*").count() == 2


def test_interval_trigger_runs_a_batch_per_feed(spark):
    """Ticks without new data run nothing; a second query goes on from the checkpoint."""
    q, seen = queue(spark, BATCHES[:5], "k string, v int"), []
    write = lambda b, i: seen.append((i, b.count()))
    checkpoint = run_at_intervals(q.stream, write, "ticks", "200 milliseconds", q.feeds[:3])
    run_at_intervals(q.stream, write, "ticks", "200 milliseconds", q.feeds[3:], checkpoint=checkpoint)
    assert [n for _, n in seen if n] == [1, 2, 3, 2, 1] and len({i for i, _ in seen}) == len(seen)


def state_files(checkpoint, kind):
    """Paths of the files of a kind, by partition folder and version."""
    found = {}
    for folder, _, names in os.walk(f"{checkpoint}/state"):
        for n in names:
            if m := re.match(rf"(\d+)(_[\w-]+)?\.{kind}$", n):
                found[folder, int(m[1])] = os.path.join(folder, n)
    return found


def test_snapshots_come_at_a_cadence_and_the_state_is_rebuilt(spark, rows):
    """Each batch writes its changes, a snapshot comes after two of them; a new query starts from snapshot and later changes."""
    q = queue(spark, BATCHES[:8], "k string, v int")
    state, out = scratch_path(spark, "state"), scratch_path(spark, "out")
    counts = lambda: q.stream.groupBy("k").agg(F.sum("v").alias("n"))

    def feed(i):
        time.sleep(1.5)  # longer than the interval at which snapshots are looked for
        q.feeds[i]()

    with state_on_disk(spark, stateStore__minDeltasForSnapshot="2"):
        run_at_intervals(counts(), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/__batch={i}"), "cadence", "100 milliseconds", [partial(feed, i) for i in range(6)], "update", state)
        snapshots, changes = state_files(state, "zip"), state_files(state, "changelog")
        versions = {v for _, v in snapshots}
        assert len({v for _, v in changes}) >= 6 and versions and len(versions) < 6
        for (folder, version), path in changes.items():
            if version <= max((v for f, v in snapshots if f == folder), default=0):
                os.remove(path)
        table = run_to_table(counts(), "cadence", "update", ["k"], state, out, q.feeds[6:])
    assert rows(table) == sorted(Counter(k for b in BATCHES[:8] for k, _ in b).items())


def test_outer_join_is_closed_by_the_watermark(spark, rows):
    """Every unmatched row comes from the join when the closing rows move the watermark; none comes twice."""
    at = lambda h: dt.datetime(2024, 1, 1, h)
    a = queue(spark, [[(1, 7, at(0)), (2, 8, at(1))], [(3, 7, at(9)), (4, 9, at(23)), (5, 7, at(23))]], "i int, user int, ts timestamp")
    b = queue(spark, [[(10, 7, at(2))], [(11, 8, at(20)), (12, 9, at(22))]], "j int, user int, ts timestamp")
    left, right = Closing(a.stream, "ts", {"user": -1}, "l"), Closing(b.stream, "ts", {"user": -2}, "r")
    window = lambda df: df.withWatermark("ts", "1 hour").withColumn("w", F.window("ts", "6 hours")).drop("ts")
    joined = window(left.stream).join(window(right.stream), ["w", "user"], "left").select("i", "j")
    pairs = [lambda i=i: (a.feeds[i](), b.feeds[i]()) for i in range(2)]
    state, out = scratch_path(spark, "state"), scratch_path(spark, "out")
    before = run_to_table(joined, "outer", checkpoint=state, out=out, feeds=pairs)
    assert (4, 12) in rows(before) and 5 not in {r.i for r in before.collect()}
    ends = [lambda i=i: (left.feeds[i](), right.feeds[i]()) for i in range(2)]
    after = run_to_table(joined, "outer", checkpoint=state, out=out, feeds=ends).filter("i IS NOT NULL")
    assert sorted((r.i, r.j) for r in after.fillna(-1).collect()) == [(1, 10), (2, -1), (3, -1), (4, 12), (5, -1)]


def test_two_streams_advance_together(spark, rows):
    a = queue(spark, [[("a", 1)], [("a", 2)], []], "k string, v int")
    b = queue(spark, [[("a", 5)], [], [("c", 6)]], "k string, w int")
    out = scratch_path(spark, "pairs")
    both = by_side(lambda left, right: left.drop("b").join(right.drop("b"), "k", "full"))
    feeds = [lambda i=i: (a.feeds[i](), b.feeds[i]()) for i in range(3)]
    run_batches(together(a.stream, b.stream), lambda x, i: both(x).withColumn("b", F.lit(i)).write.mode("overwrite").parquet(f"{out}/{i}"), "pairs", feeds=feeds)
    got = sorted((r.k, r.v or 0, r.w or 0) for r in spark.read.parquet(f"{out}/*").collect())
    assert got == [("a", 1, 5), ("a", 2, 0), ("c", 0, 6)]


def test_sketch_estimates_are_bounded_and_merge(spark):
    rng = random.Random(1)
    data = [int(rng.paretovariate(0.7)) % 3000 for _ in range(20_000)]
    sketch = CountMin("k", 0.002, 0.01)
    frames = [spark.createDataFrame([(k,) for k in part], "k long").groupBy("k").agg(F.count("*").alias("n")) for part in (data[:9000], data[9000:])]
    whole = sketch.merged(sketch.of(frames[0]), sketch.of(frames[1]))
    keys = spark.createDataFrame([(k,) for k in range(3500)], "k long")
    got = {r.k: r.estimate for r in sketch.estimates(whole, keys).collect()}
    true = Counter(data)
    assert all(got[k] >= true[k] for k in got)
    assert sum(got[k] > true[k] + 0.002 * len(data) for k in got) <= 0.01 * len(got)
    assert {len(r.cells) for r in whole.collect()} == {sketch.width}
    nothing = spark.createDataFrame([], "r int, cells array<long>")
    assert {r.estimate for r in sketch.estimates(nothing, keys.limit(5)).collect()} == {0}


def test_heavy_hitters_come_from_the_stream(spark):
    """A key that is heavy late, one that is heavy early only, and a stop in between."""
    rng = random.Random(2)
    batches = []
    for i in range(4):
        part = [(rng.randrange(10_000),) for _ in range(2000)] + [(-1,)] * 150 + [(-2,)] * (400 if i == 0 else 0) + [(-3,)] * (500 if i == 3 else 0)
        rng.shuffle(part)
        batches.append(part)
    q = queue(spark, [*batches, [(None,)]], "k long")
    heavy = HeavyHitters("k", 0.05)
    _, checkpoint = heavy.run(q.stream, "heavy", feeds=q.feeds[:2])
    found, _ = HeavyHitters("k", 0.05).run(q.stream, "heavy", checkpoint, q.feeds[2:])
    found = found.collect()
    per_batch = [Counter(k for k, in b) for b in batches]
    whole = sum(per_batch, Counter())
    for number, true in [*enumerate(per_batch), (-1, whole)]:
        n = sum(true.values())
        got = {r.k: r.estimate for r in found if r.batch == number}
        assert set(got) == {k for k, c in true.items() if c >= 0.05 * n}
        assert all(true[k] <= e <= true[k] + heavy.sketch.width and e <= true[k] + 0.005 * n for k, e in got.items())
        assert {r.total for r in found if r.batch == number} == {n}


def model_rows(spark, seed, n=60):
    rng = np.random.default_rng(seed)
    return [(int(seed * n + i), float(x @ [2.0, -1.0] + rng.normal() * 0.1), [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(n, 2)))]


def test_a_stopped_model_reaches_the_same_weights(spark):
    """Stop after two of four batches, start again from the checkpoint; a batch that is repeated changes nothing."""
    train = lambda batch, w: linear.minibatch_sgd(batch, linear.least_squares, linear.plain, w, 0.1, 4)[0]
    batches = [model_rows(spark, s) for s in range(4)]
    schema = "id long, label double, features array<double>"
    straight, stopped = queue(spark, batches, schema), queue(spark, batches, schema)
    one = StreamedModel(spark, np.zeros(2), train)
    one.train_on(straight.stream, feeds=straight.feeds)
    first = StreamedModel(spark, np.zeros(2), train)
    first.train_on(stopped.stream, feeds=stopped.feeds[:2])
    second = StreamedModel(spark, np.zeros(2), train, first.checkpoint)
    second.train_on(stopped.stream, feeds=stopped.feeds[2:])
    assert one.weights()[0] == second.weights()[0] and np.allclose(one.weights()[1], second.weights()[1], atol=1e-12)
    assert np.allclose(second.weights()[1], [2, -1], atol=0.4)
    commits = f"{first.checkpoint}/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{commits}/{name}")
    StreamedModel(spark, np.zeros(2), train, first.checkpoint).train_on(stopped.stream)
    assert np.allclose(one.weights()[1], second.weights()[1], atol=1e-12)


def test_predictions_use_the_weights_of_their_time(spark):
    train = lambda batch, w: w + 1
    q = queue(spark, [model_rows(spark, s, 5) for s in range(3)], "id long, label double, features array<double>")
    other = queue(spark, [model_rows(spark, s, 5) for s in range(3)], "id long, label double, features array<double>")
    model = StreamedModel(spark, np.zeros(2), train)
    feeds = [lambda i=i: ((model.train_on(q.stream, feeds=[q.feeds[i]]) if i else None), other.feeds[i]()) for i in range(3)]
    got = {r.id: r for r in model.predict_on(other.stream, "id", "features", feeds=feeds).collect()}
    assert len(got) == 15
    for s in range(3):
        for i, _, x in model_rows(spark, s, 5):
            assert got[i].prediction == pytest.approx(s * sum(x)) and (got[i].version >= 0) == (s > 0)


def test_a_push_source_goes_on_after_a_stop(spark, rows):
    """Five batches, a stop, and the rest: each record once, and what is done is deleted from the inbox."""
    folder, state, out = (scratch_path(spark, s) for s in ("inbox", "state", "out"))
    pieces = [spark.range(10 * i, 10 * i + 10, 1, 3).selectExpr("id", "'x' AS kind") for i in range(8)]
    feeds = [partial(deliver, p, folder) for p in pieces]
    schema = "id bigint, kind string"
    run_to_table(inbox_stream(spark, folder, schema), "push", checkpoint=state, out=out, feeds=feeds[:5])
    for feed in feeds[5:]:
        feed()  # delivered while no query runs
    table = run_to_table(inbox_stream(spark, folder, schema), "push", checkpoint=state, out=out)
    assert rows(table, "id") == [(i,) for i in range(80)]
    sizes = [r["count"] for r in spark.read.parquet(out).groupBy("__batch").count().orderBy("__batch").collect()]
    assert sizes[:5] == [10] * 5 and sum(sizes) == 80
    assert len(Inbox(folder).numbers()) < 8 and Inbox(folder).delivered == 8


def test_a_push_source_begins_where_it_is_told(spark, rows):
    folder = scratch_path(spark, "inbox")
    for i in range(4):
        deliver(spark.range(i, i + 1), folder)
    deliver(spark.range(0), folder)
    late = run_to_table(inbox_stream(spark, folder, "id bigint", **{"from": "2", "keep": "true"}), "late")
    assert rows(late) == [(2,), (3,)] and Inbox(folder).numbers() == [0, 1, 2, 3, 4]
    assert rows(run_to_table(inbox_stream(spark, folder, "id bigint"), "all")) == [(0,), (1,), (2,), (3,)]


def test_half_a_delivery_is_none(spark, rows):
    """Files without a manifest, as a lost producer leaves them, are not read."""
    folder = scratch_path(spark, "inbox")
    import pyarrow as pa

    list(Inbox(folder).write([pa.record_batch({"id": [99]})]))
    deliver(spark.range(3), folder)
    assert rows(run_to_table(inbox_stream(spark, folder, "id bigint"), "half")) == [(0,), (1,), (2,)]
