"""Streaming jobs; each replays the events (or texts) to the end and returns the result table."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators.grouping import cogroup, group_lists
from brindle.operators.relational import union_all_of
from brindle.registry import query
from brindle.session import scratch_path
from brindle.streaming.replay import file_stream, run_at_intervals, run_batches, run_to_table, state_on_disk
from brindle.streaming.sketch import HeavyHitters
from brindle.streaming.sources import BatchQueue, Closing, by_side, constant_stream, together
from brindle.streaming.state import KeyedState, running_counts_with_timeout
from brindle.streaming.windows import panes, utc_instant, windowed, windows_from_panes

_END = "strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end"


def _n():
    return F.count("*").alias("n")


def _events(t, *cols):
    stream = file_stream(t.spark, t.path("events"))
    return stream.select(*cols) if cols else stream


def _end(df):
    return df.withColumn("window_end", F.date_format("window_end", "yyyy-MM-dd HH:mm:ss"))


def _queue(t, cols, parts=4, table="events", key="event_id"):
    """Rows of consecutive quarters of the id range as a queue of batches."""
    rows = getattr(t, table).select(*cols)
    top = rows.agg((F.max(key) + 1).alias("top")).first()["top"]
    return BatchQueue(rows, F.floor(F.col(key) * parts / top), parts, "queue")


_BATCHES = "floor(event_id * 4 / (SELECT MAX(event_id) + 1 FROM events))::INTEGER"
_ORDER_BATCHES = "floor(o_orderkey * 4 / (SELECT MAX(o_orderkey) + 1 FROM orders))::INTEGER"


def _sliding_sql(select, group, size="6 HOUR", slide_s=7200):
    """Windows that end at multiples of the slide and hold each event size/slide times."""
    hours = int(size.split()[0])
    return f"""SELECT {_END}, {select} FROM (SELECT *, make_timestamp((floor(epoch(ts) / {slide_s}) + 1 + i)::BIGINT * {slide_s} * 1000000)
        AS window_end FROM events, range({hours * 3600 // slide_s}) r(i)) x GROUP BY window_end{group}"""


# --- sources ----------------------------------------------------------------------------------


@query("n3_file_source", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1")
def n3(t):
    stream = file_stream(t.spark, t.path("events"), pathGlobFilter="*.parquet").select("event_type")
    return run_to_table(stream, "files").groupBy("event_type").agg(_n())


@query("n4_text_file_source", "SELECT p_name AS line FROM part")
def n4(t):
    folder = scratch_path(t.spark, "lines")
    t.part.select("p_name").write.text(folder)
    return run_to_table(t.spark.readStream.text(folder), "text").withColumnRenamed("value", "line")


@query("n5_queue_of_batches", f"SELECT {_BATCHES} AS batch, COUNT(*) AS n FROM events GROUP BY 1")
def n5(t):
    return _per_batch(t, ["event_id"], lambda b: b.agg(_n()), "queue")


@query("n6_constant_source", "SELECT event_id, r_name FROM events CROSS JOIN region")
def n6(t):
    ticks = _events(t).select("event_id")
    return run_to_table(constant_stream(ticks, t.region.select("r_name")), "constant")


# --- record-wise ------------------------------------------------------------------------------


@query("n7_union", "SELECT event_id AS id FROM events UNION ALL SELECT o_orderkey FROM orders")
def n7(t):
    orders = file_stream(t.spark, t.path("orders")).select(F.col("o_orderkey").alias("id"))
    return run_to_table(_events(t).select(F.col("event_id").alias("id")).union(orders), "union")


@query("n8_map", "SELECT event_id, round(value * 100, 3) AS cents FROM events")
def n8(t):
    return run_to_table(_events(t).select("event_id", F.round(F.col("value") * 100, 3).alias("cents")), "map")


@query("n9_flat_map", "SELECT event_id, unnest([event_type, upper(event_type)]) AS w FROM events")
def n9(t):
    return run_to_table(_events(t).select("event_id", F.explode(F.array("event_type", F.upper("event_type"))).alias("w")), "flatmap")


@query("n10_filter", "SELECT event_id FROM events WHERE value > 100 AND event_type <> 'error'")
def n10(t):
    return run_to_table(_events(t).filter("value > 100 AND event_type <> 'error'").select("event_id"), "filter")


@query("n11_glom", "SELECT COUNT(*) AS n FROM events")
def n11(t):
    """One array of ids per partition and batch, built inside the partition."""
    import pandas as pd

    def one_array(batches):
        ids = [b.event_id for b in batches]
        if ids:
            yield pd.DataFrame({"ids": [pd.concat(ids).to_numpy()]})

    arrays = run_to_table(_events(t, "event_id").mapInPandas(one_array, "ids array<long>"), "glom")
    return arrays.agg(F.sum(F.size("ids")).alias("n"))


@query("n12_map_partitions", "SELECT event_id, user_id * 2 AS v FROM events")
def n12(t):
    def double(batches):
        for b in batches:
            yield b.assign(v=b.user_id * 2)[["event_id", "v"]]

    return run_to_table(_events(t, "event_id", "user_id").mapInPandas(double, "event_id long, v long"), "partitions")


@query("n13_repartition", "SELECT COUNT(*) AS n FROM events")
def n13(t):
    return run_to_table(_events(t, "event_id").repartition(6), "repartition").agg(_n())


# --- per batch and whole-stream aggregates ---------------------------------------------------------


def _per_batch(t, cols, fn, label):
    """Result of a batch function for every micro-batch, tagged with the batch number."""
    out = scratch_path(t.spark, label)

    def write(batch, i):
        fn(batch).withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/b={i}")

    queue = _queue(t, cols)
    run_batches(queue.stream, write, label, feeds=queue.feeds)
    return t.spark.read.parquet(out).drop("b")


def _per_pair_of_batches(t, left, right, combine, label):
    """Result of ``combine(left batch, right batch)`` for streams over events and orders that advance together."""
    out = scratch_path(t.spark, label)
    sides = _queue(t, left), _queue(t, right, table="orders", key="o_orderkey")

    def write(batch, i):
        by_side(combine)(batch).withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/b={i}")

    def feed(i):
        for side in sides:
            side.feeds[i]()

    run_batches(together(*[q.stream for q in sides]), write, label, feeds=[lambda i=i: feed(i) for i in range(4)])
    return t.spark.read.parquet(out).drop("b")


@query("n14_batch_reduce", f"SELECT {_BATCHES} AS batch, MAX(value) AS top FROM events GROUP BY 1")
def n14(t):
    return _per_batch(t, ["event_id", "value"], lambda b: b.agg(F.max("value").alias("top")), "reduce").filter("top IS NOT NULL")


@query("n15_batch_count", f"SELECT {_BATCHES} AS batch, COUNT(*) AS n FROM events GROUP BY 1")
def n15(t):
    return _per_batch(t, ["event_id"], lambda b: b.agg(_n()), "count").filter("n > 0")


@query("n16_batch_count_by_value", f"SELECT {_BATCHES} AS batch, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def n16(t):
    return _per_batch(t, ["event_id", "event_type"], lambda b: b.groupBy("event_type").agg(_n()), "values")


@query("n17_transform", "SELECT user_id, COUNT(*) AS n FROM events WHERE value > 50 GROUP BY 1")
def n17(t):
    def busy(df):
        return df.filter("value > 50").groupBy("user_id").agg(_n())

    return run_to_table(_events(t, "user_id", "value").transform(busy), "transform", "update", ["user_id"])


@query(
    "n18_transform_with",
    f"""SELECT batch, user_id, kinds, last FROM
        (SELECT {_BATCHES} AS batch, user_id, COUNT(DISTINCT event_type) AS kinds FROM events GROUP BY 1, 2) e
        JOIN (SELECT {_ORDER_BATCHES} AS batch, o_custkey AS user_id, MAX(o_orderkey) AS last FROM orders GROUP BY 1, 2) o USING (batch, user_id)""",
)
def n18(t):
    """Batches of two streams, events and orders, combined by a batch function."""

    def combine(events, orders):
        kinds = events.select("user_id", "event_type").distinct().groupBy("user_id").agg(F.count("*").alias("kinds"))
        return kinds.join(orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderkey").alias("last")), "user_id")

    return _per_pair_of_batches(t, ["event_id", "user_id", "event_type"], ["o_orderkey", "o_custkey"], combine, "with")


@query("n19_transform_many", """SELECT kind, COUNT(*) AS n FROM (SELECT event_type AS kind FROM events
    UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT c_mktsegment FROM customer) GROUP BY 1""")
def n19(t):
    """Any number of streams into one: the kinds of three whole tables."""

    def merge(streams):
        return union_all_of(streams).groupBy("kind").agg(_n())

    kinds = {"events": "event_type", "orders": "o_orderpriority", "customer": "c_mktsegment"}
    streams = [file_stream(t.spark, t.path(table)).select(F.col(c).alias("kind")) for table, c in kinds.items()]
    return run_to_table(merge(streams), "many", "update", ["kind"])


@query("n20_foreach_batch_sink", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1")
def n20(t):
    out = scratch_path(t.spark, "sink")
    run_batches(_events(t, "event_type"), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b={i}"), "foreach")
    return t.spark.read.parquet(out).groupBy("event_type").agg(_n())


@query("n21_print_first_ten", "SELECT event_id FROM events ORDER BY event_id LIMIT 10")
def n21(t):
    """The ten rows a console would print, written instead of printed."""
    out = scratch_path(t.spark, "print")
    run_batches(_events(t, "event_id"), lambda b, i: b.orderBy("event_id").limit(10).write.mode("overwrite").parquet(f"{out}/b={i}"), "print")
    return t.spark.read.parquet(out).select("event_id").orderBy("event_id").limit(10)


@query("n22_save_text_files", "SELECT event_type AS line, COUNT(*) AS n FROM events GROUP BY 1")
def n22(t):
    out = scratch_path(t.spark, "text-out")
    running = (
        _events(t).select(F.col("event_type").alias("value")).writeStream.format("text").trigger(availableNow=True)
        .option("checkpointLocation", scratch_path(t.spark, "text-state")).start(out)
    )
    running.awaitTermination()
    return t.spark.read.text(out).groupBy(F.col("value").alias("line")).agg(_n())


@query("n23_save_key_value_files", "SELECT event_id AS k, event_type AS v FROM events")
def n23(t):
    from brindle.sources.files import read_sequence, write_sequence

    out = scratch_path(t.spark, "seq-out")
    run_batches(_events(t, "event_id", "event_type"), lambda b, i: write_sequence(b, f"{out}/b{i}"), "sequence")
    return read_sequence(t.spark, f"{out}/b*", "k long, v string")


# --- windows ----------------------------------------------------------------------------------


def _windows(t, label, keys, aggs, size="6 hours", slide="2 hours"):
    stream = windowed(_events(t), "ts", size, slide, keys, aggs)
    return _end(run_to_table(stream, label, "update", ["window_end", *keys]))


@query("n24_sliding_window", _sliding_sql("COUNT(*) AS n, MIN(value) AS low", ""))
def n24(t):
    return _windows(t, "window", [], [_n(), F.min("value").alias("low")])


@query("n25_reduce_by_window", _sliding_sql("MAX(value) AS top", ""))
def n25(t):
    return _windows(t, "reduce-window", [], [F.max("value").alias("top")])


def _incremental(t, label, keys, sums):
    """Panes kept up by the stream; windows by adding entering and subtracting leaving panes."""
    stream = panes(_events(t), "ts", "2 hours", keys, sums)
    kept = run_to_table(stream, label, "update", ["pane_end", *keys])
    return _end(windows_from_panes(kept, keys, list(sums), "n", 6 * 3600, 2 * 3600))


@query("n26_reduce_by_window_inverse", _sliding_sql("COUNT(*) AS n, SUM(user_id)::BIGINT AS users", ""))
def n26(t):
    return _incremental(t, "inverse", [], {"n": F.lit(1), "users": F.col("user_id")})


@query("n27_count_by_window", _sliding_sql("COUNT(*) AS n", "", "3 HOUR", 3600))
def n27(t):
    return _windows(t, "count-window", [], [_n()], "3 hours", "1 hour")


@query("n28_count_by_value_and_window", _sliding_sql("event_type, COUNT(*) AS n", ", event_type"))
def n28(t):
    return _windows(t, "value-window", ["event_type"], [_n()])


@query("n29_time_slice", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 12:00:00'")
def n29(t):
    rows = run_to_table(_events(t, "event_id", "ts"), "slice")
    return rows.filter("ts >= timestamp_ntz'2024-01-05 00:00:00' AND ts < timestamp_ntz'2024-01-06 12:00:00'").select("event_id")


@query("n30_reduce_by_key_per_batch", f"SELECT {_BATCHES} AS batch, user_id, MAX(value) AS top, COUNT(*) AS n FROM events GROUP BY 1, 2")
def n30(t):
    return _per_batch(
        t, ["event_id", "user_id", "value"], lambda b: b.groupBy("user_id").agg(F.max("value").alias("top"), _n()), "by-key"
    )


@query(
    "n31_group_by_key_and_window",
    _sliding_sql("event_type, 0 AS chunk, string_agg(DISTINCT user_id, ',' ORDER BY user_id) AS users", ", event_type", "6 HOUR", 21600),
)
def n31(t):
    """The stream keeps one row per (window, key, value); the lists are made, in chunks, from its table."""
    rows = _windows(t, "group-window", ["event_type", "user_id"], [_n()], "6 hours", None)
    lists = group_lists(rows, ["window_end", "event_type"], F.col("user_id"), "users")
    return lists.withColumn("users", F.array_join(F.transform("users", lambda u: u.cast("string")), ","))


@query("n32_reduce_by_key_and_window", _sliding_sql("user_id, MAX(value) AS top", ", user_id"))
def n32(t):
    return _windows(t, "key-window", ["user_id"], [F.max("value").alias("top")])


@query("n33_reduce_by_key_and_window_incremental", _sliding_sql("user_id, COUNT(*) AS n, SUM(event_id)::BIGINT AS ids", ", user_id"))
def n33(t):
    return _incremental(t, "incremental", ["user_id"], {"n": F.lit(1), "ids": F.col("event_id")})


# --- state -------------------------------------------------------------------------------------


_KEYED = f"""WITH c AS (SELECT floor(value * 10)::BIGINT AS k, {_BATCHES} AS batch, COUNT(*) AS n FROM events GROUP BY 1, 2)"""


def _keyed_queue(t):
    queue = _queue(t, ["event_id", "value"])
    return queue.stream.select(F.floor(F.col("value") * 10).alias("k"), F.lit(1).cast("long").alias("n")), queue.feeds


@query(
    "n34_update_state_by_key",
    f"{_KEYED} SELECT k, (SUM(n) - 2 * (4 - MIN(batch) - COUNT(*)))::BIGINT AS state FROM c GROUP BY k",
)
def n34(t):
    """Count per key that loses two in every batch in which the key stays silent: each key is visited each batch."""

    def update(old, new):
        return old - 2 if new is None else (old or 0) + new["n"]

    stream, feeds = _keyed_queue(t)
    return KeyedState("k", {"n": "sum"}, update, "bigint").run(stream, "state", feeds=feeds)[0]


@query(
    "n35_update_state_drop_keys",
    f"""{_KEYED}, gaps AS (SELECT k, MAX(i) AS gap FROM (SELECT DISTINCT k FROM c) x, range(4) r(i)
        WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.k = x.k AND c.batch = i) GROUP BY k)
        SELECT c.k, SUM(n)::BIGINT AS state FROM c LEFT JOIN gaps USING (k) WHERE batch > coalesce(gap, -1) GROUP BY c.k""",
)
def n35(t):
    """No value drops the key: silence in a batch forgets it, so it starts again from nothing."""

    def update(old, new):
        return None if new is None else (old or 0) + new["n"]

    stream, feeds = _keyed_queue(t)
    return KeyedState("k", {"n": "sum"}, update, "bigint").run(stream, "drop", feeds=feeds)[0]


@query("n34_state_store_with_timeout", "SELECT user_id, COUNT(*) AS n FROM events GROUP BY 1")
def n34_store(t):
    stream = _events(t, "user_id", utc_instant(F.col("ts")).alias("ts")).withWatermark("ts", "1 hour")
    stream = running_counts_with_timeout(stream, "user_id", "ts", 400 * 86_400_000)
    return run_to_table(stream, "store", "update", ["user_id"]).select("user_id", "n")


@query("n36_map_values", "SELECT user_id, round(value + 1, 3) AS v FROM events UNION ALL SELECT user_id, round(value * 2, 3) FROM events")
def n36(t):
    values = F.explode(F.array(F.round(F.col("value") + 1, 3), F.round(F.col("value") * 2, 3)))
    return run_to_table(_events(t).select("user_id", values.alias("v")), "values")


@query(
    "n37_cogroup_streams",
    f"""SELECT batch, user_id, 0::BIGINT AS chunk, coalesce(kinds, '') AS kinds, coalesce(ids, '') AS ids FROM
        (SELECT {_BATCHES} AS batch, user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1, 2) e
        FULL JOIN (SELECT {_ORDER_BATCHES} AS batch, o_custkey AS user_id, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS ids
        FROM orders GROUP BY 1, 2) o USING (batch, user_id)""",
)
def n37(t):
    """Batches of two streams grouped together: the values of either side per user, users of one side included."""

    def both(events, orders):
        ids = orders.withColumnRenamed("o_custkey", "user_id")
        lists = cogroup("user_id", {"kinds": (events, F.col("event_type")), "ids": (ids, F.col("o_orderkey"))})
        return lists.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("kinds", "ids")})

    return _per_pair_of_batches(t, ["event_id", "user_id", "event_type"], ["o_orderkey", "o_custkey"], both, "cogroup")


_ORDER_TIME = "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, cast(o_orderkey % 720 AS int))"


def _in_windows(df):
    """Rows of a stream by user and six-hour window, late by an hour at most."""
    return df.withWatermark("ts", "1 hour").withColumn("w", F.window("ts", "6 hours")).drop("ts")


def _event_side(t):
    return _events(t).select("event_id", "user_id", utc_instant(F.col("ts")).alias("ts"))


def _order_side(t):
    """Orders replayed on the clock of the events, one of 720 hours each."""
    orders = file_stream(t.spark, t.path("orders"))
    return orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.expr(_ORDER_TIME).alias("ts"))


_TWO_SIDES = """(SELECT event_id, user_id, floor(epoch(ts) / 21600)::BIGINT AS w FROM events) e {0} JOIN
    (SELECT o_orderkey AS order_id, o_custkey AS user_id, floor(epoch(TIMESTAMP '2024-01-01' + to_hours(o_orderkey % 720)) / 21600)::BIGINT AS w
     FROM orders) o USING (user_id, w)"""


@query("n38_stream_stream_join", f"SELECT event_id, order_id FROM {_TWO_SIDES.format('')}")
def n38(t):
    joined = _in_windows(_event_side(t)).join(_in_windows(_order_side(t)), ["w", "user_id"])
    return run_to_table(joined.select("event_id", "order_id"), "join")


@query("n39_stream_outer_join", f"SELECT event_id, coalesce(order_id, -1) AS order_id FROM {_TWO_SIDES.format('LEFT')}")
def n39(t):
    """Left join of two streams; the engine gives out an unmatched row when the watermark passes its window.

    Two closing batches at the end of both streams move the watermark past the
    windows that are still open, so every row comes from the join itself.
    """
    left = Closing(_event_side(t), "ts", {"user_id": -1}, "close-events")
    right = Closing(_order_side(t), "ts", {"user_id": -2}, "close-orders")
    joined = _in_windows(left.stream).join(_in_windows(right.stream), ["w", "user_id"], "left").select("event_id", "order_id")

    def close(i):
        left.feeds[i]()
        right.feeds[i]()

    done = run_to_table(joined, "outer", feeds=[lambda: None, lambda: close(0), lambda: close(1)])
    return done.filter("event_id IS NOT NULL").fillna(-1, ["order_id"])


@query("n40_stream_static_join", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def n40(t):
    joined = _events(t).select("event_id", "user_id").join(t.customer, F.expr("user_id = c_custkey")).select("event_id", "c_mktsegment")
    return run_to_table(joined, "static")


# --- recovery, triggers, models -------------------------------------------------------------------


@query("n41_checkpoint_recovery", "SELECT user_id, COUNT(*) AS n FROM events GROUP BY 1")
def n41(t):
    """Half of the files, a stop, then the rest from the same checkpoint: counts go on."""
    half = t.events.agg((F.max("event_id") / 2).alias("h")).first()["h"]
    folder, state, out = (scratch_path(t.spark, s) for s in ("recover", "recover-state", "recover-out"))
    for rows in (t.events.filter(F.col("event_id") <= half), t.events.filter(F.col("event_id") > half)):
        rows.write.mode("append").parquet(folder)
        counts = file_stream(t.spark, folder, schema=t.events.schema).groupBy("user_id").agg(_n())
        table = run_to_table(counts, "recover", "update", ["user_id"], state, out)
    return table


@query("n42_trigger_interval", f"SELECT {_BATCHES} AS batch, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def n42(t):
    """A query that stays up and looks for new data every half second, while four batches come in."""
    queue, out = _queue(t, ["event_id", "event_type"]), scratch_path(t.spark, "trigger")

    def write(batch, i):
        batch.groupBy("event_type").agg(_n()).withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/b={i}")

    run_at_intervals(queue.stream, write, "trigger", "500 milliseconds", queue.feeds)
    return t.spark.read.parquet(out).drop("b")


@query("n48_checkpoint_location", "SELECT user_id, COUNT(*) AS n, SUM(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def n48(t):
    """Changes of the state go to the checkpoint in every batch, a whole snapshot from two changes on; a new query goes on from them."""
    queue = _queue(t, ["event_id", "user_id"], 6)
    state, out = scratch_path(t.spark, "cadence-state"), scratch_path(t.spark, "cadence-out")
    with state_on_disk(t.spark, stateStore__minDeltasForSnapshot="2"):
        for feeds in (queue.feeds[:4], queue.feeds[4:]):
            counts = queue.stream.groupBy("user_id").agg(_n(), F.sum("event_id").alias("ids"))
            table = run_to_table(counts, "cadence", "update", ["user_id"], state, out, feeds)
    return table


@query("n49_transform_with_batch_time", f"SELECT {_BATCHES} AS batch, COUNT(*) AS n FROM events WHERE value > 10 GROUP BY 1")
def n49(t):
    return _per_batch(t, ["event_id", "value"], lambda b: b.filter("value > 10").agg(_n()), "timed").filter("n > 0")


@query(
    "n44_page_view_metrics",
    _sliding_sql(
        "event_type, COUNT(*) AS n, SUM((value > 100)::INTEGER)::BIGINT AS high, round(SUM((value > 100)::INTEGER) / COUNT(*), 9) AS rate",
        ", event_type",
    ),
)
def n44(t):
    high = F.sum((F.col("value") > 100).cast("int"))
    return _windows(t, "metrics", ["event_type"], [_n(), high.alias("high"), F.round(high / F.count("*"), 9).alias("rate")])


@query(
    "n45_popular_tags",
    f"""SELECT * FROM ({_sliding_sql('user_id, COUNT(*) AS n', ', user_id', '6 HOUR', 21600)}) x
        QUALIFY row_number() OVER (PARTITION BY window_end ORDER BY n DESC, user_id) <= 3""",
)
def n45(t):
    """Top three per window; the rank limit is applied before the shuffle, so a window of many users stays small."""
    counts = _windows(t, "tags", ["user_id"], [_n()], "6 hours", None)
    place = F.row_number().over(Window.partitionBy("window_end").orderBy(F.desc("n"), "user_id"))
    return counts.withColumn("place", place).filter("place <= 3").drop("place")


@query("n46_heavy_hitters")
def n46(t):
    """Users with a hundredth of the rows or more, per batch and (batch -1) of the whole stream, from merged sketches."""
    queue = _queue(t, ["event_id", "user_id"])
    return HeavyHitters("user_id", 0.01).run(queue.stream, "heavy", feeds=queue.feeds)[0]


@query("n47_approximate_distinct_users")
def n47(t):
    """Sketch per batch, merged for the whole stream."""
    sketches = _per_batch(t, ["event_id", "user_id"], lambda b: b.agg(F.hll_sketch_agg("user_id").alias("s"), _n()), "hll")
    sketches = sketches.filter("n > 0")
    overall = sketches.agg(F.lit(-1).alias("batch"), F.hll_sketch_estimate(F.hll_union_agg("s")).alias("users"))
    return sketches.select("batch", F.hll_sketch_estimate("s").alias("users")).unionAll(overall)


# --- jobs ----------------------------------------------------------------------------------------


def _words(df, col):
    return df.select(F.explode(F.split(F.lower(col), r"\s+")).alias("word")).filter("word <> ''")


_WC = r"""SELECT word, COUNT(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower({1}), '\s+')) AS word FROM {0}) x
          WHERE word <> '' GROUP BY 1"""


@query("n52_word_count", _WC.format("part", "p_name"))
def n52(t):
    stream = file_stream(t.spark, t.path("part")).select("p_name")
    return run_to_table(_words(stream, "p_name").groupBy("word").agg(_n()), "words", "update", ["word"])


@query("n53_running_word_count", _WC.format("part", "p_name"))
def n53(t):
    """Complete mode: every batch gives the whole table so far; the vocabulary is small."""
    stream = file_stream(t.spark, t.path("part")).select("p_name")
    return run_to_table(_words(stream, "p_name").groupBy("word").agg(_n()), "running", "complete")


@query("n55_word_count_of_new_files", _WC.format("customer", "c_mktsegment"))
def n55(t):
    folder = scratch_path(t.spark, "new-files")
    t.customer.select("c_mktsegment").write.text(folder)
    counts = _words(t.spark.readStream.text(folder), "value").groupBy("word").agg(_n())
    return run_to_table(counts, "new", "update", ["word"])


@query("n56_queue_mod_ten", "SELECT event_id % 10 AS k, COUNT(*) AS n FROM events GROUP BY 1")
def n56(t):
    queue = _queue(t, ["event_id"])
    counts = queue.stream.groupBy((F.col("event_id") % 10).alias("k")).agg(_n())
    return run_to_table(counts, "mod", "update", ["k"], feeds=queue.feeds)


@query("n54_recoverable_word_count", _WC.format("part", "p_name"))
def n54(t):
    """Words of half of the parts, a stop, then the rest from the same checkpoint: the counts go on."""
    half = t.part.agg((F.max("p_partkey") / 2).alias("h")).first()["h"]
    queue = BatchQueue(t.part.select("p_name", "p_partkey"), (F.col("p_partkey") > half).cast("int"), 2, "words")
    state, out = scratch_path(t.spark, "words-state"), scratch_path(t.spark, "words-out")
    for feed in queue.feeds:
        counts = _words(queue.stream, "p_name").groupBy("word").agg(_n())
        table = run_to_table(counts, "words", "update", ["word"], state, out, [feed])
    return table
