"""Sources and sinks: every query writes or reads rows of the given tables."""

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.registry import query
from brindle.session import cut_lineage, scratch_path
from brindle.sources import files, text
from brindle.sources.json import merge_types, null_types_to_string, parse_json_column



def _table_name(label):
    return f"{label}_{uuid.uuid4().hex[:12]}"


def _save_table(df, t, label, **parts):
    """External catalog table in the shared scratch folder."""
    name = _table_name(label)
    writer = df.write.option("path", scratch_path(t.spark, label)).format("parquet")
    if parts.get("by"):
        writer = writer.partitionBy(*parts["by"])
    writer.saveAsTable(name)
    return name


def _regions(t):
    """The region table, of fixed size in this schema, as local rows: the feature is a local collection."""
    return [tuple(r) for r in t.region.toLocalIterator()]


@query("a1_local_collection", "SELECT r_regionkey AS k, r_name AS v, n FROM region JOIN (SELECT n_regionkey, COUNT(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) ON n_regionkey = r_regionkey")
def a1(t):
    local = t.spark.createDataFrame(_regions(t), "k int, v string").repartition(3)
    counts = t.customer.join(t.nation, F.expr("c_nationkey = n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return local.join(counts, F.expr("k = n_regionkey")).select("k", "v", "n")


@query("a2_generated_rows", "SELECT i AS id, i * i % 97 AS v FROM (SELECT unnest(range(0, (SELECT COUNT(*) FROM orders))) AS i) x")
def a2(t):
    """One generated row per order."""
    return t.spark.range(t.orders.count()).select("id", (F.col("id") * F.col("id") % 97).alias("v"))


@query("a3_empty_dataset", "SELECT o_orderkey AS k FROM orders")
def a3(t):
    return t.spark.createDataFrame([], "k long").unionAll(t.orders.select("o_orderkey"))


def _part_lines(t, label):
    path = scratch_path(t.spark, label)
    t.part.select(F.concat_ws("|", "p_partkey", "p_name", "p_size").alias("value")).write.text(path)
    return path


@query("a4_text_lines", "SELECT concat_ws('|', p_partkey, p_name, p_size) AS line FROM part")
def a4(t):
    return text.read_lines(t.spark, _part_lines(t, "lines") + "/*.txt").select(F.col("value").alias("line"))


@query("a5_whole_text_files", "SELECT COUNT(*) AS lines FROM part")
def a5(t):
    whole = text.read_whole_files(t.spark, _part_lines(t, "whole"))
    lines = F.size(F.filter(F.split("content", "\n"), lambda s: s != ""))
    return whole.filter(F.col("path").contains("part-")).agg(F.sum(lines).alias("lines"))


def _hadoop_lines(t, old):
    fmt = files.OLD_TEXT_INPUT if old else files.NEW_TEXT_INPUT
    rows = files.read_key_value(
        t.spark, _part_lines(t, "hadoop"), fmt, files.LONG_KEY, files.TEXT_VALUE, "at long, line string", old_api=old
    )
    return rows.select("line")


_LINES = "SELECT concat_ws('|', p_partkey, p_name, p_size) AS line FROM part"
query("a6_hadoop_input_old_api", _LINES)(lambda t: _hadoop_lines(t, True))
query("a8_hadoop_input_new_api", _LINES)(lambda t: _hadoop_lines(t, False))


@query("a7_hadoop_file_by_format_name", _LINES)
def a7(t):
    """A reader chosen by format name, the everyday form of the class-tag call."""
    return t.spark.read.format("text").load(_part_lines(t, "byname")).select(F.col("value").alias("line"))


def _pairs(t):
    return t.part.select("p_partkey", "p_name")


_PAIRS = "SELECT p_partkey AS k, p_name AS v FROM part"


@query("a9_sequence_file_source", _PAIRS)
def a9(t):
    path = scratch_path(t.spark, "seq")
    files.write_sequence(_pairs(t), path)
    return files.read_sequence(t.spark, path, "k long, v string")


@query("a10_object_file_source", _PAIRS)
def a10(t):
    path = scratch_path(t.spark, "objects")
    files.write_objects(_pairs(t), path)
    return files.read_objects(t.spark, path, "k long, v string")


@query("a12_parquet_source", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def a12(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(
    "a12_parquet_nested",
    "SELECT o_orderkey AS id, o_orderstatus AS status, upper(o_orderpriority) AS first_tag FROM orders",
)
def a12_nested(t):
    path = scratch_path(t.spark, "nested")
    nested = t.orders.select(
        F.struct("o_orderkey", F.struct("o_orderstatus").alias("state")).alias("o"),
        F.array(F.upper("o_orderpriority"), F.lit("x")).alias("tags"),
        F.create_map(F.lit("price"), F.col("o_totalprice")).alias("m"),
    )
    nested.write.parquet(path)
    back = t.spark.read.parquet(path)
    return back.select(F.col("o.o_orderkey").alias("id"), F.col("o.state.o_orderstatus").alias("status"), F.col("tags")[0].alias("first_tag"))


@query("a13_parquet_projection_pushdown", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_discount < 0.03")
def a13(t):
    return t.lineitem.filter("l_quantity >= 49 AND l_discount < 0.03").select("l_orderkey", "l_quantity")


@query("a14_parquet_binary_as_string", "SELECT p_name AS v, COUNT(*) AS n FROM part GROUP BY 1")
def a14(t):
    """Text stored as plain binary columns, read back as strings by a declared schema."""
    path = scratch_path(t.spark, "binary")
    t.part.select(F.col("p_name").cast("binary").alias("v")).write.parquet(path)
    rows = t.spark.read.parquet(path).select(F.col("v").cast("string").alias("v"))
    return rows.groupBy("v").agg(F.count("*").alias("n"))


def _json_orders(t):
    path = scratch_path(t.spark, "json")
    t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", F.struct("o_custkey").alias("who")).write.json(path)
    return path


_JSON = "SELECT o_orderkey, o_totalprice, o_orderstatus, o_custkey FROM orders"


@query("a15_json_lines_inferred", _JSON)
def a15(t):
    return t.spark.read.json(_json_orders(t)).select("o_orderkey", "o_totalprice", "o_orderstatus", "who.o_custkey")


@query("a16_json_with_schema", "SELECT o_orderkey, o_orderstatus, 'absent' AS missing FROM orders")
def a16(t):
    rows = t.spark.read.schema("o_orderkey long, o_orderstatus string, missing string").json(_json_orders(t))
    return rows.fillna("absent", ["missing"])


@query("a17_json_sampled_inference", _JSON)
def a17(t):
    rows = t.spark.read.option("samplingRatio", 0.5).json(_json_orders(t))
    return rows.select("o_orderkey", "o_totalprice", "o_orderstatus", "who.o_custkey")


@query("a18_json_strings", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, COUNT(*) AS n FROM events GROUP BY 1")
def a18(t):
    return parse_json_column(t.events, "props").groupBy("k").agg(F.count("*").alias("n"))


def _shapes(t):
    """Records of several shapes, made from orders."""
    path = scratch_path(t.spark, "shapes")
    k = F.col("o_orderkey")
    body = (
        F.when(k % 3 == 0, F.format_string('{"a": %d, "b": {"c": 1.5}}', k))
        .when(k % 3 == 1, F.format_string('{"a": %d, "b": {"d": "x"}, "e": null}', k + 5000000000))
        .otherwise(F.lit('{"f": [1, 2], "g": true}'))
    )
    t.orders.select(body.alias("value")).write.text(path)
    return path


@query(
    "a19_json_schema_inference",
    "SELECT * FROM (VALUES ('a', 'bigint'), ('b', 'struct<c:double,d:string>'), ('e', 'string'), ('f', 'array<bigint>'), ('g', 'boolean')) v(field, kind)",
)
def a19(t):
    schema = null_types_to_string(t.spark.read.json(_shapes(t)).schema)
    return t.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema], "field string, kind string")


@query("a20_json_type_conflict", "SELECT 'struct<a:bigint,b:struct<c:double,d:string>,x:string>' AS kind")
def a20(t):
    shapes = t.spark.read.json(_shapes(t)).select("a", "b").schema
    other = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("x", T.StringType())])
    return t.spark.createDataFrame([(merge_types(shapes, other).simpleString(),)], "kind string")


@query("a21_json_all_null_is_string", "SELECT COUNT(*) AS n, 'string' AS kind FROM orders")
def a21(t):
    rows = t.spark.read.json(_shapes(t))
    return rows.agg(F.count("*").alias("n")).withColumn("kind", F.lit(null_types_to_string(rows.schema)["e"].dataType.simpleString()))


@query("a22_rows_with_schema", "SELECT p_partkey AS k, p_size + 1 AS v FROM part")
def a22(t):
    rows = t.part.select("p_partkey", "p_size").rdd.map(lambda r: (r[0], r[1] + 1))
    return t.spark.createDataFrame(rows, T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.IntegerType())]))


@query("a23_schema_from_python_objects", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def a23(t):
    rows = t.supplier.select("s_suppkey", "s_name").rdd.map(lambda r: Row(id=r[0], name=r[1]))
    return t.spark.createDataFrame(rows)


@dataclass
class Supplier:
    """Record class whose annotations give the table schema."""

    id: int
    name: str
    balance: float


@query("a24_schema_from_record_class", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def a24(t):
    return files.cast_to(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), files.record_schema(Supplier))


@query("a25_warehouse_table_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def a25(t):
    name = _save_table(t.orders.select("o_orderkey", "o_orderstatus"), t, "scan", by=["o_orderstatus"])
    return t.spark.table(name).filter("o_orderstatus = 'F'")


@query("a26_partitioned_directory", "SELECT l_returnflag, COUNT(*) AS n, MAX(l_quantity) AS q FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def a26(t):
    path = scratch_path(t.spark, "parts")
    t.lineitem.select("l_returnflag", "l_quantity").write.partitionBy("l_returnflag").parquet(path)
    rows = t.spark.read.parquet(path).filter("l_returnflag <> 'N'")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"))


def _libsvm(t):
    """The embeddings table as LibSVM text: label, then 1-based index:value pairs."""
    path = scratch_path(t.spark, "libsvm")
    pairs = F.transform(F.col("embedding"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x.cast("double").cast("string")))
    t.embeddings.select(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(pairs, " ")).alias("value")).write.text(path)
    return path


@query("a27_libsvm_source", "SELECT CAST(label AS DOUBLE) AS label, COUNT(*) AS n FROM embeddings GROUP BY 1")
def a27(t):
    rows = t.spark.read.format("libsvm").option("numFeatures", "64").load(_libsvm(t))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


@query("a28_labeled_point_text", "SELECT CAST(label AS DOUBLE) AS label, round(CAST(embedding[1] AS DOUBLE), 9) AS x0, 64 AS dim FROM embeddings")
def a28(t):
    path = scratch_path(t.spark, "points")
    vec = text.vector_text(F.transform("embedding", lambda x: x.cast("double")))
    t.embeddings.select(F.concat(F.lit("("), F.col("label").cast("string"), F.lit(","), vec, F.lit(")")).alias("value")).write.text(path)
    rows = text.read_labeled_points(t.spark, path)
    return rows.select("label", F.round(F.col("features")[0], 9).alias("x0"), F.size("features").alias("dim"))


@query(
    "a29_edge_list",
    "SELECT least(o_custkey, o_orderkey) AS src, greatest(o_custkey, o_orderkey) AS dst FROM orders",
)
def a29(t):
    path = scratch_path(t.spark, "edges")
    lines = t.orders.select(F.concat_ws("\t", "o_orderkey", "o_custkey").alias("value"))
    t.region.select(F.concat(F.lit("# "), "r_name").alias("value")).unionAll(lines).write.text(path)
    return text.read_edge_list(t.spark, path, canonical=True)


@query("a30_delimited_records", "SELECT p_partkey, p_name, p_size FROM part")
def a30(t):
    return t.spark.read.csv(_part_lines(t, "delimited"), "p_partkey long, p_name string, p_size int", sep="|")


@query("a31_image_pairs", "SELECT label, COUNT(*) AS n FROM embeddings GROUP BY 1")
def a31(t):
    """Embeddings rewritten as IDX image and label files (8x8), then read back in pairs."""
    import struct as st

    folder = scratch_path(t.spark, "idx")

    def encode(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for rows in batches:
            pixels = (np.abs(np.stack(rows.embedding.to_list())) * 255).astype("uint8")
            n = len(rows)
            yield pd.DataFrame(
                {
                    "stem": [f"p{part}b{at}"],
                    "images": [st.pack(">IIII", 2051, n, 8, 8) + pixels.tobytes()],
                    "labels": [st.pack(">II", 2049, n) + rows.label.astype("uint8").to_numpy().tobytes()],
                }
            )
            at += 1

    packed = t.embeddings.select("embedding", "label").mapInPandas(encode, "stem string, images binary, labels binary")

    def save(rows):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        for r in rows:
            for kind in ("images", "labels"):
                with store.open_output_stream(f"{base}/{r.stem}-{kind}.idx") as f:
                    f.write(r[kind])

    packed.foreachPartition(save)
    pairs = files.read_idx_pairs(t.spark, f"{folder}/*-images.idx", f"{folder}/*-labels.idx")
    return pairs.groupBy("label").agg(F.count("*").alias("n"))


@query("a32_text_sink", _LINES)
def a32(t):
    path = scratch_path(t.spark, "gzip")
    t.part.select(F.concat_ws("|", "p_partkey", "p_name", "p_size").alias("value")).write.option("compression", "gzip").text(path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


query("a33_object_file_sink", _PAIRS)(a10)
query("a34_sequence_file_sink", _PAIRS)(a9)


@query("a35_hadoop_output_format", _PAIRS)
def a35(t):
    path = scratch_path(t.spark, "output")
    pairs = t.part.select(F.col("p_partkey").cast("string"), "p_name")
    files.write_key_value(pairs, path, files.SEQUENCE_OUTPUT, files.TEXT_VALUE, files.TEXT_VALUE)
    rows = files.read_key_value(t.spark, path, files.SEQUENCE_INPUT, files.TEXT_VALUE, files.TEXT_VALUE, "k string, v string")
    return rows.withColumn("k", F.col("k").cast("long"))


@query("a36_parquet_sink_codec", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1")
def a36(t):
    path = scratch_path(t.spark, "codec")
    t.orders.write.option("compression", "gzip").parquet(path)
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("a37_create_empty_parquet", "SELECT COUNT(*) AS n FROM supplier")
def a37(t):
    path = scratch_path(t.spark, "empty")
    schema = files.record_schema(Supplier)
    files.create_empty_parquet(t.spark, path, schema)
    files.cast_to(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), schema).write.mode("append").parquet(path)
    return t.spark.read.parquet(path).agg(F.count("*").alias("n"))


@query(
    "a38_insert_append_overwrite",
    "SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 1000",
)
def a38(t):
    keys = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    name = _save_table(keys, t, "insert")
    keys.filter("v > 0").write.insertInto(name, overwrite=True)
    keys.filter("v < 1000").write.insertInto(name)
    return t.spark.table(name)


@query("a39_create_table_as_select", "SELECT p_type, COUNT(*) AS n FROM part GROUP BY 1")
def a39(t):
    name = _table_name("ctas")
    t.sql(
        f"CREATE TABLE {name} USING parquet LOCATION '{scratch_path(t.spark, 'ctas')}' AS "
        "SELECT p_type, COUNT(*) AS n FROM {part} GROUP BY p_type"
    )
    return t.spark.table(name)


@query(
    "a40_partitioned_insert",
    "SELECT o_orderkey, 2024 AS year, o_orderstatus FROM orders",
)
def a40(t):
    path = scratch_path(t.spark, "dynamic")
    files.write_partitioned(t.orders.select("o_orderkey", "o_orderstatus"), path, {"year": 2024}, ["o_orderstatus"])
    return t.spark.read.parquet(path)


@query("a41_cast_on_insert", "SELECT CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS DOUBLE) AS v FROM part")
def a41(t):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType())])
    return files.cast_to(t.part.select("p_partkey", "p_size"), schema)


@query(
    "a42_multi_insert",
    "SELECT CASE WHEN o_totalprice < 100000 THEN 'cheap' WHEN o_totalprice > 400000 THEN 'dear' ELSE 'fair' END AS which, COUNT(*) AS n FROM orders GROUP BY 1",
)
def a42(t):
    base = t.orders.select("o_orderkey", "o_totalprice")
    rules = {"cheap": "o_totalprice < 100000", "dear": "o_totalprice > 400000"}
    rules["fair"] = f"NOT coalesce({' OR '.join(rules.values())}, false)"
    paths = {w: scratch_path(t.spark, w) for w in rules}
    files.multi_insert(base, [(base.filter(rule), paths[w]) for w, rule in rules.items()])
    counts = [t.spark.read.parquet(p).groupBy(F.lit(w).alias("which")).agg(F.count("*").alias("n")) for w, p in paths.items()]
    return reduce(DataFrame.unionAll, counts)


@query("a43_libsvm_sink", "SELECT CAST(label AS DOUBLE) AS label, COUNT(*) AS n FROM embeddings GROUP BY 1")
def a43(t):
    from pyspark.ml.functions import array_to_vector

    path = scratch_path(t.spark, "svm-out")
    vec = array_to_vector(F.transform("embedding", lambda x: x.cast("double")))
    t.embeddings.select(F.col("label").cast("double").alias("label"), vec.alias("features")).write.format("libsvm").save(path)
    return t.spark.read.format("libsvm").option("numFeatures", "64").load(path).groupBy("label").agg(F.count("*").alias("n"))


@query("a44_temp_table", "SELECT n_name, n_regionkey FROM nation")
def a44(t):
    t.nation.createOrReplaceTempView("a44_nations")
    rows = t.spark.sql("SELECT n_name, n_regionkey FROM a44_nations")
    t.spark.catalog.dropTempView("a44_nations")
    return rows


@query("a45_table_lookup", "SELECT r_name FROM region")
def a45(t):
    t.region.createOrReplaceTempView("a45_regions")
    return t.spark.table("a45_regions").select("r_name")


@query("a46_cache_table", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1")
def a46(t):
    t.events.select("event_type").createOrReplaceTempView("a46_events")
    t.spark.catalog.cacheTable("a46_events")
    counts = t.spark.table("a46_events").groupBy("event_type").agg(F.count("*").alias("n"))
    counts = cut_lineage(counts)
    t.spark.catalog.uncacheTable("a46_events")
    return counts


@query("a47_persist_level", "SELECT l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY 1")
def a47(t):
    kept = t.lineitem.select("l_linestatus").persist(StorageLevel.DISK_ONLY)
    counts = cut_lineage(kept.groupBy("l_linestatus").agg(F.count("*").alias("n")))
    kept.unpersist()
    return counts


@query("a48_checkpoint", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1")
def a48(t):
    return cut_lineage(t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")))


@query("a49_table_statistics")
def a49(t):
    name = _save_table(t.part, t, "stats")
    t.spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS NOSCAN")
    return t.spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Statistics'").select(F.col("data_type").alias("statistics"))


@query("a50_push_source", "SELECT event_type, COUNT(*) AS n, SUM(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def a50(t):
    """Events pushed in eight deliveries: the query stops after five batches, a new one goes on from its log."""
    from functools import partial

    from brindle.sources.inbox import deliver, inbox_stream
    from brindle.streaming.replay import run_at_intervals

    folder, state, out = (scratch_path(t.spark, s) for s in ("inbox", "inbox-state", "inbox-out"))
    events = t.events.select("event_id", "event_type")
    feeds = [partial(deliver, events.filter(F.pmod("event_id", F.lit(8)) == i), folder) for i in range(8)]
    for part in (feeds[:5], feeds[5:]):
        stream = inbox_stream(t.spark, folder, "event_id bigint, event_type string")
        run_at_intervals(stream, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b={i}"), "inbox", "100 milliseconds", part, checkpoint=state)
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("a52_pickle_sink", _PAIRS)
def a52(t):
    path = scratch_path(t.spark, "pickle")
    _pairs(t).rdd.map(tuple).saveAsPickleFile(path, 100)
    return t.spark.sparkContext.pickleFile(path).toDF("k long, v string")


@query("a53_vector_text", "SELECT vec_id, round(CAST(embedding[2] AS DOUBLE), 9) AS dense, round(CAST(embedding[3] AS DOUBLE), 9) AS sparse FROM embeddings")
def a53(t):
    path = scratch_path(t.spark, "vectors")
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    indices = F.array_join(F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i.cast("string")), ",")
    sparse = F.concat(F.lit("(64,["), indices, F.lit("],"), text.vector_text(doubles), F.lit(")"))
    t.embeddings.select(F.concat_ws("|", F.col("vec_id").cast("string"), text.vector_text(doubles), sparse).alias("value")).write.text(path)
    parts = F.split("value", r"\|")
    rows = t.spark.read.text(path).select(parts[0].cast("long").alias("vec_id"), parts[1].alias("d"), parts[2].alias("s"))
    return rows.select(
        "vec_id", F.round(text.parse_vector(F.col("d"))[1], 9).alias("dense"), F.round(text.parse_vector(F.col("s"))[2], 9).alias("sparse")
    )


@query("a54_cache_statement", "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY 1")
def a54(t):
    t.part.createOrReplaceTempView("a54_part")
    t.spark.sql("CACHE TABLE a54_part")
    counts = cut_lineage(t.spark.sql("SELECT p_brand, COUNT(*) AS n FROM a54_part GROUP BY p_brand"))
    t.spark.sql("UNCACHE TABLE a54_part")
    return counts


@query("a55_drop_table", "SELECT COUNT(*) AS n, FALSE AS still_there FROM supplier")
def a55(t):
    name = _save_table(t.supplier, t, "drop")
    n = t.spark.table(name).agg(F.count("*").alias("n"))
    t.spark.sql(f"DROP TABLE IF EXISTS {name}")
    return n.withColumn("still_there", F.lit(t.spark.catalog.tableExists(name)))


@query("a56_load_into_partition", "SELECT n_nationkey, n_name, 'd1' AS ds FROM nation UNION ALL SELECT s_nationkey, s_name, 'd2' FROM supplier")
def a56(t):
    path = scratch_path(t.spark, "load")
    files.write_partitioned(t.nation.select("n_nationkey", "n_name"), path, {"ds": "d1"})
    files.write_partitioned(t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("n_name")), path, {"ds": "d2"})
    return t.spark.read.parquet(path)


@query("a57_create_table_from_record_type", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def a57(t):
    name = _table_name("typed")
    schema = files.record_schema(Supplier)
    t.spark.catalog.createTable(name, path=scratch_path(t.spark, "typed"), source="parquet", schema=schema)
    files.cast_to(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), schema).write.insertInto(name)
    return t.spark.table(name)
