"""Key-value files, JDBC ranges, image pairs."""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import fields, is_dataclass
from typing import get_type_hints

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQUENCE_OUTPUT = "org.apache.hadoop.mapreduce.lib.output.SequenceFileOutputFormat"
SEQUENCE_INPUT = "org.apache.hadoop.mapreduce.lib.input.SequenceFileInputFormat"
OLD_TEXT_INPUT = "org.apache.hadoop.mapred.TextInputFormat"
NEW_TEXT_INPUT = "org.apache.hadoop.mapreduce.lib.input.TextInputFormat"
LONG_KEY = "org.apache.hadoop.io.LongWritable"
TEXT_VALUE = "org.apache.hadoop.io.Text"


def read_key_value(
    spark: SparkSession, path: str, input_format: str, key: str, value: str, schema: str, old_api: bool = False,
    conf: dict | None = None,
) -> DataFrame:
    """Any file input format of the Hadoop API as a two-column frame."""
    sc = spark.sparkContext
    read = sc.hadoopFile if old_api else sc.newAPIHadoopFile
    return read(path, input_format, key, value, conf=conf).toDF(schema)


def read_sequence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.sparkContext.sequenceFile(path).toDF(schema)


def write_sequence(df: DataFrame, path: str) -> None:
    """First column as key, second as value."""
    df.rdd.map(lambda r: (r[0], r[1])).saveAsSequenceFile(path)


def write_key_value(df: DataFrame, path: str, output_format: str, key: str, value: str, conf: dict | None = None) -> None:
    df.rdd.map(lambda r: (r[0], r[1])).saveAsNewAPIHadoopFile(path, output_format, key, value, conf=conf)


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.sparkContext.pickleFile(path).toDF(schema)


def write_objects(df: DataFrame, path: str) -> None:
    df.rdd.map(tuple).saveAsPickleFile(path)


def jdbc_range_predicates(column: str, lower: int, upper: int, parts: int) -> list[str]:
    """One predicate per partition; together they cover exactly [lower, upper]."""
    length = upper - lower + 1
    edges = [lower + i * length // parts for i in range(parts + 1)]
    return [f"{column} >= {a} AND {column} <= {b - 1}" for a, b in zip(edges, edges[1:]) if a < b]


def read_jdbc_range(
    spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, properties: dict
) -> DataFrame:
    """Rows of a database table with lower <= column <= upper, read in parallel ranges."""
    predicates = jdbc_range_predicates(column, lower, upper, parts)
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    """Avro records; needs the platform's external Avro package on the class path."""
    return spark.read.format("avro").load(path)


def record_schema(record: type) -> T.StructType:
    """Schema of an annotated record class (dataclass)."""
    kinds = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), bytes: T.BinaryType()}
    if not is_dataclass(record):
        raise TypeError("a dataclass is expected")
    hints = get_type_hints(record)
    return T.StructType([T.StructField(f.name, kinds[hints[f.name]]) for f in fields(record)])


def create_empty_parquet(spark: SparkSession, path: str, schema: T.StructType, allow_existing: bool = True) -> DataFrame:
    mode = "ignore" if allow_existing else "error"
    spark.createDataFrame([], schema).write.mode(mode).parquet(path)
    return spark.read.schema(schema).parquet(path)


def write_partitioned(df: DataFrame, path: str, static: dict[str, object], dynamic: Sequence[str] = ()) -> None:
    """Partitioned insert: fixed partition values first, then those taken from the rows."""
    for name, value in static.items():
        df = df.withColumn(name, F.lit(value))
    df.write.mode("append").partitionBy(*static, *dynamic).parquet(path)


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns by position, cast to the types and names of a table; bad values become null."""
    if len(df.columns) != len(schema):
        raise ValueError("column count differs")
    return df.select(*[df[c].try_cast(f.dataType).alias(f.name) for c, f in zip(df.columns, schema)])


def multi_insert(df: DataFrame, targets: Sequence[tuple[DataFrame, str]]) -> None:
    """Several filtered or projected views of one input, each appended to its path."""
    df.persist()
    try:
        for view, path in targets:
            view.write.mode("append").parquet(path)
    finally:
        df.unpersist()


def read_idx_pairs(spark: SparkSession, images: str, labels: str, threshold: int = 30, batch: int = 4096) -> DataFrame:
    """Rows (file, i, label, features 0/1) from IDX image and label files of the same order.

    Headers: images are magic, count, rows, columns; labels magic, count; big-endian.
    Many files are read side by side; each pair is matched by its place in the sorted names.
    """

    def images_of(frames):
        import numpy as np

        for frame in frames:
            for path, content in zip(frame.path, frame.content):
                _, n, rows, cols = struct.unpack(">IIII", content[:16])
                pixels = np.frombuffer(content, np.uint8, n * rows * cols, 16).reshape(n, rows * cols)
                for at in range(0, n, batch):
                    block = (pixels[at : at + batch] > threshold).astype("float64")
                    yield pd.DataFrame({"file": path, "i": range(at, at + len(block)), "features": list(block)})

    def labels_of(frames):
        import numpy as np

        for frame in frames:
            for path, content in zip(frame.path, frame.content):
                _, n = struct.unpack(">II", content[:8])
                values = np.frombuffer(content, np.uint8, n, 8).astype("int32")
                yield pd.DataFrame({"file": path, "i": range(n), "label": values})

    def stem(c):
        return F.regexp_extract(c, r"([^/]+?)-(images|labels)[^/]*$", 1)

    left = spark.read.format("binaryFile").load(images).mapInPandas(images_of, "file string, i long, features array<double>")
    right = spark.read.format("binaryFile").load(labels).mapInPandas(labels_of, "file string, i long, label int")
    return left.withColumn("file", stem("file")).join(right.withColumn("file", stem("file")), ["file", "i"])
