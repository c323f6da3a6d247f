"""Text codecs: whole files, edge lists, vectors, labeled points, delimited records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths: str) -> DataFrame:
    """Lines of a path, glob or comma-separated list of them."""
    return spark.read.text([p.strip() for p in paths.split(",")])


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, content) per small file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_edge_list(spark: SparkSession, path: str, canonical: bool = False) -> DataFrame:
    """Rows (src, dst) from lines of two ids; ``#`` starts a comment line."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    edges = lines.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))
    if canonical:
        edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return edges


def parse_dense(c: Column) -> Column:
    """``[1.0,2.0]`` or ``1.0 2.0`` to an array of doubles."""
    body = F.regexp_replace(c, r"[\[\]()\s]+", " ")
    return F.transform(F.split(F.trim(body), r"[,\s]+"), lambda x: x.cast("double"))


def parse_sparse(c: Column) -> Column:
    """``(size,[i,...],[v,...])`` to a struct of size, indices and values."""
    nums = F.regexp_extract(c, r"\[([^\]]*)\]\s*,\s*\[([^\]]*)\]", 1)
    vals = F.regexp_extract(c, r"\[([^\]]*)\]\s*,\s*\[([^\]]*)\]", 2)
    return F.struct(
        F.regexp_extract(c, r"^\(\s*(\d+)", 1).cast("int").alias("size"),
        F.transform(F.split(nums, ","), lambda x: F.trim(x).cast("int")).alias("indices"),
        F.transform(F.split(vals, ","), lambda x: F.trim(x).cast("double")).alias("values"),
    )


def sparse_to_dense(c: Column) -> Column:
    """Array of ``size`` doubles from the struct of :func:`parse_sparse`."""
    pairs = F.map_from_arrays(c["indices"], c["values"])
    places = F.sequence(F.lit(0), c["size"] - 1)
    return F.transform(places, lambda i: F.coalesce(F.try_element_at(pairs, i), F.lit(0.0)))


def parse_vector(c: Column) -> Column:
    """Dense or sparse vector text to an array of doubles."""
    return F.when(c.startswith("("), sparse_to_dense(parse_sparse(c))).otherwise(parse_dense(c))


def read_labeled_points(spark: SparkSession, path: str) -> DataFrame:
    """Rows (label, features) from ``label,v1 v2 ...`` or ``(label,[v1,v2,...])`` lines."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    body = F.regexp_replace("value", r"^\s*\(?\s*([^,\[]+),\s*", "")
    label = F.regexp_extract("value", r"^\s*\(?\s*([^,\[]+),", 1).cast("double")
    return lines.select(label.alias("label"), parse_dense(body).alias("features"))


def vector_text(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))
