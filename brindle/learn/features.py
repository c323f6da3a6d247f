"""Term frequencies, scaling, vectors as arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.relational import attach_row, hot_from_counts, salted_join
from brindle.session import scratch_path


def terms(df: DataFrame, key: str, text: str, pattern: str = r"[ \n\t]+") -> DataFrame:
    """Rows (key, term, tf) over the whole text.

    The texts are dealt by key before they are cut, so that all rows of a key are
    in one task: a text is far shorter than its rows of terms.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = df.select(key, text).repartition(tasks, key).select(key, F.explode(F.split(text, pattern)).alias("term")).filter("term <> ''")
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"))


def hashed_terms(tf: DataFrame, key: str, size: int, digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Rows (key, slot, tf): terms folded into ``size`` slots."""
    slot = F.pmod(digest(F.col("term")), F.lit(size)).cast("int")
    return tf.groupBy(key, slot.alias("slot")).agg(F.sum("tf").alias("tf"))


def inverse_frequency(tf: DataFrame, key: str, min_docs: int = 0) -> DataFrame:
    """Rows (term, df, idf) with idf = log((m + 1) / (df + 1)); 0 below ``min_docs``."""
    counts = tf.groupBy("term").agg(F.count("*").alias("df"))
    return _idf(counts, tf.agg(F.count_distinct(key).alias("m")), min_docs)


def _idf(counts: DataFrame, total: DataFrame, min_docs: int) -> DataFrame:
    idf = F.when(F.col("df") >= min_docs, F.log((F.col("m") + 1) / (F.col("df") + 1))).otherwise(0.0)
    return attach_row(counts, total).select("term", "df", idf.alias("idf"))


def tf_idf(tf: DataFrame, key: str) -> DataFrame:
    """Rows (key, term, weight); a term of a third of all rows is salted in the join.

    The terms are written once, and so are their document counts, which also say
    which terms are hot.  Equal terms of a task stand together, which makes the
    rows that are written and dealt by term much smaller.
    """
    spark, folder = tf.sparkSession, scratch_path(tf.sparkSession, "tf-idf")
    tf.sortWithinPartitions("term").write.parquet(f"{folder}/tf")
    tf = spark.read.parquet(f"{folder}/tf")
    tf.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{folder}/df")
    counts = spark.read.parquet(f"{folder}/df")
    hot = hot_from_counts(counts.select("term", F.col("df").alias("__n")), ["term"])
    idf = _idf(counts, tf.agg(F.count_distinct(key).alias("m")), 0).select("term", "idf")
    weighted = salted_join(tf, idf, ["term"], hot=hot, distinct=True)
    return weighted.select(key, "term", (F.col("tf") * F.col("idf")).alias("weight"))


def doubles(c: Column | str) -> Column:
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(c: Column, p: float = 2.0) -> Column:
    if p == float("inf"):
        return F.array_max(F.transform(c, F.abs))
    return F.pow(F.aggregate(F.transform(c, lambda x: F.pow(F.abs(x), F.lit(p))), F.lit(0.0), lambda s, x: s + x), F.lit(1 / p))


def normalized(c: Column, p: float = 2.0) -> Column:
    """Vector divided by its p-norm; a zero vector stays."""
    return F.when(norm(c, p) == 0, c).otherwise(F.transform(c, lambda x: x / norm(c, p)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def with_bias(c: Column) -> Column:
    return F.concat(c, F.array(F.lit(1.0)))


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def standard_scale(df: DataFrame, vector: str, out: str = "scaled", mean: bool = True, deviation: bool = True) -> DataFrame:
    """Array column centred and divided by the sample deviation of each place; constant places become 0."""
    places = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    # one row per place of the vector: the moments are collected into two short arrays
    moments = places.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("__mo"))
    joined = attach_row(df, moments)
    def scale(x, i):
        m = F.col("__mo")[i]
        centred = x - m["m"] if mean else x
        return F.when(m["s"] > 0, centred / m["s"]).otherwise(0.0) if deviation else centred
    return joined.withColumn(out, F.transform(vector, scale)).drop("__mo")


def vocabulary(tf: DataFrame, min_count: int = 5) -> DataFrame:
    """Rows (term, n) of terms with at least ``min_count`` uses."""
    return tf.groupBy("term").agg(F.sum("tf").alias("n")).filter(F.col("n") >= min_count)
