"""Text functions the platform has no single built-in for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.relational import broadcast_if_small, spread_out


def field(x: Column, *choices: Column) -> Column:
    """1-based place of ``x`` among the choices, 0 if absent or null."""
    return F.coalesce(F.array_position(F.array(*choices), x), F.lit(0)).cast("int")


def _runs(df: DataFrame, text: str, n: int) -> DataFrame:
    """Runs of n neighbouring words of a sentence, lower case, as one string each: words hold no space."""
    words = F.transform(F.sentences(F.col(text)), lambda s: F.transform(s, F.lower))
    starts = lambda s: F.when(F.size(s) >= n, F.sequence(F.lit(1), F.size(s) - (n - 1)))
    runs = F.transform(words, lambda s: F.coalesce(F.transform(starts(s), lambda i: F.concat_ws(" ", F.slice(s, i, n))), F.array().cast("array<string>")))
    return spread_out(df.select(text)).select(F.explode(F.flatten(runs)).alias("run"))


def _most(runs: DataFrame, k: int) -> DataFrame:
    """The k most frequent runs as arrays of words, ties by the words."""
    counts = runs.groupBy("run").agg(F.count("*").alias("n"))
    top = counts.select(F.split("run", " ").alias("ngram"), "n")
    return top.orderBy(F.desc("n"), "ngram").limit(k)


def ngrams(df: DataFrame, text: str, n: int, k: int) -> DataFrame:
    """The k most frequent runs of n words, exact counts, ties by the words."""
    return _most(_runs(df, text, n), k)


def context_ngrams(df: DataFrame, text: str, context: Sequence[str | None], k: int) -> DataFrame:
    """The k most frequent fillings of the ``None`` places of a word pattern."""
    words = F.split("run", " ")
    runs = _runs(df, text, len(context))
    for i, word in enumerate(context):
        if word is not None:
            runs = runs.filter(words[i] == word.lower())
    free = F.concat_ws(" ", *[words[i] for i, word in enumerate(context) if word is None])
    return _most(runs.select(free.alias("run")), k)


def in_file(df: DataFrame, column: str, path: str) -> DataFrame:
    """Rows whose value is a line of the text file(s) at ``path``."""
    lines = df.sparkSession.read.text(path).select(F.col("value").alias("__line")).distinct()
    return df.join(broadcast_if_small(lines), F.col(column) == F.col("__line"), "left_semi")


def parse_url_tuple(url: Column, *parts: str) -> list[Column]:
    """One column per part name; ``QUERY:key`` takes one query parameter."""
    out = []
    for i, part in enumerate(parts):
        name, _, key = part.partition(":")
        args = [F.lit(name)] + ([F.lit(key)] if key else [])
        out.append(F.parse_url(url, *args).alias(f"c{i}"))
    return out


def bucket_hash(c: Column) -> Column:
    """Hash of a text as the warehouse's buckets use it: h = 31 * h + byte, in 32 bits."""
    codes = F.transform(F.filter(F.split(c, ""), lambda ch: ch != ""), F.ascii)
    wide = F.aggregate(
        codes, F.lit(0).cast("long"), lambda h, b: F.shiftright(F.shiftleft(h * 31 + b, 32), 32)
    )
    return wide.cast("int")
