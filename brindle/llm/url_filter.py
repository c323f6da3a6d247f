"""URL rules, and a blocked Bloom filter in front of an exact join with listed URLs."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a block of the filter; a URL sets one bit in each.
WORDS = 8
BITS_PER_URL = 16
#: A block is a row of nine longs, so the filter that is broadcast stays below 20 MB of rows.
MAX_BLOCKS = 1 << 18

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, query; no scheme and no fragment.  Null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(host != "", F.concat(host, path, F.coalesce(query, F.lit(""))))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.host + r.path)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _masks(url: Column) -> list[Column]:
    bits = F.xxhash64(url, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def blocks_for(urls: int) -> int:
    """Blocks for so many URLs, within the bound that keeps the filter broadcastable."""
    return min(max(1, -(-urls * BITS_PER_URL // (64 * WORDS))), MAX_BLOCKS)


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, w0..w7) of the blocks that hold a URL of ``listed(canon)``; at most ``blocks`` rows."""
    words = [F.bit_or(m).alias(f"w{i}") for i, m in enumerate(_masks(F.col("canon")))]
    return listed.groupBy(_block(F.col("canon"), blocks).alias("block")).agg(*words)


def maybe_listed(urls: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """``urls(canon, ...)`` with ``possible``: false only where the URL is certainly not listed."""
    probe = urls.withColumn("block", _block(F.col("canon"), blocks)).join(F.broadcast(bloom), "block", "left")
    hit = F.col("canon").isNotNull()
    for i, mask in enumerate(_masks(F.col("canon"))):
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(mask) != 0)
    return probe.withColumn("possible", hit).drop("block", *[f"w{i}" for i in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = ()) -> DataFrame:
    """Verdict on the url of every row of ``pages``.

    Returns page_id, host, path, rule, listed, verdict.  The longest rule that
    fits decides; where none fits, a URL whose canonical form is that of a row
    of ``listed(url)`` is blocked and any other allowed.

    The filter holds every listed URL and is broadcast; its size follows the
    list up to ``MAX_BLOCKS``.  A list beyond that (about eight million URLs)
    fills it more densely, so more rows reach the exact join, which settles
    every possible hit by the whole canonical text: the verdicts stay the same.

    A null url or one without ``://`` has an empty host and path, fits no rule
    and is never listed.  Repeated rows are judged each; an empty list blocks
    nothing; further columns of either table are not read.
    """
    listed = listed.select(canonical(F.col("url")).alias("canon")).filter("canon is not null")
    blocks = blocks_for(listed.count())
    bloom = bloom_filter(listed, blocks)
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canon"))
    text, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = maybe_listed(judged.select("*", text.alias("rule"), verdict.alias("ruled")), bloom, blocks)
    exact = listed.distinct().withColumn("listed", F.lit(True))
    hits = judged.filter("possible").join(exact, "canon", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    rest = judged.filter("not possible").withColumn("listed", F.lit(False))
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return hits.unionByName(rest).select("page_id", "host", "path", "rule", "listed", verdict.alias("verdict"))
