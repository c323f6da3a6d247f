"""Registered queries of the text operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate as contamination
from brindle.llm import exact_stream, line_dedup, order_minhash, pii, prefix_trees, quality, segmentations, suffix_dedup, token_links, url_filter, warc, whitening
from brindle.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def joined_digest(items):
    """SHA-256, lowercase hex, of strings joined by commas."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


@_register
def op1_longest_previous_factor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 100 bytes that stand earlier."""
    left = suffix_dedup.dedup_substrings(Tables(spark, sf_dir).documents, keep_bytes=False)
    removed = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, b: a + b)
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


@_register
def op2_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and occurring benchmark items of every document."""
    t = Tables(spark, sf_dir)
    found = contamination.decontaminate(t.documents, t.benchmark)
    hit = contamination.hit_words()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        joined_digest("items").alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@_register
def op3_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document, by the state of a stream over the whole table."""
    found = exact_stream.exact_dedup(spark, Tables(spark, sf_dir).path("documents"))
    digest = F.lower(F.hex("digest"))
    return found.select("doc_id", "keep_id", "group_size", "kept", digest.alias("text_sha256"))


ORACLES["op3_streaming_exact_dedup"] = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""


@_register
def op4_gumbel_top_k_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four distinct segmentations of every document, drawn without replacement, with their piece ids."""
    drawn = segmentations.sample_segmentations(Tables(spark, sf_dir).documents)
    fields = [F.col(f"samples.{c}").alias(c) for c in ("n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_sha256", "ids")]
    return drawn.select("doc_id", F.size("samples").cast("long").alias("n_samples"), "decoded", *fields)


@_register
def op5_disclosure_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the words near it that disclose it."""
    found = pii.find_personal_data(Tables(spark, sf_dir).documents)
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(pii.as_text(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.as_text(F.concat("base", "added")).alias("spans"))


@_register
def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back through the index."""
    index = warc.write_archives(Tables(spark, sf_dir).pages)
    facts = warc.payload_facts(warc.read_records(index))
    return facts.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


ORACLES["op6_warc_round_trip"] = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> keep AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> keep AND payload_bytes >= 100 THEN keep END AS refers_to
FROM (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
             min(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages)
"""

#: Fixed values of the contract.
URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


@_register
def op7_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page: rules first, then the list of URLs seen on pages whose id is divisible by 50."""
    pages = Tables(spark, sf_dir).pages
    listed = pages.filter("page_id % 50 = 0").select("url")
    return url_filter.filter_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


ORACLES["op7_bloom_url_filter"] = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1), '') AS query
  FROM parts
), judged AS (
  SELECT page_id, host, path,
         CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || query END AS canon,
         CASE WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
              WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
              WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
              WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
              WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule
  FROM split
), listed AS (SELECT DISTINCT canon FROM judged WHERE page_id % 50 = 0 AND canon IS NOT NULL)
SELECT page_id, host, path, rule, l.canon IS NOT NULL AS listed,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM judged LEFT JOIN listed l USING (canon)
"""


@_register
def op10_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    t = Tables(spark, sf_dir)
    return quality.score_quality(t.documents, t.labels)


@_register
def op8_winnowing_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated runs of lines."""
    left = line_dedup.dedup_lines(Tables(spark, sf_dir).documents)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return left.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(text, 256).alias("kept_sha256"))


@_register
def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    found = order_minhash.near_duplicates(Tables(spark, sf_dir).documents)
    return found.select("doc_id", "class_id", "class_size", "kept")


@_register
def op11_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages of 13 words that stand in an earlier one."""
    left = prefix_trees.dedup_passages(Tables(spark, sf_dir).documents, keep_text=False)
    removed = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, b: a + b)
    return left.select("doc_id", "n_words", removed.alias("n_removed"), "kept_sha256")


@_register
def op12_golub_kahan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on up to 32 principal components, each over its deviation."""
    found = whitening.whiten(Tables(spark, sf_dir).embeddings)
    each = found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "one"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "one.whitened", "one.explained", "identity_error")


@_register
def op13_gustavson_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document under two tokenizers, with the corpus-wide counts of its links."""
    return token_links.align_documents(Tables(spark, sf_dir).documents)
