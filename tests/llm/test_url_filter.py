import re

from pyspark.sql import functions as F

from brindle.llm import url_filter as U

RULES = [U.Rule("allow", "org", "/"), U.Rule("block", "example.org", "/es/"), U.Rule("block", "example.org", "/en/1"), U.Rule("allow", "com", "/fr/")]
URLS = """http://a.example.org/es/x|HTTP://EXAMPLE.org/es|https://example.org/en/12?q#f|http://badexample.org/es/|http://x.com/fr/1|http://com/fr/|
http://x.com?/fr/|//x.com/fr/|x://y://z/p|http://WWW.Site.net/p/|https://site.net/p#top|http://site.net/p?a=1|http://ÄB.net/Q|http://|://||no scheme""".replace("\n", "").split("|")
ROWS = [*enumerate(URLS), (100, None), (100, None), (None, "http://site.net/p")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(str.maketrans(U.UPPER, U.LOWER)), re.match(r"[^?#]*", rest[len(host) :])[0]


def canon(url):
    host, path = parts(url)
    if not host:
        return None
    query = re.match(r"[^?#]*(\?[^#]*)?", url.split("://", 1)[1])[1] or ""
    return re.sub(r"^www\.", "", host) + path.rstrip("/") + query


def judged(url, listed):
    host, path = parts(url)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fit, key=lambda r: len(r.host + r.path), default=None)
    hit = canon(url) in {canon(u) for u in listed} - {None}
    return host, path, rule and rule.host + rule.path, hit, rule.verdict if rule else "block" if hit else "allow"


def test_verdicts(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string").withColumn("block", F.lit(1)).withColumn("canon", F.lit("x"))
    for listed in (["https://www.site.net/p", None, "http://z/", "http://äb.net/Q"], []):
        frame = spark.createDataFrame([(u,) for u in listed], "url string")
        got = [(r.page_id, r.host, r.path, r.rule, r.listed, r.verdict) for r in U.filter_urls(pages, frame, RULES).collect()]
        assert sorted(got, key=str) == sorted([(i, *judged(u, listed)) for i, u in ROWS], key=str)


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    urls = spark.range(40_000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("canon"), (F.col("id") % 2 == 0).alias("listed"))
    for blocks, most in ((U.blocks_for(20_000), 0.02), (8, 1.0)):
        bloom = U.bloom_filter(urls.filter("listed"), blocks)
        assert bloom.count() <= blocks
        seen = U.maybe_listed(urls, bloom, blocks).groupBy("listed").agg(F.avg(F.col("possible").cast("int")).alias("p"))
        share = {r.listed: r.p for r in seen.collect()}
        assert share[True] == 1.0 and share[False] <= most


def test_size_is_bounded():
    assert U.blocks_for(0) == 1 and U.blocks_for(10**12) == U.MAX_BLOCKS


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(none, none.select("url")).collect() == []
