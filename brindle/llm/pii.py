"""Personal data: patterns, and terms near them that disclose what they protect."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import chunked, content_key, words_of
from brindle.session import scratch_path

KINDS = ("email", "ip", "card", "phone")
#: Different texts in which a term must have met an entity before it is judged.
SUPPORT = 3
#: Share of the entity's information that a term gives away: from here it is generalised, or removed.
GENERALISE = 0.8
REMOVE = 0.95
#: Distinct words that a task counts before it passes the counts on.
COUNTED_WORDS = 200_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only begin where a run of digits does, as the runs are taken whole.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_DIGITS = re.compile("[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with a domain after it takes the characters before it, back to the last address."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _is_ip(match: str) -> bool:
    parts = [p.lstrip("0") for p in match.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _is_card(match: str) -> bool:
    digits = "".join(_DIGITS.findall(match))
    return 16 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then start; every kind leftmost and non-overlapping."""
    found = [("email", *span) for span in emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and _is_card(m[0])]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return found


def entity_of(kind: str, match: str) -> str:
    """What is protected, whatever way it is written."""
    return f"{kind} " + (match.lower() if kind in ("email", "ip") else "".join(_DIGITS.findall(match)))


def folded(word: str) -> str:
    """A-Z lower-cased."""
    return word.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> dict[str, list[int]]:
    """Every word that belongs to no mention, and where it starts; a word is as long as its folded form."""
    taken, at, end = sorted((s, e) for _, s, e in spans), 0, 0
    out: dict[str, list[int]] = {}
    for m in _WORD.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            end = max(end, taken[at][1])
            at += 1
        if end <= m.start():
            out.setdefault(folded(m[0]), []).append(m.start())
    return out


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, place, base, entities): the key and the spans of every text, and the different entities it mentions."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    keys = [docs.schema["doc_id"], T.StructField("row_key", T.LongType()), T.StructField("place", T.LongType())]
    schema = T.StructType([*keys, T.StructField("base", T.ArrayType(span)), T.StructField("entities", T.ArrayType(T.StringType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in chunked(batches, "text"):
            base, named = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                spans = base_spans(text)
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
                named.append(sorted({entity_of(kind, text[start:end]) for kind, start, end in spans}))
            arrays = [pa.array(base, pa.list_(span_type)), pa.array(named, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row_key", "place")), *arrays], schema.names)

    return docs.select("doc_id", content_key("doc_id", "text").alias("row_key"), content_key("text").alias("place"), "text").mapInArrow(run, schema)


def terms_in(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(place, term, starts): the words outside mentions of the texts of ``places(place)``, each text once."""
    texts = docs.select(content_key("text").alias("place"), "text").join(places, "place", "left_semi").dropDuplicates(["place"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            for place, value in zip(batch.column("place"), batch.column("text"), strict=True):
                text = value.as_py() or ""
                terms = terms_of(text, base_spans(text))
                arrays = [pa.array([place.as_py()] * len(terms), pa.int64()), pa.array(terms.keys(), pa.string()), pa.array(terms.values(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, ["place", "term", "starts"])

    return texts.mapInArrow(run, "place long, term string, starts array<int>")


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n) over all words of all texts; tasks add up their own words before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in chunked(batches, "text"):
            for value in batch.column("text").cast(pa.large_binary()):
                if value.is_valid:
                    counts.update(words_of(value.as_buffer().to_pybytes()))
                if len(counts) > COUNTED_WORDS:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _counted(counts: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])


def disclosures(near: DataFrame, counts: DataFrame, words: int) -> DataFrame:
    """The terms that give an entity away, as :func:`judged` says.

    ``near(entity, term, place)`` has a row per word of a text that mentions the entity.
    """
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("joint"), F.count_distinct("place").alias("support"))
    entities = near.groupBy("entity").agg(F.count("*").alias("words_near"))
    return judged(pairs, entities, counts, words)


def judged(pairs: DataFrame, entities: DataFrame, counts: DataFrame, words: int) -> DataFrame:
    """(entity, term, share, action) of the terms that give an entity away, from ``pairs(entity, term, joint, support)``.

    With p(c) the chance of a word to be in a text that mentions c, and p(c|t) that
    of the occurrences of t, the pointwise mutual information of c and t is
    log p(c|t) / p(c), and its share of the information of c, -log p(c), is
    what t discloses.
    """
    known = pairs.filter(F.col("support") >= SUPPORT).join(entities, "entity").join(counts, "term")
    p_entity = F.col("words_near") / F.lit(max(words, 1))
    p_given = F.least(F.col("joint") / F.col("n"), F.lit(1.0))
    share = F.when(p_entity < 1, 1 + F.log(p_given) / -F.log(p_entity)).otherwise(0.0)
    action = F.when(F.col("share") >= REMOVE, "remove").when(F.col("share") >= GENERALISE, "generalise")
    return known.select("entity", "term", share.alias("share")).withColumn("action", action).filter("action is not null")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, row_key, base, added.

    base are the spans of the patterns, added the spans of words that disclose an
    entity their text mentions, wherever in it they stand, with the action generalise
    or remove as kind; a word that discloses several takes the stronger action.
    Spans are arrays of (kind, start, end) in code points, end exclusive.  How much
    a word discloses is estimated over the whole corpus: all its words, and
    all those of texts that mention the entity.

    Nulls: a null text has no spans; a null doc_id is a row like any other.
    Rows that repeat get the same spans each and count each, but are one text.  An
    empty table gives an empty result; further columns are not read.
    """
    spark, folder = docs.sparkSession, scratch_path(docs.sparkSession, "pii")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    found = written(mentions(docs), "mentions")
    # Equal texts count as often as they are there, and are searched once.
    texts = found.filter(F.size("entities") > 0).groupBy("place").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"))
    named = texts.select("place", "copies", F.explode("entities").alias("entity"))
    often = named.groupBy("entity").agg(F.count("*").alias("texts")).filter(F.col("texts") >= SUPPORT).select("entity")
    named = written(named.join(often, "entity"), "named")
    terms = written(terms_in(docs, named.select("place").distinct()), "terms")
    counts = written(term_counts(docs), "counts")
    words = counts.agg(F.sum("n")).first()[0] or 0
    met = named.join(terms.select("place", "term", F.size("starts").alias("times")), "place")
    pairs = met.groupBy("entity", "term").agg(F.sum(F.col("copies") * F.col("times")).alias("joint"), F.count("*").alias("support"))
    sizes = terms.groupBy("place").agg(F.sum(F.size("starts")).alias("size"))
    entities = named.join(sizes, "place").groupBy("entity").agg(F.sum(F.col("copies") * F.col("size")).alias("words_near"))
    telling = written(judged(pairs, entities, counts, words), "telling")
    told = terms.join(telling.select("term").distinct(), "term", "left_semi")
    hits = named.join(told, "place").join(telling, ["entity", "term"]).groupBy("place", "term").agg(F.max("action").alias("kind"), F.first("starts").alias("starts"))
    each = hits.select("place", "kind", F.char_length("term").alias("length"), F.explode("starts").alias("start"))
    span = F.struct("kind", "start", (F.col("start") + F.col("length")).alias("end"))
    added = each.groupBy("place").agg(F.sort_array(F.collect_list(span)).alias("added"))
    out = found.select("doc_id", "row_key", "place", "base").join(added, "place", "left").drop("place")
    return out.withColumn("added", F.coalesce("added", F.array().cast(added.schema["added"].dataType)))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def generalised(word: str) -> str:
    """What is left of a word: that it is a number, a name or a word."""
    return "<number>" if word.isdigit() else "<name>" if word[:1].isupper() else "<word>"


def sanitised_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with mentions replaced by their kind, telling words generalised or removed."""
    out, at = [], 0
    for start, _, end, kind in sorted((s, -e, e, k) for k, s, e in spans):
        if start < at:
            continue
        out += [text[at:start], "" if kind == "remove" else generalised(text[start:end]) if kind == "generalise" else f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data taken out of ``text``; the other columns stay."""
    spans = find_personal_data(docs).select(F.col("row_key").alias("__row"), F.concat("base", "added").alias("__spans")).dropDuplicates(["__row"])
    keyed = docs.withColumn("__row", content_key("doc_id", "text")).join(spans, "__row", "left")
    replace = F.udf(lambda text, found: text and sanitised_text(text, [tuple(s) for s in found or ()]), T.StringType())
    return keyed.withColumn("text", replace("text", "__spans")).select(docs.columns)

