"""WARC archives with an index that is written first, and coalesced range reads."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import CHUNK_BYTES, chunked, empty_if_null, utf8_buffers
from brindle.session import scratch_path

#: Payloads below this size are stored whole even if they repeat.
LEAST_REVISIT = 100
ROTATE_BYTES = 128 << 20
#: Records nearer than this in a file are read together, as far as one read stays within RANGE_BYTES.
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"

NAMESPACE = uuid.UUID(int=0)
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(page_id, digest: str) -> str:
    return uuid.uuid5(NAMESPACE, f"{page_id} {digest}").urn


def _header_value(value: str) -> str:
    """A value without line ends, percent-encoded where needed."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def encode_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member of its own."""
    block = HTTP % len(payload) + payload if kind == "response" else b""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id(page_id, digest)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _header_value(url or "about:blank")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if kind == "revisit":
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{record_id(refers_to, digest)}>"),
        ]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 5, mtime=0)


def decode_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one gzip member."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else b""


def plan_records(pages: DataFrame) -> DataFrame:
    """What to write for every row: page_id, url, html, digest, kind, refers_to."""
    rows = pages.select("page_id", "url", empty_if_null("html").alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = rows.filter(F.octet_length("html") >= LEAST_REVISIT)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    kind = F.when(again, "revisit").otherwise("response")
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", kind.alias("kind"), F.when(again, F.col("first")).alias("refers_to"))


class _Archive:
    """Files of one task: gzip members one after the other, a new file when one is full."""

    def __init__(self, folder: str):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.folder, self.out, self.at = folder, None, 0

    def add(self, record: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= ROTATE_BYTES:
            self.close()
            name = f"part-{uuid.uuid4().hex}.warc.gz"
            self.fs.create_dir(self.root, recursive=True)
            self.out, self.at, self.file = self.fs.open_output_stream(f"{self.root}/{name}", compression=None), 0, f"{self.folder}/{name}"
        place = (self.file, self.at, len(record))
        self.out.write(record)
        self.at += len(record)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record per row of ``pages`` and return the index, itself a written table.

    Index columns: page_id, url, digest, kind, refers_to, file, offset, length.
    A task that is tried again writes files with new names, and the index lists
    only records of the tasks that ended; files of lost tries are not read.

    Of equal payloads of at least LEAST_REVISIT bytes, the smallest page_id has
    the response and the others are revisits of it.  A null html is an empty
    payload; a null url is written as about:blank and stays null in the index;
    rows with a null page_id revisit a response if there is one.  Rows that
    repeat the page_id of a response are responses too.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    id_type = pages.schema["page_id"].dataType
    schema = T.StructType(
        [T.StructField("page_id", id_type), T.StructField("url", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("refers_to", id_type)]
        + [T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]
    )
    archives = f"{folder}/archives"

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(archives)
        for batch in chunked(batches, "html"):
            data, at = utf8_buffers(batch.column("html"))
            raw, at = data.tobytes(), at.tolist()
            columns = {c: batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "kind", "refers_to")}
            places = [archive.add(encode_record(i, u, raw[low:high], d, k, r)) for low, high, i, u, d, k, r in zip(at, at[1:], *columns.values(), strict=False)]
            kept = [batch.column(c) for c in columns]
            file, offset, length = zip(*places, strict=True)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(file), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], schema.names)
        archive.close()

    plan_records(pages).mapInArrow(write, schema).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(schema).parquet(f"{folder}/index")


def coalesced_ranges(index: DataFrame, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """(file, start, end, records): neighbours in a file are read together, gaps up to ``gap`` included.

    Files are of bounded size, so the order within a file is no large group.
    """
    by_offset = Window.partitionBy("file").orderBy("offset", "row")
    end = F.col("offset") + F.col("length")
    rows = index.withColumn("row", F.xxhash64("page_id", "digest")).withColumn("before", F.lag(end).over(by_offset)).withColumn("cell", F.floor(F.col("offset") / most))
    new = F.col("before").isNull() | (F.col("offset") - F.col("before") > gap) | (F.col("cell") != F.lag("cell").over(by_offset))
    rows = rows.withColumn("run", F.sum(F.when(new, 1).otherwise(0)).over(by_offset))
    record = F.struct("offset", "length", "page_id", "url", "digest", "kind", "refers_to")
    return rows.groupBy("file", "run").agg(F.min("offset").alias("start"), F.max(end).alias("end"), F.collect_list(record).alias("records"))


def read_records(index: DataFrame, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """The selected records, read back from the archives by coalesced ranges.

    Returns page_id, url, kind, refers_to, digest (from the record's own header)
    and payload (bytes; null for a revisit).  A record whose id differs from
    the index, or whose payload differs from its digest, is an error.
    """
    id_type = index.schema["page_id"].dataType
    schema = T.StructType(
        [T.StructField("page_id", id_type), T.StructField("url", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("refers_to", id_type), T.StructField("digest", T.StringType()), T.StructField("payload", T.BinaryType())]
    )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = _arrow(schema, batch)
            for i in range(batch.num_rows):
                yield from _read_range(*(batch.column(c)[i].as_py() for c in ("file", "start", "end", "records")), kinds)

    return coalesced_ranges(index, gap, most).mapInArrow(read, schema)


def _read_range(file: str, start: int, end: int, records: list[dict], kinds: pa.Schema, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Records of one range, in batches of about ``limit`` bytes of payload: a range holds many times its size when unpacked."""
    store, path = pafs.FileSystem.from_uri(file)
    with store.open_input_file(path) as source:
        data = memoryview(source.read_at(end - start, start))
    rows, held = [], 0
    for r in records:
        rows.append(_checked(data[r["offset"] - start : r["offset"] - start + r["length"]], r))
        held += len(rows[-1]["payload"] or b"")
        if held >= limit:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def _arrow(schema: T.StructType, batch: pa.RecordBatch) -> pa.Schema:
    record = batch.schema.field("records").type.value_type
    kinds = {"payload": pa.binary()}
    return pa.schema([(f.name, kinds.get(f.name) or record.field(f.name).type) for f in schema])


def _checked(data: bytes, r: dict) -> dict:
    fields, payload = decode_record(data)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Record-ID"] != f"<{record_id(r['page_id'], r['digest'])}>":
        raise ValueError(f"no record of {r['page_id']} at {r['offset']}")
    if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {r['page_id']} differs from its digest")
    return {c: r[c] for c in ("page_id", "url", "refers_to")} | {"kind": fields["WARC-Type"], "digest": digest, "payload": payload if fields["WARC-Type"] == "response" else None}


def payload_facts(records: DataFrame) -> DataFrame:
    """(page_id, kind, refers_to, payload_bytes, payload_digest): a revisit's from the response that it names.

    What is read back is reduced to sizes and digests and written once, as
    responses are needed twice.
    """
    spark, path = records.sparkSession, scratch_path(records.sparkSession, "warc-facts")
    size, digest = F.octet_length("payload").cast("long"), F.sha2("payload", 256)
    records.select("page_id", "kind", "refers_to", "digest", size.alias("payload_bytes"), digest.alias("payload_digest")).write.parquet(path)
    facts = spark.read.parquet(path)
    own = facts.filter("kind = 'response'").drop("digest")
    visits = facts.filter("kind = 'revisit'").drop("payload_bytes", "payload_digest")
    named = visits.select("refers_to", "digest").distinct()
    sources = own.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), "payload_bytes").join(named, ["refers_to", "digest"], "left_semi").distinct()
    visits = visits.join(sources, ["refers_to", "digest"]).select("page_id", "kind", "refers_to", "payload_bytes", F.col("digest").alias("payload_digest"))
    return own.unionByName(visits)
