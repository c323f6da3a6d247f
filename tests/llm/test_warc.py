import hashlib

import pytest
from pyspark.sql import functions as F

from brindle.llm import warc as W

ROWS = [(i, f"http://h/{i}", f"<p>{'é' * (i % 7)} {'x' * 120 * (i % 3)}") for i in range(1, 40)]
ROWS += [(50, None, None), (51, "u\r\nInjected: 1", ""), (None, "http://n", ROWS[2][2]), (3, "http://h/3", ROWS[2][2]), (60, "http://z", "\r\n\r\nWARC/1.1\r\n" * 20)]


def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("offset", F.lit(1)).withColumn("digest", F.lit("d"))


def expected():
    payload = [(i, (h or "").encode()) for i, _, h in ROWS]
    first = {}
    for i, p in payload:
        if i is not None and len(p) >= 100:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, p in payload:
        again = p in first and first[p] != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    index = W.write_archives(pages(spark).repartition(3))
    facts = W.payload_facts(W.read_records(index))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in facts.collect()]
    assert sorted(got, key=str) == expected()


def test_selected_records_by_few_ranges(spark):
    index = W.write_archives(pages(spark).coalesce(1))
    some = index.filter("page_id % 5 = 0 and kind = 'response'")
    want = {r.page_id: r.url for r in some.collect()}
    for gap, most in ((0, 1 << 20), (100_000, 1 << 20), (100_000, 300)):
        ranges = W.coalesced_ranges(some, gap, most).collect()
        assert sum(len(r.records) for r in ranges) == len(want)
        assert all(r.start == min(x.offset for x in r.records) and r.end == max(x.offset + x.length for x in r.records) for r in ranges)
        got = {r.page_id: (r.url, bytes(r.payload)) for r in W.read_records(some, gap, most).collect()}
        html = {i: (h or "").encode() for i, _, h in ROWS}
        assert got == {i: (u, html[i]) for i, u in want.items()}
    assert len(W.coalesced_ranges(some, 100_000, 1 << 20).collect()) == 1


def test_index_that_does_not_fit_is_an_error(spark):
    index = W.write_archives(pages(spark))
    with pytest.raises(Exception, match="no record of"):
        W.read_records(index.withColumn("page_id", F.col("page_id") + 1)).collect()


def test_records_are_gzip_members_with_clean_headers():
    data = W.encode_record(7, "u\r\nInjected: 1", b"payload", "0" * 64, "response", None)
    fields, payload = W.decode_record(data)
    assert payload == b"payload" and "Injected" not in fields and fields["WARC-Type"] == "response"
    fields, payload = W.decode_record(W.encode_record(8, None, b"payload", "0" * 64, "revisit", 7))
    assert payload == b"" and fields["WARC-Refers-To"] == f"<{W.record_id(7, '0' * 64)}>" and fields["WARC-Target-URI"] == "about:blank"


def test_empty_table(spark):
    index = W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert W.payload_facts(W.read_records(index)).collect() == []


def test_a_range_is_unpacked_in_batches_of_bounded_size(tmp_path):
    """Payloads of 100 KB each that take up some hundred bytes in the archive."""
    import pyarrow as pa

    payloads = [bytes([65 + i]) * 100_000 for i in range(20)]
    digests = [hashlib.sha256(x).hexdigest() for x in payloads]
    members = [W.encode_record(i, "http://a/", x, d, "response", None) for i, (x, d) in enumerate(zip(payloads, digests, strict=True))]
    (tmp_path / "a.gz").write_bytes(b"".join(members))
    at, records = 0, []
    for i, (m, d) in enumerate(zip(members, digests, strict=True)):
        records.append({"offset": at, "length": len(m), "page_id": i, "url": "http://a/", "digest": d, "kind": "response", "refers_to": None})
        at += len(m)
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())])
    batches = list(W._read_range(f"{tmp_path}/a.gz", 0, at, records, kinds, 300_000))
    assert [b.num_rows for b in batches] == [3] * 6 + [2]
    assert [x for b in batches for x in b.column("payload").to_pylist()] == payloads
