import io
import struct

import pytest
import zstandard

from skyquilt.llm import warc
from skyquilt.llm.queries import op1_warc


def expected(rows, least=0):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= least:
            first[data] = min(first.get(data, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        other = first.get(data)
        kind = "response" if other is None or other == page else "revisit"
        out.append((page, len(data), warc.digest(data), kind, other if kind == "revisit" else None))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/1", "<p>same</p>"), (2, None, "<p>same</p>"), (5, "http://a/ b\n<c>", "<p>other é</p>"), (0, "http://a/0", None), (9, "http://a/9", ""), (3, "u", "<p>same</p>"), (None, "http://n", "<p>no id</p>"), (None, "http://n", "<p>same</p>"), (7, "http://x", "long " * 300_000), (7, "http://x", "long " * 300_000)]


def read(spark, table, **options):
    found = warc.read_archives(warc.write_archives(table, **options))
    return found


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert sorted(map(tuple, op1_warc(spark, sf).collect()), key=repr) == expected([(r.page_id, r.url, r.html) for r in pages.collect()])


@pytest.mark.parametrize("least", [0, 12])
def test_odd_rows(spark, least):
    table = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "'y' as sha", "'z' as first")
    found = read(spark, table, min_bytes=least)
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()]
    assert sorted(rows, key=repr) == expected(ROWS, least)
    payloads = {r.page_id: bytes(r.payload) for r in found.collect() if r.record_type == "response" and r.page_id is not None}
    assert payloads[5] == "<p>other é</p>".encode() and payloads[7] == b"long " * 300_000
    assert all(r.target_uri and " " not in r.target_uri and "\n" not in r.target_uri for r in found.collect())


def test_empty_table(spark):
    assert read(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def archive(*records, own=b""):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out)
    for r in records:
        writer.add(r)
    writer.close()
    return out.getvalue()


GOOD = warc.record("response", 1, "http://a", b"<p>x</p>", None)


def test_reads_what_it_should_and_names_faults():
    assert [n for *_, n in warc.records(io.BytesIO(archive(GOOD, GOOD)))] == [8, 8]
    revisit = warc.record("revisit", 2, "http://a", b"<p>x</p>", 1)
    (_, headers, payload, n), = warc.records(io.BytesIO(archive(revisit)))
    assert (payload, n, headers["warc-refers-to"]) == (b"", 8, "<urn:page:1>")
    for bad, why in (
        (GOOD.replace(b"WARC/1.1", b"WARC/9"), "no WARC record"),
        (GOOD.replace(b"WARC-Date", b"X-Date"), "WARC-Date"),
        (GOOD[:-5] + GOOD[-4:], "bytes of block"),
        (GOOD + b"more", "bytes of block"),
        (GOOD.replace(b"<p>x", b"<p>y"), "digest"),
        (GOOD.replace(b"Content-Length: 8\r", b"Content-Length: 9\r"), "HTTP header says"),
        (GOOD.replace(b"2024-01-01T", b"2024-01-01 "), "date"),
    ):
        with pytest.raises(ValueError, match=why):
            list(warc.records(io.BytesIO(archive(bad))))
    data = archive(GOOD)
    for damaged in (data[8:], data[:-3], data + b"junk", data[:6]):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(damaged)))


def test_dictionary_is_used_and_may_be_compressed():
    pages = [warc.record("response", k, "http://a", f"<html><body>{k}: the same words in many pages {k * 7}</body></html>".encode() * 3, None) for k in range(400)]
    data = archive(*pages)
    size = struct.unpack("<I", data[4:8])[0]
    assert size > 0
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(p)) for p in pages)
    assert len(data) - size < 0.8 * plain
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    again = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + data[8 + size :]
    assert [h["warc-record-id"] for _, h, _, _ in warc.records(io.BytesIO(again))] == [f"<urn:page:{k}>" for k in range(400)]
    with pytest.raises(ValueError, match="no dictionary"):
        list(warc.records(io.BytesIO(struct.pack("<II", warc.SKIPPABLE, 4) + b"abcd" + data[8 + size :])))


def test_revisits_are_held_against_what_they_refer_to(spark, tmp_path):
    def rows(*more):
        at = tmp_path / f"{len(more)}-{len(more[-1]) if more else 0}.warc.zst"
        at.write_bytes(archive(GOOD, warc.record("revisit", 2, "http://a", b"<p>x</p>", 1), *more))
        return warc.read_archives(spark.createDataFrame([(f"file://{at}",)], "path string"))

    assert warc.verified(rows()).count() == 2
    for bad in (warc.record("revisit", 3, "http://a", b"<p>y</p>", 1), warc.record("revisit", 3, "http://b/longer", b"<p>x</p>", 9)):
        with pytest.raises(ValueError, match="refers to page"):
            warc.verified(rows(bad))
