"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record.

`write_archives` turns pages into such archives, one per task; `read_archives` and `records` read any archive of
this kind. Reading validates: the skippable frame and its dictionary, that each frame holds exactly one record, the
version line, the mandatory headers, that Content-Length is the block's length and the end mark follows it, the
HTTP Content-Length of responses, and payload digests; `verified` holds revisits against what they refer to. A fault raises
ValueError with the record's place.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.llm.common import col, filesystem, parent_made, work_dir, written

SKIPPABLE, DICTIONARY, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response, or a revisit without payload whose HTTP header still names the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page if page is not None else 'none'}"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page if page is not None else 'none-' + uuid.uuid4().hex}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


class ArchiveWriter:
    """Trains a dictionary on its first records, within `sample_bytes`, then writes a frame per record."""

    def __init__(self, stream, *, level: int = 3, dictionary_bytes: int = 16 << 10, sample_bytes: int = 1 << 20):
        self.stream, self.level, self.dictionary_bytes, self.sample_bytes = stream, level, dictionary_bytes, sample_bytes
        self.held: list[bytes] = []
        self.size = self.records = 0
        self.compressor = None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.compressor:
            self.stream.write(self.compressor.compress(data))
            return
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.sample_bytes:
            self._begin()

    def _begin(self) -> None:
        import zstandard

        try:
            own = zstandard.train_dictionary(self.dictionary_bytes, [x[:8192] for x in self.held]).as_bytes()
        except zstandard.ZstdError:  # too few or too small samples: any bytes serve as raw content
            own = b""
        if own:
            self.stream.write(struct.pack("<II", SKIPPABLE, len(own)) + own)
            self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(own), write_checksum=True)
        else:
            self.stream.write(struct.pack("<II", SKIPPABLE, 0))
            self.compressor = zstandard.ZstdCompressor(level=self.level, write_checksum=True)
        held, self.held = self.held, []
        for x in held:
            self.stream.write(self.compressor.compress(x))

    def close(self) -> None:
        if not self.compressor:
            self._begin()


def dictionary(head: bytes, read) -> bytes:
    """The dictionary in the leading skippable frame, itself perhaps a Zstandard frame; empty if the frame is empty."""
    import zstandard

    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary's skippable frame")
    size = struct.unpack("<I", head[4:8])[0]
    data = read(size)
    if len(data) != size:
        raise ValueError("the dictionary's frame is cut short")
    if size >= 4 and struct.unpack("<I", data[:4])[0] == FRAME:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if data and (len(data) < 4 or struct.unpack("<I", data[:4])[0] != DICTIONARY):
        raise ValueError("the skippable frame holds no dictionary")
    return data


def frames(file, chunk: int = 1 << 20):
    """(place, content) of each frame after the dictionary; reads `chunk` bytes at a time, holds one record."""
    import zstandard

    own = dictionary(file.read(8), file.read)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own)) if own else zstandard.ZstdDecompressor()
    at, rest = file.tell(), b""
    while rest or (rest := file.read(chunk)):
        one, parts, used = decompressor.decompressobj(), [], 0
        while True:
            try:
                parts.append(one.decompress(rest))
            except zstandard.ZstdError as e:
                raise ValueError(f"no sound frame at byte {at}: {e}") from e
            if one.eof:
                used += len(rest) - len(one.unused_data)
                rest = one.unused_data
                break
            used += len(rest)
            if not (rest := file.read(chunk)):
                raise ValueError(f"the frame at byte {at} is cut short")
        yield at, b"".join(parts)
        at += used


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes]:
    """Headers and block of the one record in a frame, validated."""
    head, mark, rest = data.partition(END)
    lines = head.decode("utf-8", "strict").split("\r\n")
    if not mark or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError(f"no WARC record at byte {at}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line in the record at byte {at}: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in MANDATORY:
        if not headers.get(name.lower()):
            raise ValueError(f"the record at byte {at} has no {name}")
    if not re.fullmatch(r"\d+", headers["content-length"]) or rest[int(headers["content-length"]) :] != END:
        raise ValueError(f"the record at byte {at} has {max(0, len(rest) - 4)} bytes of block, its header says {headers['content-length']}")
    if not re.fullmatch(r"<\S+>", headers["warc-record-id"]) or not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z", headers["warc-date"]):
        raise ValueError(f"bad id or date in the record at byte {at}")
    return headers, rest[:-4]


def content(headers: dict[str, str], block: bytes, at: int = 0) -> tuple[bytes, int]:
    """HTTP payload of a response (empty for a revisit) and the payload's length; the digest is verified."""
    http, mark, payload = block.partition(END)
    length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\s*(?:\r\n|$)", http)
    n = int(length[1]) if length else len(payload)
    if not mark or not http.startswith(b"HTTP/"):
        raise ValueError(f"the record at byte {at} holds no HTTP message")
    if headers["warc-type"] == "revisit":
        if payload or not headers.get("warc-refers-to"):
            raise ValueError(f"the revisit at byte {at} has a payload, or refers to nothing")
    elif n != len(payload):
        raise ValueError(f"the response at byte {at} has {len(payload)} bytes of payload, its HTTP header says {n}")
    elif (said := headers.get("warc-payload-digest", "")).startswith("sha1:") and said != f"sha1:{digest(payload)}":
        raise ValueError(f"the payload at byte {at} doesn't have its digest")
    return payload, n


def records(file):
    """(place, headers, payload, payload length) of each record of an open archive."""
    for at, data in frames(file):
        headers, block = parse(data, at)
        payload, n = content(headers, block, at)
        yield at, headers, payload, n


def _urn(text: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, level: int = 3, to: str | None = None) -> DataFrame:
    """Writes every row as a record; returns the manifest: `path string, n_records long`.

    Of records with equal payloads of at least `min_bytes` bytes that with the smallest id is a response and the others
    revisit it; rows that share that id are all responses. Rows with a null id are responses unless an equal payload
    has an id. Null payloads are empty ones, null URLs become `urn:page:<id>`; extra columns are ignored; an
    empty table has no archive. Only ids and digests are grouped, with partial aggregation; each payload is shuffled once, and
    a payload that many rows share is split between tasks by the adaptive skew join. Files as in `pfor.write_ids`.
    """
    spark = pages.sparkSession
    to = to or work_dir(spark, "warc")
    payload = F.coalesce(col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(col(id_col).cast("long").alias("id"), col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha"), F.xxhash64("payload").alias("xx"))
    first = rows.groupBy("sha", "xx", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where(f"copies > 1 and first is not null and n >= {int(min_bytes)}").drop("copies")
    first = written(first, "warc-first")  # a table of its own, so that the join may be broadcast or split by size
    marked = rows.join(first, ["sha", "xx", "n"], "left").select("id", "url", "payload", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs = writer = None
        for b in batches:
            ids, urls, refers = (b.column(k).to_pylist() for k in (0, 1, 3))
            for page, url, payload, other in zip(ids, urls, b.column(2), refers):
                if writer is None:
                    fs, at = filesystem(f"{to}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst")
                    parent_made(fs, at)
                    out = fs.open_output_stream(at, compression=None)
                    writer = ArchiveWriter(out, level=level)
                writer.add(record("response" if other is None else "revisit", page, url, payload.as_buffer().to_pybytes(), other))
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{to}/{at.rpartition('/')[2]}"], "n_records": [writer.records]})

    return written(marked.mapInArrow(run, "path string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame, *, path_col: str = "path", keep_payload: bool = True) -> DataFrame:
    """A row per record of the archives named in `path_col`, one task per archive.

    Columns: `path, place, record_type, record_id, target_uri, date, page_id, refers_to, payload_bytes, payload_digest, headers`
    and `payload`. page_id and refers_to are numbers where the ids are `<urn:page:N>`, else null; the two payload columns are of the
    full payload, for revisits too.
    """
    schema = "path string, place long, record_type string, record_id string, target_uri string, date string, page_id long, refers_to long, payload_bytes long, payload_digest string, headers map<string,string>" + ", payload binary" * keep_payload

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())] + [pa.binary()] * keep_payload
        names = [x.split()[0] for x in schema.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = filesystem(path)
                with fs.open_input_file(at) as file:
                    rows, held = [], 0
                    for place, h, payload, n in records(file):
                        said = h.get("warc-payload-digest", "").removeprefix("sha1:") or digest(payload)
                        rows.append((path, place, h["warc-type"], h["warc-record-id"], h.get("warc-target-uri"), h["warc-date"], _urn(h["warc-record-id"]), _urn(h.get("warc-refers-to")), n, said, list(h.items())) + (payload,) * keep_payload)
                        held += len(payload) * keep_payload
                        if len(rows) >= 2048 or held > 16 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return manifest.select(col(path_col)).repartition(max(1, manifest.count())).mapInArrow(run, schema)


def verified(records: DataFrame) -> DataFrame:
    """The rows of read_archives() as a written table, every revisit of which refers to a response of its digest and length.

    Each kind of revisit is compared once, so a payload that many records revisit is no hot key; a dangling or wrong one raises.
    """
    records = written(records, "warc-records")
    revisits = records.where("record_type = 'revisit'").groupBy(F.col("refers_to").alias("to"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("bytes")).agg(F.min(F.struct("path", "place")).alias("at"))
    responses = records.where("record_type = 'response'").select("page_id", "payload_digest", "payload_bytes")
    same = (F.col("to") == F.col("page_id")) & (F.col("digest") == F.col("payload_digest")) & (F.col("bytes") == F.col("payload_bytes"))
    if bad := revisits.join(responses, same, "left_anti").select("at.path", "at.place", "to").first():
        raise ValueError(f"the revisit at byte {bad.place} of {bad.path} refers to page {bad.to}, of which there is no response with its digest and length")
    return records
