"""Token ids in files of patched frame-of-reference blocks, in ascending document order.

A file holds, little-endian: the magic `SQPFOR1\n`; blocks of 256 ids; the index, one uint64 for each block's
start and one for the end of the blocks; document ids (int64, one byte each for null before them); ids per document
(uint64); a footer (numbers of blocks, documents and ids, start of the index, as uint64) and the magic again.
A block: its minimum (uint32), width w (uint8), number of exceptions (uint16), 256 differences from the minimum in w bits each,
most significant bit first, then the exceptions' places (uint8 each) and their differences without the lower w bits
(uint32 each). w is the width that a given share of the block's differences fits into. The index makes any block, and
so any document, readable alone. A short last block repeats its last id.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.llm.common import col, filesystem, parent_made, work_dir, written
from skyquilt.llm.tokens import default_vocabulary, encoder

MAGIC, BLOCK, HEAD = b"SQPFOR1\n", 256, 7
_LENGTH = np.array([0] + [k.bit_length() for k in range(1, 1 << 16)], np.uint8)


def _bit_length(x: np.ndarray) -> np.ndarray:
    high = x >> 16
    return np.where(high > 0, 16 + _LENGTH[high & 0xFFFF], _LENGTH[x & 0xFFFF]).astype(np.uint8)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then the same for the next."""
    first = np.cumsum(count) - count
    return np.repeat(start - first, count) + np.arange(int(count.sum()))


def encode_blocks(ids: np.ndarray, percentile: float) -> tuple[bytes, np.ndarray]:
    """Blocks of ids, whose number is a multiple of BLOCK; the bytes, and each block's start among them."""
    rows = ids.reshape(-1, BLOCK)
    least = rows.min(1)
    diff = (rows - least[:, None]).astype(np.uint32)
    bits = _bit_length(diff)
    rank = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = np.partition(bits, rank, axis=1)[:, rank]
    outlier = bits > width[:, None]
    exceptions = outlier.sum(1)
    size = HEAD + width.astype(np.int64) * (BLOCK // 8) + exceptions * 5
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[start[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[start + 4] = width
    out[start[:, None] + np.arange(5, 7)] = exceptions.astype("<u2").view(np.uint8).reshape(-1, 2)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        cell, kind = (16, ">u2") if w <= 16 else (32, ">u4")
        low = (diff[at] & np.uint32((1 << w) - 1)).astype(kind)
        plane = np.unpackbits(low.view(np.uint8).reshape(len(at), BLOCK, cell // 8), axis=2)[:, :, cell - w :]
        out[start[at][:, None] + HEAD + np.arange(w * BLOCK // 8)] = np.packbits(plane.reshape(len(at), -1), axis=1)
    if exceptions.any():
        block, place = np.nonzero(outlier)
        begin = start + HEAD + width.astype(np.int64) * (BLOCK // 8)
        out[_spread(begin, exceptions)] = place
        high = (diff[block, place] >> width[block]).astype("<u4")
        out[_spread(begin + exceptions, exceptions * 4)] = high.view(np.uint8)
    return out.tobytes(), start


def decode_blocks(data: bytes, start: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at these places of `data`."""
    raw = np.frombuffer(data, np.uint8)
    start = start.astype(np.int64)
    least = raw[start[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width = raw[start + 4]
    exceptions = raw[start[:, None] + np.arange(5, 7)].copy().view("<u2")[:, 0].astype(np.int64)
    diff = np.zeros((len(start), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        cell, kind = (16, ">u2") if w <= 16 else (32, ">u4")
        plane = np.zeros((len(at), BLOCK, cell), np.uint8)
        packed = raw[start[at][:, None] + HEAD + np.arange(w * BLOCK // 8)]
        plane[:, :, cell - w :] = np.unpackbits(packed, axis=1).reshape(len(at), BLOCK, w)
        diff[at] = np.packbits(plane.reshape(len(at), -1), axis=1).view(kind)
    if exceptions.any():
        begin = start + HEAD + width.astype(np.int64) * (BLOCK // 8)
        block = np.repeat(np.arange(len(start)), exceptions)
        place = raw[_spread(begin, exceptions)]
        high = raw[_spread(begin + exceptions, exceptions * 4)].copy().view("<u4")
        diff[block, place] |= high << width[block].astype(np.uint32)
    return (diff + least[:, None]).ravel()


class Writer:
    """Streams documents into one file; holds the ids of one chunk."""

    def __init__(self, stream, percentile: float = 0.9, chunk: int = 4096 * BLOCK):
        self.stream, self.percentile, self.chunk = stream, percentile, chunk
        self.at, self.total, self.held = len(MAGIC), 0, 0
        self.parts: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        stream.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.counts.append(len(ids))
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.chunk:
            self._flush(last=False)

    def _flush(self, *, last: bool) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, "<u4")
        whole = len(ids) // BLOCK * BLOCK
        rest = ids[whole:]
        if last and len(rest):
            ids, whole, rest = np.concatenate([ids, np.full(BLOCK - len(rest), ids[-1], "<u4")]), whole + BLOCK, rest[:0]
        for begin in range(0, whole, self.chunk):
            data, start = encode_blocks(ids[begin : min(whole, begin + self.chunk)], self.percentile)
            self.stream.write(data)
            self.starts.append(start + self.at)
            self.at += len(data)
        self.parts, self.held = [rest], len(rest)

    def close(self) -> None:
        self._flush(last=True)
        starts = np.concatenate([*self.starts, [self.at]]).astype("<u8")
        for x in (starts, np.array([d is None for d in self.docs], np.uint8), np.array([d or 0 for d in self.docs], "<i8"), np.array(self.counts, "<u8"), np.array([len(starts) - 1, len(self.docs), self.total, self.at], "<u8")):
            self.stream.write(x.tobytes())
        self.stream.write(MAGIC)


class Reader:
    """Random access: docs, counts, and the ids of any range; `file` needs seek and read."""

    def __init__(self, file, size: int):
        self.file = file
        if self._at(0, 8) != MAGIC or self._at(size - 8, 8) != MAGIC:
            raise ValueError("not a whole file of token ids")
        blocks, docs, self.total, index = np.frombuffer(self._at(size - 40, 32), "<u8").astype(np.int64).tolist()
        if index + 8 * (blocks + 1) + 17 * docs + 40 != size or blocks != -(-self.total // BLOCK):
            raise ValueError("the file's parts don't have the sizes that its footer names")
        self.starts = np.frombuffer(self._at(index, 8 * (blocks + 1)), "<u8").astype(np.int64)
        rest = self._at(index + 8 * (blocks + 1), 17 * docs)
        self.null = np.frombuffer(rest[:docs], np.uint8)
        self.docs = np.frombuffer(rest[docs : 9 * docs], "<i8")
        self.counts = np.frombuffer(rest[9 * docs :], "<u8").astype(np.int64)
        if int(self.counts.sum()) != self.total:
            raise ValueError("documents and ids differ in number")

    def _at(self, begin: int, n: int) -> bytes:
        self.file.seek(begin)
        return self.file.read(n)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin to end of the file, from the blocks that hold them alone."""
        if begin >= end:
            return np.empty(0, "<u4")
        a, b = begin // BLOCK, -(-end // BLOCK)
        origin = self.starts[a]
        data = self._at(int(origin), int(self.starts[b] - origin))
        return decode_blocks(data, self.starts[a:b] - origin)[begin - a * BLOCK : end - a * BLOCK].astype("<u4")

    def documents(self, chunk: int = 4096 * BLOCK):
        """(doc id, ids before it, ids) of each document in turn; decodes about `chunk` ids at once."""
        ends = np.cumsum(self.counts)
        k = 0
        while k < len(ends):
            begin = int(ends[k] - self.counts[k])
            upto = max(k + 1, int(np.searchsorted(ends, begin + chunk, "right")))
            ids = self.ids(begin, int(ends[upto - 1]))
            for i in range(k, upto):
                a = int(ends[i] - self.counts[i]) - begin
                yield (None if self.null[i] else int(self.docs[i])), begin + a, ids[a : a + int(self.counts[i])]
            k = upto


def write_ids(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, percentile: float = 0.9, to: str | None = None) -> DataFrame:
    """Writes the files; returns their manifest: `shard int, path string, n_docs long, n_tokens long`, shards in document order.

    Documents are range-partitioned and sorted by id (nulls first; equal ids by text hash, then as they were read, so many rows of
    one id are cut into several files as well), encoded and written by the tasks. A task writes under a name of its own and only what a successful task reports is in the manifest,
    so retries and lost executors leave no half file in it. Null and empty texts have the end id alone.
    """
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    to = to or work_dir(spark, "token-ids")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, end, tokens = TaskContext.get().partitionId(), np.array([end_id], "<u4"), encoder(path)
        fs = writer = None
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                if writer is None:
                    fs, at = filesystem(f"{to}/{shard:06d}-{uuid.uuid4().hex}.pfor")
                    parent_made(fs, at)
                    out = fs.open_output_stream(at, compression=None)
                    writer = Writer(out, percentile)
                writer.add(doc, np.concatenate([tokens.ids(text.as_py()), end]))
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{to}/{at.rpartition('/')[2]}", "n_docs": len(writer.docs), "n_tokens": writer.total}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    order = ("doc_id", "hash", "read")
    ordered = ordered.withColumn("hash", F.xxhash64("text")).withColumn("read", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(ordered.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long"), "token-id-manifest")


def read_ids(manifest: DataFrame, *, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Reads the files of a manifest: `<id_col>, start, n_tokens, ids_crc32` and, on request, `ids`; one task per file."""
    files = manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens"))  # one row a file

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids)
        for b in batches:
            for at, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = filesystem(at)
                with fs.open_input_file(path) as file:
                    rows = []
                    for doc, before, ids in Reader(file, file.size()).documents():
                        rows.append((doc, base + before, len(ids), zlib.crc32(ids)) + (ids,) * keep_ids)
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    n = max(1, manifest.count())
    out = files.select("path", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))
    return out.withColumnRenamed("doc_id", id_col)
