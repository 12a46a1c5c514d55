"""Order-preserving packing of token streams into windows by dynamic programming.

Each task packs the documents of its scan partition in their order there, so no text is shuffled. Cuts may lie
at document ends (free), at sentence ends and, in stretches without either, at regular places (both against a
penalty in tokens). With f(j) the least cost of packing up to cut j, a window (i, j] of n tokens costs its padding
W - n (none if n is a power of two) plus the penalty at j:

    f(j) = penalty(j) + W + window_cost - pos(j) + min over pos(i) >= pos(j) - W of f(i) + pos(i)

The minimum over the sliding range comes from a monotone queue; lengths that are powers of two are looked up.
Memory: the tokens of one chunk and of one document. The last window of a chunk is carried into the next chunk.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame

from skyquilt.llm.common import col
from skyquilt.llm.tokens import default_vocabulary, encoder, sentence_ends

CHUNK = 1 << 18


def cut_points(total: int, document_ends: np.ndarray, sentences: np.ndarray, *, sentence_penalty: int, hard_penalty: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut positions from 0 to total with their penalties; no two neighbours are over `stride` apart."""
    penalty = np.full(total + 1, -1, np.int32)
    penalty[sentences] = sentence_penalty
    penalty[document_ends] = 0
    penalty[0] = penalty[total] = 0
    at = np.flatnonzero(penalty >= 0)
    gaps = np.diff(at)
    if (wide := np.flatnonzero(gaps > stride)).size:
        more = np.concatenate([np.arange(at[k] + stride, at[k + 1], stride) for k in wide])
        penalty[more] = hard_penalty
        at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, *, window: int, window_cost: int) -> list[int]:
    """Indices into `at` of the cheapest chain of cuts from the first to the last."""
    total, n = int(at[-1]), len(at)
    index = np.full(total + 1, -1, np.int64)
    index[at] = np.arange(n)
    exact: dict[int, list[int]] = {}
    size = 1
    while size <= window:
        have = np.flatnonzero(at >= size)
        found = index[at[have] - size]
        for j, i in zip(have[found >= 0].tolist(), found[found >= 0].tolist()):
            exact.setdefault(j, []).append(i)
        size *= 2
    pos, pen = at.tolist(), penalty.tolist()
    cost, back = [0] * n, [0] * n
    queue = deque([(pos[0], 0)])  # (f(i) + pos(i), i), ascending in both
    none: tuple = ()
    for j in range(1, n):
        p = pos[j]
        low = p - window
        while pos[queue[0][1]] < low:
            queue.popleft()
        least, origin = queue[0]
        least += window - p
        for i in exact.get(j, none):
            if cost[i] < least:
                least, origin = cost[i], i
        cost[j] = least = least + pen[j] + window_cost
        back[j] = origin
        least += p
        while queue and queue[-1][0] >= least:
            queue.pop()
        queue.append((least, j))
    chain = [n - 1]
    while chain[-1]:
        chain.append(back[chain[-1]])
    return chain[::-1]


def tail_cuts(begin: int, end: int, *, window: int, window_cost: int, hard_penalty: int) -> list[int]:
    """The very last window, cut into powers of two where that costs less than its padding."""
    n = end - begin
    bits = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
    if len(bits) > 1 and (len(bits) - 1) * (hard_penalty + window_cost) < window - n:
        return (begin + np.cumsum(bits)).tolist()
    return [end]


class Packer:
    """add(key, ids) returns finished pieces, finish() the rest: (key, start, length, crc, tokens, sequence, offset, ids)."""

    def __init__(self, ends: np.ndarray, *, window: int = 2048, sentence_penalty: int = 8, hard_penalty: int = 32, window_cost: int = 2, chunk: int = CHUNK):
        self.ends, self.window, self.chunk = ends, window, chunk
        self.penalties = {"sentence_penalty": sentence_penalty, "hard_penalty": hard_penalty, "stride": max(1, window // 8)}
        self.costs = {"window": window, "window_cost": window_cost}
        self.open: list[tuple] = []  # (key, tokens of its document, ids before these, ids)
        self.held = self.sequence = 0

    def add(self, key, ids: np.ndarray) -> list[tuple]:
        self.open.append((key, len(ids), 0, ids))
        self.held += len(ids)
        return self._solve(last=False) if self.held >= self.chunk else []

    def finish(self) -> list[tuple]:
        return self._solve(last=True) if self.held else []

    def _solve(self, *, last: bool) -> list[tuple]:
        stream = np.concatenate([x[3] for x in self.open])
        limits = np.cumsum([len(x[3]) for x in self.open])
        sentences = np.flatnonzero(self.ends[np.minimum(stream, len(self.ends) - 1)]) + 1
        at, penalty = cut_points(len(stream), limits, sentences, **self.penalties)
        chain = at[best_cuts(at, penalty, **self.costs)].tolist()
        if last:
            chain = chain[:-1] + tail_cuts(chain[-2], chain[-1], **self.costs, hard_penalty=self.penalties["hard_penalty"])
        else:
            chain = chain[:-1]
        out = self._pieces(stream, limits, chain)
        begin = chain[-1]
        k = int(np.searchsorted(limits, begin, "right"))
        kept = []
        for (key, tokens, before, ids), limit in zip(self.open[k:], limits[k:].tolist()):
            skip = max(0, begin - (limit - len(ids)))
            kept.append((key, tokens, before + skip, ids[skip:]))
        self.open, self.held = kept, len(stream) - begin
        return out

    def _pieces(self, stream: np.ndarray, limits: np.ndarray, chain: list[int]) -> list[tuple]:
        out, doc, document_end = [], 0, limits.tolist()
        for a, b in zip(chain, chain[1:]):
            p = a
            while p < b:
                while document_end[doc] <= p:
                    doc += 1
                key, tokens, before, ids = self.open[doc]
                q = min(b, document_end[doc])
                piece = stream[p:q]
                out.append((key, before + p - (document_end[doc] - len(ids)), q - p, zlib.crc32(piece), tokens, self.sequence, p - a, piece))
                p = q
            self.sequence += 1
        return out


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, window: int = 2048, end_id: int = 1, sentence_penalty: int = 8, hard_penalty: int = 32, window_cost: int = 2, keep_ids: bool = False) -> DataFrame:
    """One row per piece: `<id_col>, start, length, ids_crc32, doc_tokens, sequence_id, offset` and, on request, `ids`.

    Null and empty texts are documents of the end id alone; a null id is carried as null; repeated rows are packed
    each for itself; other columns are ignored; an empty table gives no row. Texts of any length are cut as needed.
    A sequence's number holds the task's in its upper bits: unique, ascending in the order of packing.
    """
    path, schema = vocabulary or default_vocabulary(), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tokens, end = encoder(path), np.array([end_id], "<u4")
        packer = Packer(sentence_ends(path), window=window, sentence_penalty=sentence_penalty, hard_penalty=hard_penalty, window_cost=window_cost)
        first = TaskContext.get().partitionId() << 33
        types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * keep_ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(types)]

        def batch(pieces):
            columns = list(zip(*pieces))
            columns[5] = [first + s for s in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        held: list[tuple] = []
        for b in batches:
            keys = b.column(0).to_pylist()
            for key, text in zip(keys, b.column(1)):
                held += packer.add(key, np.concatenate([tokens.ids(text.as_py()), end]))
                if len(held) >= 4096:
                    yield batch(held)
                    held = []
        if held := held + packer.finish():
            yield batch(held)

    out = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("doc_id", id_col)
