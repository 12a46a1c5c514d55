"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample; every vector is indexed. A vector near a boundary is replicated to all lists
whose centroid is at most (1 + `replicate`) times as far as its nearest, `copies` at most. Centroids lie in memory as
a neighbour graph, which a best-first search walks for many vectors at once. A query reads the lists whose centroid
is at most (1 + `prune`) times as far as its nearest, `probes` at most, and more, in order of distance, until
they hold `enough` vectors. Lists are balanced by their number, which grows with the table, by a size penalty while
centroids are fitted, and by cutting each list into blocks of about `block` vectors; a task scores one block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.llm.common import col, filesystem, parent_made, work_dir, written

_graphs: dict[str, "CentroidGraph"] = {}


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


class CentroidGraph:
    """Each centroid's nearest `degree` and as many seeded far ones; search() is best-first with a beam."""

    def __init__(self, centroids: np.ndarray, *, degree: int = 16, far: int = 4, seed: int = 0):
        self.centroids, k = centroids, len(centroids)
        self.norm = (centroids * centroids).sum(1)
        self.small = k <= 2 * degree
        near = np.empty((k, min(degree, max(0, k - 1))), np.int64)
        for begin in range(0, k, 1024):
            d = squared(centroids[begin : begin + 1024], centroids)
            d[np.arange(len(d)), begin + np.arange(len(d))] = np.inf
            near[begin : begin + 1024] = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if near.shape[1] else near[begin : begin + 1024]
        random = np.random.default_rng(seed)
        self.links = np.concatenate([near, random.integers(0, k, (k, far))], axis=1)
        # a few entries, far apart by greedy choice
        chosen, least = [0], np.full(k, np.inf)
        for _ in range(min(k, 32) - 1):
            least = np.minimum(least, squared(centroids[chosen[-1:]], centroids)[0])
            chosen.append(int(least.argmax()))
        self.entries = np.array(chosen)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row of x the nearest centroids found, ascending: numbers and distances, `beam` columns at most."""
        k, n = len(self.centroids), len(x)
        beam = min(beam, k)
        if self.small:
            d = squared(x, self.centroids)
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            return order, np.sqrt(np.take_along_axis(d, order, 1))
        own = (x * x).sum(1)
        rows = np.arange(n)[:, None]

        def distance(ids):
            return np.maximum(own[:, None] + self.norm[ids] - 2 * np.einsum("nd,nmd->nm", x, self.centroids[ids]), 0)

        seen = np.zeros((n, k), bool)
        ids = np.broadcast_to(self.entries, (n, len(self.entries)))
        seen[:, self.entries] = True
        d, done = distance(ids), np.zeros(ids.shape, bool)
        width = max(beam, 8)
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            ids, d, done = (np.take_along_axis(z, order, 1) for z in (ids, d, done))
            fresh = ~done & np.isfinite(d)
            if not fresh.any():
                return ids[:, :beam], np.sqrt(d[:, :beam])
            first = fresh.argmax(1)
            active = fresh.any(1)
            done[active, first[active]] = True
            more = self.links[ids[np.arange(n), first]]
            new = ~seen[rows, more] & active[:, None]
            # a link list may name a centroid twice: the later mention goes
            ordered = np.sort(more, axis=1)
            if (ordered[:, 1:] == ordered[:, :-1]).any():
                rank = np.argsort(more, axis=1, kind="stable")
                same = np.zeros(more.shape, bool)
                s = np.take_along_axis(more, rank, 1)
                np.put_along_axis(same, rank[:, 1:], s[:, 1:] == s[:, :-1], 1)
                new &= ~same
            seen[np.broadcast_to(rows, more.shape)[new], more[new]] = True
            away = np.where(new, distance(more), np.inf)
            ids, d, done = np.concatenate([ids, more], 1), np.concatenate([d, away], 1), np.concatenate([done, ~new], 1)


def fit_centroids(sample: np.ndarray, k: int, *, rounds: int = 8, balance: float = 0.5, seed: int = 0) -> np.ndarray:
    """k-means on unit vectors; a centroid's distance is raised with its share, so crowded lists shed vectors."""
    random = np.random.default_rng(seed)
    k = min(k, len(np.unique(sample, axis=0)))
    centroids = sample[random.choice(len(sample), k, replace=False)].copy()
    load = np.zeros(k)
    for _ in range(rounds):
        sums, count = np.zeros_like(centroids), np.zeros(k)
        for begin in range(0, len(sample), 4096):
            x = sample[begin : begin + 4096]
            d = squared(x, centroids)
            own = (d + balance * d.min(1).mean() * load[None, :]).argmin(1)
            np.add.at(sums, own, x)
            count += np.bincount(own, minlength=k)
        load = np.maximum(0, count / max(1e-9, count.mean()) - 1)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], sample[random.choice(len(sample), k)])
    return centroids


def fit_lists(sample: np.ndarray, k: int, *, seed: int = 0) -> np.ndarray:
    """k centroids; many in two levels, a share of k for each coarse cell by its share of the sample, so that work grows as k^1.5."""
    if k <= 2048:
        return fit_centroids(sample, k, seed=seed)
    coarse = fit_centroids(sample, int(k**0.5), seed=seed)
    own = np.concatenate([squared(sample[b : b + 4096], coarse).argmin(1) for b in range(0, len(sample), 4096)])
    parts = [sample[own == c] for c in range(len(coarse))]
    return np.concatenate([fit_centroids(x, max(1, round(k * len(x) / len(sample))), seed=seed) for x in parts if len(x)])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`vec_id, v array<double>`: rows with an id whose vector isn't null, empty or zero and has finite components alone."""
    v = F.transform(col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of corresponding rows, the same for the same vectors wherever they stand; powers of two taken out keep squares in range."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) for x in (a, b))
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _graph(uri: str) -> CentroidGraph:
    if uri not in _graphs:
        _graphs.clear()
        fs, path = filesystem(uri)
        with fs.open_input_file(path) as f:
            _graphs[uri] = CentroidGraph(_load(f))
    return _graphs[uri]


def _load(f) -> np.ndarray:
    shape = np.frombuffer(f.read(16), np.int64)
    return np.frombuffer(f.read(), np.float64).reshape(shape)


def _scored(left, right, k: int):
    """The nearest k of a block of vectors for each query of a block, in double precision."""
    import pyarrow as pa

    out = [[], [], []]
    if left.num_rows and right.num_rows:
        qid, vid = (np.asarray(t.column(k).combine_chunks()) for t, k in ((left, "query_id"), (right, "vec_id")))
        q, v = (_matrix(t.column(k).combine_chunks()) for t, k in ((left, "q"), (right, "v")))
        uv = _unit(v)
        for begin in range(0, len(q), 256):
            s = _unit(q[begin : begin + 256]) @ uv.T
            s[qid[begin : begin + 256, None] == vid[None, :]] = -np.inf
            floor = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
            row, at = np.nonzero((s >= floor[:, None] - 1e-9) & np.isfinite(s))
            exact = cosine(q[begin + row], v[at])
            order = np.lexsort((vid[at], -exact, row))
            row, at, exact = row[order], at[order], exact[order]
            start = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.empty(0, bool)
            rank = np.arange(len(row)) - np.flatnonzero(start)[np.cumsum(start) - 1] if len(row) else row
            best = rank < k
            out[0].append(qid[begin + row[best]])
            out[1].append(vid[at[best]])
            out[2].append(exact[best])
    whole = [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64))]
    return pa.table({"query_id": whole[0], "vec_id": whole[1], "score": whole[2]})


def _best(found: DataFrame, k: int) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(rows: DataFrame, queries: "F.Column", n: int, k: int, block: int) -> DataFrame:
    """Every query against every vector: each block of queries meets each block of vectors in a task of its own."""
    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    blocks, parts = -(-n // block), max(1, -(-asked.count() // block))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = lambda key, m: F.pmod(F.xxhash64(key), F.lit(m)).cast("int")
    left = asked.select(every(blocks).alias("block"), own("query_id", parts).alias("part"), "query_id", "q")
    right = rows.select(own("vec_id", blocks).alias("block"), every(parts).alias("part"), "vec_id", "v")
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(lambda a, b: _scored(a, b, k), "query_id long, vec_id long, score double")
    return _best(found, k)


def search(vectors: DataFrame, queries: "F.Column", *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, list_size: int = 256, max_lists: int = 16_384, sample_rows: int = 20_000, sample_bytes: int = 64 << 20, exact: bool = False, copies: int = 4, replicate: float = 0.15, probes: int = 48, prune: float = 0.6, enough: int = 1024, block: int = 4096, seed: int = 0) -> DataFrame:
    """`query_id, rank, vec_id, score`: the nearest `k` by cosine found for each row that `queries` (over `vec_id`) marks.

    Rows whose vector is null, empty, zero or holds null, NaN or infinite components, or of another length than most,
    and rows without id take no part. Rows that repeat a vec_id count once, as the smallest vector. Fewer candidates than k give fewer rows; ties go to the
    smaller vec_id. Centroids come from the rows of smallest id hash, `sample_rows` of them or four a list, `sample_bytes` at most; there is one for
    `list_size` vectors, `max_lists` at most: beyond that (4 million vectors by default) lists grow and are cut into more blocks, and
    a query's cost grows with them. `exact` compares every query with every vector, block by block. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = written(rows, "ann-vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()  # one row
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    width, n = sizes[0]
    rows = rows.where(F.size("v") == width)
    wanted = max(1, min(max_lists, -(-n // list_size)))
    size_of = max(1, min(max(sample_rows, 4 * wanted), sample_bytes // (8 * width)))
    if exact:
        return _exact(rows, queries, n, k, block)
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id")).limit(size_of).select("v").toArrow()  # bounded
    sample = _unit(_matrix(drawn.column(0).combine_chunks()))
    centroids = fit_lists(sample, max(1, min(wanted, -(-len(sample) // 4))), seed=seed)
    fs, path = filesystem(graph_at := work_dir(spark, "ann-centroids"))
    parent_made(fs, path)
    with fs.open_output_stream(path, compression=None) as f:
        f.write(np.array(centroids.shape, np.int64).tobytes())
        f.write(np.ascontiguousarray(centroids).tobytes())

    def place(batches):
        import pyarrow as pa

        graph = _graph(graph_at)
        for b in batches:
            for begin in range(0, b.num_rows, 1024):
                some = b.slice(begin, 1024)
                ids, d = graph.search(_unit(_matrix(some.column(1))), max(copies, 8))
                ids, d = ids[:, :copies], d[:, :copies]
                row, at = np.nonzero(d <= d[:, :1] * (1 + replicate))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, at].astype(np.int32)), some.column(0).take(pa.array(row)), some.column(1).take(pa.array(row))], ["list", "vec_id", "v"])

    lists = written(rows.select("vec_id", "v").mapInArrow(place, "list int, vec_id long, v array<double>"), "ann-lists")
    counts = {r[0]: r[1] for r in lists.groupBy("list").count().collect()}  # max_lists numbers at most
    size = np.array([counts.get(c, 0) for c in range(len(centroids))])

    def probe(batches):
        import pyarrow as pa

        graph = _graph(graph_at)
        for b in batches:
            for begin in range(0, b.num_rows, 256):
                some = b.slice(begin, 256)
                ids, d = graph.search(_unit(_matrix(some.column(1))), probes)
                held = np.cumsum(size[ids], axis=1) - size[ids]
                row, at = np.nonzero((d <= d[:, :1] * (1 + prune)) | (held < enough))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, at].astype(np.int32)), some.column(0).take(pa.array(row)), some.column(1).take(pa.array(row))], ["list", "query_id", "q"])

    asked = written(rows.where(queries).select("vec_id", "v").mapInArrow(probe, "list int, query_id long, q array<double>"), "ann-probes")
    askers = {r[0]: r[1] for r in asked.groupBy("list").count().collect()}  # max_lists numbers at most
    # a task meets one block of a list with one block of the queries that read it
    blocks = spark.createDataFrame([(c, max(1, -(-int(size[c]) // block)), -(-n // block)) for c, n in askers.items()], "list int, blocks int, parts int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    asked = asked.join(F.broadcast(blocks), "list").select("list", every("blocks").alias("block"), own("query_id", "parts").alias("part"), "query_id", "q")
    stored = lists.join(F.broadcast(blocks), "list").select("list", own("vec_id", "blocks").alias("block"), every("parts").alias("part"), "vec_id", "v")

    found = asked.groupBy("list", "block", "part").cogroup(stored.groupBy("list", "block", "part")).applyInArrow(lambda left, right: _scored(left, right, k), "query_id long, vec_id long, score double")
    return _best(found, k)
