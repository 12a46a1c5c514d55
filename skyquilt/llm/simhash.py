"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Fingerprints of 64 bits are 8 positional bytes. Two that differ in at most `distance` = d bits share at least
m = 8 - d positional bytes: the guaranteed minimum of matches. Postings of one positional byte would hold 1/256 of
all fingerprints each; the index therefore has postings of `together` positions with their bytes, chosen so that every m
positions contain one of them: each pair with m matches meets in one list at least. For every pair that meets, the shared
positional bytes are tallied, pairs below the guaranteed minimum are dropped, and the differing bits of the others are counted.

For d = 4, 20 postings of three bytes a fingerprint suffice (each four of eight positions contain one of the 20 triples); beyond 13
million distinct fingerprints it is 70 postings of four bytes, so that chance meetings stay below eight a fingerprint up to 10^9.

Equal fingerprints are one entry. Lists above `block` entries are cut by hash into blocks and each two blocks
meet in a task of their own, so a task holds about 2 * `block` fingerprints however long a list is; it emits a spanning
forest of the links that it found, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.llm.common import col, written
from skyquilt.llm.components import components

SEED = 42


def fingerprint(text: str | None, width: int = 4) -> int:
    """A-Z in lower case; words apart by ASCII white space; shingles of `width` words with repeats; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(width))))), "<u8", len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[begin : begin + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """`doc_id, fp`: fp is the fingerprint's 64 bits as a signed long."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def similar(diff: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs with these differing bits are links: the tally of shared positional bytes filters, then bits are counted."""
    tally = np.zeros(diff.shape, np.int8)
    for k in range(8):
        tally += (diff >> np.uint64(8 * k)) & np.uint64(255) == 0
    out = tally >= 8 - distance
    out[out] = np.bitwise_count(diff[out]) <= distance
    return out


def forest(x: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest, as index pairs, of the links between the entries of one task."""
    near = similar(x[:, None] ^ x[None, :], distance)
    fresh, out = np.ones(len(x), bool), []
    for root in range(len(x)):
        if not fresh[root]:
            continue
        fresh[root] = False
        stack = [root]
        while stack:
            node = stack.pop()
            found = np.flatnonzero(near[node] & fresh)
            fresh[found] = False
            found = found.tolist()
            out += [(node, k) for k in found]
            stack += found
    return out


def _links(batches, distance: int):
    """Arrow batches of (key, i, j, fp), in which each task's rows follow one another, to links."""
    import pyarrow as pa

    def solve(task: np.ndarray, fp: np.ndarray):
        edge = np.flatnonzero(np.any(task[1:] != task[:-1], axis=1)) + 1
        begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
        size = end - begin
        two = begin[size == 2]
        two = two[similar(fp[two] ^ fp[two + 1], distance)]
        a, b = [fp[two]], [fp[two + 1]]
        for s, e in zip(begin[size > 2].tolist(), end[size > 2].tolist()):
            if pairs := forest(fp[s:e], distance):
                p = np.array(pairs)
                a.append(fp[s:e][p[:, 0]])
                b.append(fp[s:e][p[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (a, b)], ["a", "b"])

    task, fp = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
    for batch in batches:
        task = np.concatenate([task, np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)], axis=1)])
        fp = np.concatenate([fp, np.asarray(batch.column(3)).view(np.uint64)])
        last = np.flatnonzero(np.any(task != task[-1:], axis=1)) if len(task) else task
        if len(last):
            cut = int(last[-1]) + 1
            yield solve(task[:cut], fp[:cut])
            task, fp = task[cut:], fp[cut:]
    if len(fp):
        yield solve(task, fp)


def postings(matches: int, together: int) -> list[tuple[int, ...]]:
    """Sets of `together` of the 8 positions, such that each set of `matches` positions contains one; greedily few."""
    open_ = {frozenset(c) for c in combinations(range(8), matches)}
    if together == matches:
        return list(combinations(range(8), matches))
    if (matches, together) == (4, 3):  # Turan's 20 triples over the groups 012, 345, 67
        group = [0, 0, 0, 1, 1, 1, 2, 2]
        shape = lambda c: sorted(group[k] for k in c)
        return [c for c in combinations(range(8), 3) if shape(c) in ([0, 0, 0], [1, 1, 1], [0, 0, 1], [1, 1, 2], [0, 2, 2])]
    chosen = []
    while open_:
        best = max(combinations(range(8), together), key=lambda c: sum(o.issuperset(c) for o in open_))
        chosen.append(best)
        open_ = {o for o in open_ if not o.issuperset(best)}
    return chosen


def bytes_together(matches: int, n: int, meetings: float = 8.0) -> int:
    """One positional byte fewer than must match, as long as an entry of n random ones meets at most so many others; else as many."""
    fewer = max(1, matches - 1)
    return fewer if len(postings(matches, fewer)) * n / 2 / 256**fewer <= meetings else matches


def links(entries: DataFrame, *, distance: int = 4, block: int = 2048, together: int | None = None) -> DataFrame:
    """Links `a, b` between the distinct fingerprints `fp` that connect all pairs within `distance` bits (7 at most)."""
    matches = 8 - distance
    n = entries.count()
    together = together or bytes_together(matches, n)
    byte = [F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255)) for k in range(8)]
    keys = []
    for i, positions in enumerate(postings(matches, together)):
        key = F.lit(i).cast("long")
        if together <= 6:
            for k in positions:
                key = F.shiftleft(key, 8).bitwiseOR(byte[k])
        else:
            key = F.xxhash64(key, *(byte[k] for k in positions))
        keys.append(key)
    # entries take few bytes and make many postings: spread first, about a million postings a task
    entries = entries.select("fp").repartition(max(8, n * len(keys) // 1_000_000), "fp")
    listed = entries.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("list"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    # Spark takes exploded rows for as few as the entries and would broadcast all postings from the driver, so the join is named;
    # a list that many entries share is a skewed side of it, which the adaptive join splits
    listed = listed.hint("merge").join(sizes, F.col("key") == F.col("list")).select("key", "fp", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("at"))
    tasks = listed.select("key", "fp", "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "fp")
    return tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lambda it: _links(it, distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """`<id_col>, fp, component_id`, a row per row of `docs`; component_id is the smallest id reachable over links.

    Null and empty texts have fingerprint zero, linked like any other. Rows with a null id take part and get their
    component's smallest id that isn't null (null if there is none). Repeated rows stay. No document is capped or dropped.
    """
    marked = written(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    entries = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-entries")
    roots = components(links(entries.select("fp"), distance=distance), "fingerprint-links")
    joined = entries.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = written(joined, "fingerprint-roots")
    smallest = written(joined.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    named = written(joined.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "fingerprint-components")
    return marked.join(named, "fp").select(F.col("doc_id").alias(id_col), "fp", "component_id")


def hexadecimal(fp) -> "F.Column":
    """16 lower-case digits of a signed long's 64 bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """The rows of `docs` whose id is their component's smallest, all columns kept; of such rows with one id one a component stays.

    Rows with a null id stay, as nothing says which of them is which.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, width=width, distance=distance)
    # lists of ids as tables of known size: Spark broadcasts them while they are small, and no text is shuffled
    gone = written(found.where(col(id_col) > F.col("component_id")).select(col(id_col).alias("__sq_gone")).distinct(), "near-copies")
    repeated = written(docs.select(col(id_col).alias("__sq_again")).where("__sq_again is not null").groupBy("__sq_again").count().where("count > 1").select("__sq_again"), "repeated-ids")
    # texts of one id may differ, so each of its rows goes or stays by its own fingerprint
    apart = found.join(repeated, col(id_col) == F.col("__sq_again")).where(col(id_col) == F.col("component_id"))
    apart = written(apart.select(col(id_col).alias("__sq_id"), F.col("fp").alias("__sq_stays")).distinct(), "repeated-ids-fingerprints")
    names, own = [col(c) for c in docs.columns], col(id_col)

    @F.pandas_udf("long")
    def print_of(texts):
        import pandas as pd

        return pd.Series(np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64))

    single = docs.join(gone, own == F.col("__sq_gone"), "left_anti").join(repeated, own == F.col("__sq_again"), "left_anti")
    several = docs.join(repeated, own == F.col("__sq_again"), "left_semi").withColumn("__sq_fp", print_of(col(text_col).cast("string")))
    several = several.join(apart, (own == F.col("__sq_id")) & (F.col("__sq_fp") == F.col("__sq_stays")))
    # rows of one id that stay are all of the component named after it
    order = Window.partitionBy(own).orderBy(F.xxhash64(*names))
    one = several.withColumn("__sq_r", F.row_number().over(order)).where("__sq_r = 1").select(*names)
    return single.unionAll(one)
