"""Shards on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `nodes` points of a ring of 2^64 places. A row hashes to a place and belongs to the next point
clockwise; all rows between two points form an arc. A shard has room for floor(n / shards) rows, one more in
the first n mod shards of them, which bounds every load by the mean: counts are at most one apart. What a full shard can't take
continues clockwise to the next point whose shard has room.

Arcs are what is planned: their row counts, `shards * nodes` numbers however large the table is, go to the driver, which
lets them flow round the ring and returns runs of rows of each arc (by place) with shard and first slot. Rows find
their run by rank within the arc. Only ids, sizes and checksums are shuffled, never texts.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.llm.common import col, written

MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def ring(shards: int, nodes: int, seed: int = 0) -> list[tuple[int, int]]:
    """Ascending (place as a signed long, shard); a shard's points don't depend on how many shards there are."""
    points = {}
    for s in range(shards):
        for v in range(nodes):
            points.setdefault(_mix(_mix(seed + 1) ^ (s << 32 | v)) - (1 << 63), s)
    return sorted(points.items())


def plan(points: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, end rank, shard, slot of the first rank) of a table with so many rows an arc.

    First each shard takes from its own arcs in ring order while it has room, then the rest of each arc, in the same order, moves on
    clockwise over shards with room.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot, runs, over = [0] * shards, [], deque()

    def put(arc: int, at: int, n: int, shard: int) -> int:
        take = min(n, room[shard])
        if take:
            runs.append((arc, at, at + take, shard, slot[shard]))
            room[shard] -= take
            slot[shard] += take
        return take

    for arc in range(len(points)):
        n = counts.get(arc, 0)
        took = put(arc, 0, n, points[arc][1])
        if took < n:
            over.append((arc, took, n - took))
    for arc, at, n in over:
        step = arc
        while n:
            step = (step + 1) % len(points)
            took = put(arc, at, n, points[step][1])
            at, n = at + took, n - took
    return runs


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, nodes: int = 256, seed: int = 0) -> DataFrame:
    """`<id_col>, size, text_crc32, shard, slot`: law `rows`, slots gapless from 0 in each shard.

    size is the text's UTF-8 bytes plus 1; null texts count as empty. The place is a hash of id, size and checksum, so
    rows that share an id, or have none, lie on many arcs. Rows equal in all three
    share what their ranks got in any order. An empty table gives no row; shards may be empty if rows are few.
    """
    spark, text = docs.sparkSession, F.coalesce(col(text_col).cast("string"), F.lit(""))
    points = ring(shards, nodes, seed)
    rows = docs.select(col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"))
    places = [p for p, _ in points]

    @F.pandas_udf("int")
    def arc_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(places), place.to_numpy(), "left") % len(places))

    place = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("null")), "size", "crc")
    found = written(rows.withColumn("place", place).withColumn("arc", arc_of("place")), "shard-rows")
    counts = {r[0]: r[1] for r in found.groupBy("arc").count().collect()}  # shards * nodes numbers at most
    runs = plan(points, counts, shards)
    runs = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "arc int, first long, last long, shard int, slot0 long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("place", "id", "size", "crc")).cast("long") - 1)
    joined = ranked.join(F.broadcast(runs.withColumnRenamed("arc", "run_arc")), (F.col("arc") == F.col("run_arc")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    return joined.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"))
