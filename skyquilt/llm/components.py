"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.llm.common import removed, written


def _print(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("a"), F.min("b")).first())


def components(links: DataFrame, name: str = "components", limit: int = 60) -> DataFrame:
    """`node, root` for every node of the links `a, b` (longs): root is the component's smallest node.

    Each step groups by node with partial minima and joins back, and the minima are a written table, so a node
    with many links is only a streamed side, which the adaptive skew join splits. Every round is a written table; only four numbers a round reach the driver.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = _print(links)
    for _ in range(limit):
        if not seen[0]:
            break
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, name)
        nearest = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(nearest, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        old, links = links, written(small, name)
        removed(old, least, large, nearest)  # the round's result no longer depends on them
        now = _print(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components didn't settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
