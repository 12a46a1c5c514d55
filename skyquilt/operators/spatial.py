"""Bilinear regridding and Gaussian smoothing as neighbour joins on small coordinate tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.operators.core import coords
from skyquilt.operators.prep import fill_spatial_mean, reformat


def _brackets(source: DataFrame, axis: str, targets: list[float]) -> DataFrame:
    """`to, at, w, near`: for each target the one or two source coordinates around it with linear weights; targets outside clamp
    to the edge. near marks the closest of them, the lower one of two as close."""
    spark = source.sparkSession
    t = spark.createDataFrame([(float(x),) for x in sorted(set(targets))], "to double")
    own = source.agg(F.sort_array(F.collect_set(axis)).alias("s"))  # one row: the axis' coordinates
    x = F.greatest(F.element_at("s", 1), F.least(F.element_at("s", -1), F.col("to")))
    t = t.crossJoin(F.broadcast(own)).withColumn("x", x)
    low, high = F.array_max(F.filter("s", lambda c: c <= F.col("x"))), F.array_min(F.filter("s", lambda c: c >= F.col("x")))
    t = t.select("to", "x", low.alias("a"), high.alias("b"))
    share = F.when(F.col("a") == F.col("b"), 0.0).otherwise((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")))
    t = t.select("to", "a", "b", share.alias("r"))
    one = F.struct(F.col("a").alias("at"), (1 - F.col("r")).alias("w"), (F.col("r") <= 0.5).alias("near"))
    two = F.struct(F.col("b").alias("at"), F.col("r").alias("w"), (F.col("r") > 0.5).alias("near"))
    pairs = F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, two))
    return t.select("to", F.explode(pairs).alias("p")).select("to", "p.at", "p.w", "p.near")


def regrid(cube: DataFrame, lons: list[float], lats: list[float]) -> DataFrame:
    """Bilinear on the cube's grid, missing values filled by the field's mean first; NULL where the nearest cell is missing.

    A target grid equal to the source's gives the cube back.
    """
    have = coords(cube, "lat").agg(F.sort_array(F.collect_set("lat"))).first()[0], coords(cube, "lon").agg(F.sort_array(F.collect_set("lon"))).first()[0]
    if have == (sorted(set(map(float, lats))), sorted(set(map(float, lons)))):
        return cube
    filled = fill_spatial_mean(cube.withColumn("missing", F.col("value").isNull()))
    la = _brackets(cube, "lat", lats).toDF("to_lat", "lat", "wa", "na")
    lo = _brackets(cube, "lon", lons).toDF("to_lon", "lon", "wo", "no")
    joined = filled.join(F.broadcast(la), "lat").join(F.broadcast(lo), "lon")
    out = joined.groupBy(F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon"), "sample", "feature").agg(F.sum(F.col("value") * F.col("wa") * F.col("wo")).alias("v"), F.max(F.col("missing") & F.col("na") & F.col("no")).alias("gone"))
    return out.select("lat", "lon", "sample", "feature", F.when(~F.col("gone"), F.col("v")).alias("value"))


def match(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with wrapped longitudes, x on y's grid."""
    x, y = reformat(x), reformat(y)
    lats = [r[0] for r in coords(y, "lat").collect()]  # the axes of a grid
    lons = [r[0] for r in coords(y, "lon").collect()]
    return regrid(x, lons, lats), y


def weights(kernel: int = 3, sigma: float = 2.0) -> list[tuple[int, float]]:
    """Offsets and normalised Gaussian weights of one axis."""
    radius = int((kernel - 1) / 2 / sigma * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    return [(d, w / sum(raw)) for d, w in zip(range(-radius, radius + 1), raw)]


def _reflected(i, n):
    """Half-sample reflection: ... 1 0 | 0 1 ... n-1 | n-1 ..."""
    m = F.pmod(i, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def gaussian_smooth(cube: DataFrame, kernel: int = 3) -> DataFrame:
    """Gaussian of sigma 2 over kernel x kernel cells with reflected edges; missing cells take part with the field's mean and stay missing."""
    if not isinstance(kernel, int):
        raise TypeError("kernel is a whole number")
    spark = cube.sparkSession
    offsets = spark.createDataFrame(weights(kernel), "d int, w double")

    def neighbours(axis: str, to: str, weight: str) -> DataFrame:
        """Coordinate, the coordinate it contributes to, and the weight; one row a coordinate and offset."""
        ordered = coords(cube, axis).withColumn("i", F.row_number().over(Window.orderBy(axis)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
        pairs = ordered.select(F.col(axis).alias(to), "i", "n").crossJoin(F.broadcast(offsets)).withColumn("k", _reflected(F.col("i") + F.col("d"), F.col("n")))
        return pairs.groupBy(to, "k").agg(F.sum("w").alias(weight)).join(ordered.select(axis, F.col("i").alias("k")), "k").drop("k")

    filled = fill_spatial_mean(cube)
    joined = filled.join(F.broadcast(neighbours("lat", "to_lat", "wa")), "lat").join(F.broadcast(neighbours("lon", "to_lon", "wo")), "lon")
    smooth = joined.groupBy(F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon"), "sample", "feature").agg(F.sum(F.col("value") * F.col("wa") * F.col("wo")).alias("s"))
    return cube.join(smooth, ["lat", "lon", "sample", "feature"]).select("lat", "lon", "sample", "feature", F.when(F.col("value").isNotNull(), F.col("s")).alias("value"))
