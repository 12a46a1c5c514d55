"""Label and position selection, reshaping and joining of cubes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.operators.core import AXES, dense


def crop(cube: DataFrame, **bounds: tuple) -> DataFrame:
    """Labels within [low, high], both ends included; plain comparisons, which reach the Parquet scan."""
    for axis, (low, high) in bounds.items():
        cube = cube.where(F.col(axis).between(low, high))
    return cube


def nearest(cube: DataFrame, axis: str, labels: list[float]) -> DataFrame:
    """The cube at the coordinate of `axis` nearest to each label, the smaller of two as near; the label replaces it."""
    own = cube.select(axis).distinct()
    wanted = cube.sparkSession.createDataFrame([(float(x),) for x in labels], "to double")
    best = own.crossJoin(F.broadcast(wanted)).groupBy("to").agg(F.min(F.struct(F.abs(F.col(axis) - F.col("to")).alias("d"), F.col(axis).alias("at"))).alias("b")).select("to", F.col("b.at").alias(axis))
    return cube.join(F.broadcast(best), axis).drop(axis).withColumnRenamed("to", axis).select(*cube.columns)


def at_positions(cube: DataFrame, axis: str, *positions: int) -> DataFrame:
    """By dense position on the axis, from 0; negative ones count from its end."""
    own = cube.select(axis).distinct().withColumn("i", F.row_number().over(Window.orderBy(axis)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    picked = own.where(F.col("i").isin(list(positions)) | (F.col("i") - F.col("n")).isin(list(positions)))
    return cube.join(F.broadcast(picked.select(axis)), axis, "left_semi")


def where(cube: DataFrame, condition: Column, other: float | None = None) -> DataFrame:
    """The value where the condition holds, else `other`; an unknown condition doesn't hold."""
    return cube.withColumn("value", F.when(condition, F.col("value")).otherwise(F.lit(other).cast("double")))


def expand(cube: DataFrame, axis: str, label) -> DataFrame:
    return cube.withColumn(axis, F.lit(label))


def relabel(cube: DataFrame, axis: str, labels: dict) -> DataFrame:
    """New labels of an axis; those without one stay."""
    mapped = reduce(lambda c, kv: c.when(F.col(axis) == F.lit(kv[0]), F.lit(kv[1])), labels.items(), F.when(F.lit(False), F.col(axis)))
    return cube.withColumn(axis, mapped.otherwise(F.col(axis)))


def unstack(cube: DataFrame, axis: str, labels: list) -> DataFrame:
    """Wide form: a column per label of the axis."""
    return cube.groupBy(*(a for a in AXES if a != axis)).pivot(axis, labels).agg(F.first("value"))


def stack(wide: DataFrame, axis: str, labels: list) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(x).alias("l"), F.col(f"`{x}`").alias("v")) for x in labels)))
    keys = [a for a in AXES if a != axis]
    return wide.select(*keys, pairs.alias("x")).select(*keys, F.col("x.l").alias(axis), F.col("x.v").alias("value"))


def drop_incomplete_points(cube: DataFrame) -> DataFrame:
    """Without points (lat, lon, feature) that lack any sample."""
    whole = cube.groupBy("lat", "lon", "feature").agg(F.count("value").alias("n"), F.count(F.lit(1)).alias("m")).where("n = m").select("lat", "lon", "feature")
    return cube.join(whole, ["lat", "lon", "feature"], "left_semi")


def reindex(cube: DataFrame, like: DataFrame) -> DataFrame:
    """On the coordinates of `like`, NULL where the cube has none."""
    return like.select(*AXES).distinct().join(cube, list(AXES), "left").select(*AXES, "value")


def combine(a: DataFrame, b: DataFrame, expression: Column, on: tuple[str, ...]) -> DataFrame:
    """Elementwise arithmetic of columns `a` and `b` over shared labels; axes that b lacks are broadcast."""
    return a.withColumnRenamed("value", "a").join(b.select(*on, F.col("value").alias("b")), list(on)).withColumn("value", expression).drop("a", "b")


def apply_mask(cube: DataFrame, mask: DataFrame) -> DataFrame:
    """The cube times a field of the same cells."""
    return combine(cube, mask, F.col("a") * F.col("b"), ("lat", "lon"))


def merge(on: tuple[str, ...] = ("lat", "lon"), **fields: DataFrame) -> DataFrame:
    """Fields as columns of one table: full outer join on their keys."""
    named = [f.select(*on, F.col("value").alias(n)) for n, f in fields.items()]
    return reduce(lambda a, b: a.join(b, list(on), "full_outer"), named)


def concat(axis: str, **cubes: DataFrame) -> DataFrame:
    """Union of cubes, the axis labelled by name."""
    return reduce(lambda a, b: a.unionByName(b), (c.withColumn(axis, F.lit(n)) for n, c in cubes.items()))


def mean_over(cube: DataFrame, *axes: str, strict: bool = False) -> DataFrame:
    """Mean over axes, of what is present, or NULL if anything is missing."""
    keys = [a for a in AXES if a not in axes and a in cube.columns]
    mean = F.avg("value")
    return cube.groupBy(*keys).agg((F.when(F.count(F.lit(1)) == F.count("value"), mean) if strict else mean).alias("value"))


__all__ = ["crop", "nearest", "at_positions", "where", "expand", "relabel", "unstack", "stack", "drop_incomplete_points", "reindex", "combine", "apply_mask", "merge", "concat", "mean_over", "dense"]
