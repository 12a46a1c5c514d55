"""The numbers behind verification plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.functions.expr import CELL


def _pooled(pred: DataFrame, obs: DataFrame) -> DataFrame:
    """`feature, p, o` of all cells and samples where both are present."""
    o = obs.select(*CELL, "sample", "feature", F.col("value").alias("o"))
    return pred.select(*CELL, "sample", "feature", F.col("value").alias("p")).join(o, [*CELL, "sample", "feature"]).where("p is not null and o is not null").select("feature", "p", "o")


def reliability(pred: DataFrame, obs: DataFrame, bins: int = 10) -> DataFrame:
    """`feature, bin, n, hit_rate, forecast`: bins [i / 10, (i + 1) / 10) of the forecast times 0.9999999999999; rates of bins
    with under 1% of a class's forecasts are NULL."""
    rows = _pooled(pred, obs).withColumn("bin", F.floor(F.col("p") * 0.9999999999999 * bins).cast("int"))
    binned = rows.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("o").alias("h"), F.avg("p").alias("f"))
    enough = F.col("n") >= 0.01 * F.sum("n").over(Window.partitionBy("feature"))
    return binned.select("feature", "bin", "n", F.when(enough, F.col("h")).alias("hit_rate"), F.when(enough, F.col("f")).alias("forecast"))


def reliability_scores(pred: DataFrame, obs: DataFrame, bins: int = 10) -> DataFrame:
    """`feature, rel, res, unc, bss`: the three parts of the Brier score, and the skill (res - rel) / unc that they give."""
    rows = _pooled(pred, obs).withColumn("bin", F.floor(F.col("p") * 0.9999999999999 * bins).cast("int"))
    binned = rows.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("o").alias("h"), F.avg("p").alias("f"))
    own = Window.partitionBy("feature")
    binned = binned.withColumn("all", F.sum("n").over(own)).withColumn("base", F.sum("h").over(own) / F.col("all"))
    rate, share = F.col("h") / F.col("n"), F.col("n") / F.col("all")
    parts = binned.groupBy("feature").agg(F.sum(share * (F.col("f") - rate) * (F.col("f") - rate)).alias("rel"), F.sum(share * (rate - F.col("base")) * (rate - F.col("base"))).alias("res"), F.max(F.col("base") * (1 - F.col("base"))).alias("unc"))
    return parts.withColumn("bss", F.try_divide(F.col("res") - F.col("rel"), F.col("unc")))


def roc_points(pred: DataFrame, obs: DataFrame) -> DataFrame:
    """`feature, threshold, fpr, tpr`: rates of forecasts at least the threshold, a point for each distinct forecast."""
    steps = _pooled(pred, obs).groupBy("feature", F.col("p").alias("threshold")).agg(F.sum("o").alias("hits"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("feature").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("feature")
    tp, fp = F.sum("hits").over(down), F.sum(F.col("n") - F.col("hits")).over(down)
    return steps.select("feature", "threshold", F.try_divide(fp, F.sum(F.col("n") - F.col("hits")).over(own)).alias("fpr"), F.try_divide(tp, F.sum("hits").over(own)).alias("tpr"))


def roc_auc(pred: DataFrame, obs: DataFrame) -> DataFrame:
    """`feature, auc` by trapezoids, with the mean of the classes as feature 'macro'."""
    up = Window.partitionBy("feature").orderBy(F.desc("threshold"))
    points = roc_points(pred, obs).withColumn("f0", F.coalesce(F.lag("fpr").over(up), F.lit(0.0))).withColumn("t0", F.coalesce(F.lag("tpr").over(up), F.lit(0.0)))
    area = points.groupBy("feature").agg(F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2).alias("auc"))
    return area.unionByName(area.agg(F.avg("auc").alias("auc")).select(F.lit("macro").alias("feature"), "auc"))


def taylor(pred: DataFrame, obs: DataFrame) -> DataFrame:
    """`feature, std, corr, crms, angle` of each forecast feature against the observations; angle is (1 - r) pi / 2."""
    o = obs.select(*CELL, "sample", F.col("value").alias("o"))
    rows = pred.select(*CELL, "sample", "feature", F.col("value").alias("p")).join(o, [*CELL, "sample"]).where("p is not null and o is not null")
    stats = rows.groupBy("feature").agg(F.stddev_pop("p").alias("std"), F.corr("p", "o").alias("corr"), F.stddev_pop(F.col("p") - F.col("o")).alias("crms"))
    return stats.withColumn("angle", (1 - F.col("corr")) * F.pi() / 2)


def dominant(pred: DataFrame) -> DataFrame:
    """`lat, lon, sample, feature, value`: the most likely class in the order BN, NN, AN, the first of ties, and its probability."""
    place = F.array_position(F.array(*(F.lit(c) for c in ("BN", "NN", "AN"))), F.col("feature"))
    best = pred.where("value is not null").groupBy(*CELL, "sample").agg(F.min(F.struct((-F.col("value")).alias("v"), place.alias("i"), "feature")).alias("b"))
    return best.select(*CELL, "sample", F.col("b.feature").alias("feature"), (-F.col("b.v")).alias("value"))
