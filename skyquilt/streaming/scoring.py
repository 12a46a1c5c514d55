"""Structured Streaming forms of what needs no future: scoring against fitted tables, and running statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.expr import CELL, SERIES


def score_linear(stream: DataFrame, model: DataFrame) -> DataFrame:
    """A stream of `lat, lon, sample, value` with predictions of a static model table `lat, lon, intercept, slope`; stateless."""
    return stream.join(model, list(CELL)).select(*CELL, "sample", (F.col("intercept") + F.col("slope") * F.col("value")).alias("prediction"))


def classify(stream: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The tercile class of each arriving value against static thresholds `lat, lon, lo, hi`."""
    v = F.col("value")
    kind = F.when(v.isNull(), None).when(v < F.col("lo"), "BN").when(v > F.col("hi"), "AN").otherwise("NN")
    return stream.join(thresholds, list(CELL)).select(*CELL, "sample", kind.alias("category"))


def running_normal(stream: DataFrame) -> DataFrame:
    """Mean, population deviation and range per series so far; state is one row per series. Output mode complete or update."""
    return stream.groupBy(*SERIES).agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def windowed_mean(stream: DataFrame, duration: str = "30 days", late: str = "7 days") -> DataFrame:
    """Mean per cell and tumbling window of event time `sample`; values later than `late` behind are dropped."""
    return stream.withWatermark("sample", late).groupBy(*CELL, F.window("sample", duration)).agg(F.avg("value").alias("value"))
