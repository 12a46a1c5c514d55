"""Tercile probabilities from raw ensembles, and their scaling by anomaly correlation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.expr import CELL
from skyquilt.operators.prep import OneHotEncoder, terciles


def _rows(wide: DataFrame, bn: Column, nn: Column, an: Column) -> DataFrame:
    one = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in (("BN", bn), ("NN", nn), ("AN", an)))))
    return wide.select(*CELL, "sample", one.alias("x")).select(*CELL, "sample", "x.feature", "x.value")


@dataclass
class Ensemble:
    """Shares of members at most the lower, or above the upper, tercile pooled over members and samples of the cell.

    The cube must be dense: the denominator counts missing members.
    """

    low: float = 1 / 3
    high: float = 2 / 3
    thresholds: DataFrame | None = field(default=None, repr=False)

    def fit(self, x: DataFrame, y: DataFrame | None = None) -> "Ensemble":
        self.thresholds = terciles(x, self.low, self.high)
        return self

    def shares(self, x: DataFrame) -> DataFrame:
        """`lat, lon, sample, bn, nn, an`."""
        joined = x.join(self.thresholds, list(CELL))
        share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
        wide = joined.groupBy(*CELL, "sample").agg(share(F.col("value") <= F.col("lo")).alias("bn"), share(F.col("value") > F.col("hi")).alias("an"))
        return wide.withColumn("nn", 1 - F.col("bn") - F.col("an"))

    def predict_proba(self, x: DataFrame) -> DataFrame:
        return _rows(self.shares(x), F.col("bn"), F.col("nn"), F.col("an"))

    def predict(self, x: DataFrame) -> DataFrame:
        return x.groupBy(*CELL, "sample").agg(F.avg("value").alias("value")).select(*CELL, "sample", F.lit("M").alias("feature"), "value")


@dataclass
class ACPAC(Ensemble):
    """Ensemble shares times sdratio * pac per cell and class, with excess redistributed in three rounds.

    sdratio: deviation of the one-hot observations over that of the shares. pac: mean of o' p' over the root of the mean of
    o'^2 p^2, with o', p' the values less 0.333 and p raw in the denominator, as published. predict: mean of members
    times their slopes against the observations, both less the observed mean.
    """

    scaling: DataFrame | None = field(default=None, repr=False)
    slope: DataFrame | None = field(default=None, repr=False)

    def fit(self, x: DataFrame, y: DataFrame | None = None) -> "ACPAC":
        super().fit(x)
        one_hot = OneHotEncoder().fit(y).transform(y).select(*CELL, "sample", "feature", F.col("value").alias("o"))
        pairs = super().predict_proba(x).withColumnRenamed("value", "p").join(one_hot, [*CELL, "sample", "feature"])
        o, p = F.col("o") - 0.333, F.col("p") - 0.333
        pac = F.try_divide(F.avg(o * p), F.sqrt(F.avg(o * o * F.col("p") * F.col("p"))))
        self.scaling = pairs.groupBy(*CELL, "feature").agg(F.try_divide(F.stddev_pop("o"), F.stddev_pop("p")).alias("sdratio"), pac.alias("pac"))
        obs = y.groupBy(*CELL, "sample").agg(F.avg("value").alias("o"))
        clim = y.groupBy(*CELL).agg(F.avg("value").alias("clim"))
        both = x.join(obs, [*CELL, "sample"]).join(clim, list(CELL)).withColumn("dx", F.col("value") - F.col("clim")).withColumn("dy", F.col("o") - F.col("clim"))
        self.slope = both.groupBy(*CELL, "feature").agg((F.avg(F.col("dx") * F.col("dy")) / F.nullif(F.var_pop("dx"), F.lit(0.0))).alias("a"))
        return self

    def predict_proba(self, x: DataFrame) -> DataFrame:
        factor = F.col("sdratio") * F.col("pac")
        scaled = super().predict_proba(x).join(self.scaling, [*CELL, "feature"]).withColumn("v", F.col("value") * factor)
        wide = scaled.groupBy(*CELL, "sample").agg(*(F.max(F.when(F.col("feature") == c, F.col("v"))).alias(n) for c, n in (("BN", "bn"), ("NN", "nn"), ("AN", "an"))))
        for _ in range(3):
            wide = self._round(wide)
        return _rows(wide, F.col("bn"), F.col("nn"), F.col("an"))

    @staticmethod
    def _round(wide: DataFrame) -> DataFrame:
        """Half of what a class lies under .01, if under 0, goes to each other class; then so for what it lies over .99, if
        over 1; the class itself isn't clipped. Then all give a third of the sum's excess over 1."""
        names = ("bn", "nn", "an")
        for low in (True, False):
            excess = {n: F.when(F.col(n) < 0, F.col(n) - 0.01).otherwise(0.0) if low else F.when(F.col(n) > 1, F.col(n) - 0.99).otherwise(0.0) for n in names}
            moved = [(F.col(n) + sum((excess[m] / 2 for m in names if m != n), F.lit(0.0))).alias(n) for n in names]
            wide = wide.select(*CELL, "sample", *moved)
        over = (F.col("bn") + F.col("nn") + F.col("an") - 1) / 3
        return wide.select(*CELL, "sample", *((F.col(n) - over).alias(n) for n in names))

    def predict(self, x: DataFrame) -> DataFrame:
        scaled = x.join(self.slope, [*CELL, "feature"]).groupBy(*CELL, "sample").agg(F.avg(F.col("value") * F.col("a")).alias("value"))
        return scaled.select(*CELL, "sample", F.lit("0").alias("feature"), "value")
