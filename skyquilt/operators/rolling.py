"""Moving climatology: thresholds or ranges pooled over days around each calendar day and over years.

A pool of a date of the base year holds the samples between `lead_low` days before and `lead_high` after it, both included,
shifted by 365 (j + 1) days for j < n_years; the base year itself is never used and leap days are ignored, as published.
The pools are a join on exploded year offsets and the pool's days, so the range condition is an equality on days.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.expr import SERIES, q_mid


def pools(cube: DataFrame, *, lead_low: int = 7, lead_high: int = 14, base_year: int = 1999, n_years: int = 30) -> DataFrame:
    """`lat, lon, feature, md, value`: every pooled value under its month and day 'mm-dd'. 29 February is pooled as 28 February
    if the base year has none."""
    md = F.date_format("sample", "MM-dd")
    day = F.coalesce(F.try_to_date(F.concat(F.lit(f"{base_year}-"), F.col("md")), "yyyy-MM-dd"), F.to_date(F.lit(f"{base_year}-02-28")))
    days = cube.select(md.alias("md")).distinct().select("md", day.alias("base"))
    offset = F.explode(F.sequence(F.lit(0), F.lit(n_years - 1)))
    days = days.select("md", "base", offset.alias("j")).select("md", F.explode(F.sequence(F.date_add("base", 365 * (F.col("j") + 1) - lead_low), F.date_add("base", 365 * (F.col("j") + 1) + lead_high))).alias("day"))
    return cube.join(days, F.to_date("sample") == F.col("day")).select(*SERIES, "md", "value")


@dataclass
class _Rolling:
    lead_low: int = 7
    lead_high: int = 14
    base_year: int = 1999
    n_years: int = 30
    compat: bool = False
    fitted: DataFrame | None = field(default=None, repr=False)

    def _pools(self, cube: DataFrame) -> DataFrame:
        return pools(cube, lead_low=self.lead_low, lead_high=self.lead_high, base_year=self.base_year, n_years=self.n_years)

    def _joined(self, cube: DataFrame) -> DataFrame:
        """With compat every sample after the base year gets the last day's values, as a nearest-date lookup there does."""
        if self.compat:
            last = self.fitted.agg(F.max("md").alias("last_md"))
            fitted = self.fitted.join(F.broadcast(last), F.col("md") == F.col("last_md")).drop("md", "last_md")
            return cube.join(fitted, list(SERIES), "left")
        return cube.withColumn("md", F.date_format("sample", "MM-dd")).join(self.fitted, [*SERIES, "md"], "left")


@dataclass
class RollingOneHotEncoder(_Rolling):
    """BN x <= lo, AN x > hi, NN 1 - AN - BN, so a missing value is NN."""

    low: float = 1 / 3
    high: float = 2 / 3

    def fit(self, cube: DataFrame) -> "RollingOneHotEncoder":
        self.fitted = self._pools(cube).groupBy(*SERIES, "md").agg(q_mid("value", self.low).alias("lo"), q_mid("value", self.high).alias("hi"))
        return self

    def transform(self, cube: DataFrame) -> DataFrame:
        joined = self._joined(cube)
        bn, an = F.when(F.col("value") <= F.col("lo"), 1.0).otherwise(0.0), F.when(F.col("value") > F.col("hi"), 1.0).otherwise(0.0)
        rows = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in (("BN", bn), ("NN", 1 - an - bn), ("AN", an)))))
        return joined.select("lat", "lon", "sample", rows.alias("x")).select("lat", "lon", "sample", "x.feature", "x.value")


@dataclass
class RollingMinMax(_Rolling):
    """(x - lo) / (hi - lo) * 2 - 1 with the pool's range; NULL for a pool without range."""

    def fit(self, cube: DataFrame) -> "RollingMinMax":
        self.fitted = self._pools(cube).groupBy(*SERIES, "md").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        return self

    def transform(self, cube: DataFrame) -> DataFrame:
        return self._joined(cube).select("lat", "lon", "sample", "feature", (F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")) * 2 - 1).alias("value"))
