"""Grid preparation: longitudes, dry masks, climatology, quantiles, tercile encoding, scalers, transformers.

All work on canonical cubes (lat, lon, sample, feature, value) with NULL for missing. Fitted objects hold small tables of
one row per cell or series; transforming joins them back on coordinates, which Spark broadcasts while they are small.
Where published behaviour and evident intent differ, `compat=True` (the default) gives the published behaviour.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.functions import distributions
from skyquilt.functions.expr import CELL, SERIES, avg_rank, q_mid


def reformat(cube: DataFrame) -> DataFrame:
    """Longitudes above 180, strictly, minus 360."""
    return cube.withColumn("lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")))


def fill_spatial_mean(cube: DataFrame) -> DataFrame:
    return cube.withColumn("value", F.coalesce("value", F.avg("value").over(Window.partitionBy("sample", "feature"))))


def drymask(cube: DataFrame, *, dry_threshold: float = 0.001, quantile_threshold: float = 0.33, method: str = "quantile") -> DataFrame:
    """`lat, lon, value`: 1 where a cell isn't dry, NULL where it is; mean over features. Cells without data count as not dry."""
    if method not in ("quantile", "mean"):
        raise ValueError(f"no method {method!r}")
    level = q_mid("value", quantile_threshold) if method == "quantile" else F.avg("value")
    wet = cube.groupBy(*SERIES).agg(level.alias("level")).withColumn("wet", F.when(F.coalesce(F.col("level") < dry_threshold, F.lit(False)), None).otherwise(1.0))
    return wet.groupBy(*CELL).agg(F.avg("wet").alias("value"))


def remove_climatology(cube: DataFrame, method: str = "monthly") -> DataFrame:
    """Monthly means minus the mean of that calendar month over all years; samples become the first of the month.

    Samples after the last year's 31 December, 00:00, are left out, as its published form does.
    """
    if method != "monthly":
        raise ValueError("only monthly climatology is defined")
    at = F.col("sample").cast("timestamp")
    last = cube.agg(F.max(F.year("sample")).alias("last_year"))
    kept = cube.crossJoin(F.broadcast(last)).where(at <= F.make_timestamp("last_year", F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)))
    monthly = kept.groupBy(*SERIES, F.to_date(F.date_trunc("month", at)).alias("month")).agg(F.avg("value").alias("value"))
    clim = kept.groupBy(*SERIES, F.month("sample").alias("m")).agg(F.avg("value").alias("clim"))
    joined = monthly.withColumn("m", F.month("month")).join(clim, [*SERIES, "m"])
    return joined.select("lat", "lon", F.col("month").alias("sample"), "feature", (F.col("value") - F.col("clim")).alias("value"))


def quantile(cube: DataFrame, threshold: float, method: str = "midpoint") -> DataFrame:
    """`lat, lon, feature, value`: per series, missing values skipped; NULL for a series without data."""
    level = q_mid("value", threshold) if method == "midpoint" else F.percentile("value", F.lit(float(threshold)))
    return cube.groupBy(*SERIES).agg(level.alias("value"))


def std(cube: DataFrame) -> DataFrame:
    """Population standard deviation per series."""
    return cube.groupBy(*SERIES).agg(F.stddev_pop("value").alias("value"))


def terciles(cube: DataFrame, low: float = 1 / 3, high: float = 2 / 3, keys: tuple[str, ...] = CELL) -> DataFrame:
    """`*keys, lo, hi`: midpoint quantiles of all values of a cell together."""
    ordered = F.sort_array(F.collect_list("value"))
    grouped = cube.groupBy(*keys).agg(ordered.alias("s"))
    from skyquilt.functions.expr import midpoint_of

    return grouped.select(*keys, midpoint_of(F.col("s"), low).alias("lo"), midpoint_of(F.col("s"), high).alias("hi"))


def _classes(joined: DataFrame, *classes: tuple[str, "F.Column"]) -> DataFrame:
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), c.cast("double").alias("value")) for n, c in classes)))
    return joined.select("lat", "lon", "sample", rows.alias("x")).select("lat", "lon", "sample", "x.feature", "x.value")


@dataclass
class OneHotEncoder:
    """Below, near and above normal as three features of 0 and 1.

    fit: midpoint quantiles of the first feature (defaults .33 and .67), or constants with explicit=True. transform: BN x < lo,
    AN x > hi, NN between; NULL only in cells without any data, so a single missing sample is 0, 0, 0. With compat an
    exact 0.0 in the normal range is 0, 0, 0 too.
    """

    low: float = 0.33
    high: float = 0.67
    explicit: bool = False
    compat: bool = True
    thresholds: DataFrame | None = field(default=None, repr=False)

    def fit(self, cube: DataFrame) -> "OneHotEncoder":
        if self.explicit:
            self.thresholds = cube.select(*CELL).distinct().select("*", F.lit(float(self.low)).alias("lo"), F.lit(float(self.high)).alias("hi"))
        else:
            first = cube.agg(F.min("feature").alias("f"))
            self.thresholds = terciles(cube.join(F.broadcast(first), F.col("feature") == F.col("f")), self.low, self.high)
        return self

    def transform(self, cube: DataFrame) -> DataFrame:
        any_ = F.count("value").over(Window.partitionBy(*CELL)) > 0
        joined = cube.withColumn("any", any_).join(self.thresholds, list(CELL), "left")
        near = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
        near = near & (F.col("value") != 0) if self.compat else near
        one = lambda c: F.when(F.col("any"), F.when(c, 1.0).otherwise(0.0))
        return _classes(joined, ("BN", one(F.col("value") < F.col("lo"))), ("NN", one(near)), ("AN", one(F.col("value") > F.col("hi"))))


@dataclass
class MinMax:
    """Each series to [min, max]; a range of 0 counts as 1."""

    min: float = -1.0
    max: float = 1.0
    fitted: DataFrame | None = field(default=None, repr=False)

    def fit(self, cube: DataFrame) -> "MinMax":
        lo, hi = F.min("value"), F.max("value")
        self.fitted = cube.groupBy(*SERIES).agg(lo.alias("lo"), F.when(hi == lo, 1.0).otherwise(hi - lo).alias("range"))
        return self

    def _each(self, cube: DataFrame, body) -> DataFrame:
        return cube.join(self.fitted, list(SERIES)).select("lat", "lon", "sample", "feature", body.alias("value"))

    def transform(self, cube: DataFrame) -> DataFrame:
        return self._each(cube, (F.col("value") - F.col("lo")) / F.col("range") * (self.max - self.min) + self.min)

    def inverse_transform(self, cube: DataFrame) -> DataFrame:
        return self._each(cube, (F.col("value") - self.min) / (self.max - self.min) * F.col("range") + F.col("lo"))


@dataclass
class Normal:
    """Each series to mean 0 and population standard deviation 1; a deviation of 0 counts as 1."""

    fitted: DataFrame | None = field(default=None, repr=False)

    def fit(self, cube: DataFrame) -> "Normal":
        sd = F.stddev_pop("value")
        self.fitted = cube.groupBy(*SERIES).agg(F.avg("value").alias("mu"), F.when(sd == 0, 1.0).otherwise(sd).alias("sd"))
        return self

    def transform(self, cube: DataFrame) -> DataFrame:
        return cube.join(self.fitted, list(SERIES)).select("lat", "lon", "sample", "feature", ((F.col("value") - F.col("mu")) / F.col("sd")).alias("value"))

    def inverse_transform(self, cube: DataFrame) -> DataFrame:
        return cube.join(self.fitted, list(SERIES)).select("lat", "lon", "sample", "feature", (F.col("value") * F.col("sd") + F.col("mu")).alias("value"))


def percentile(cube: DataFrame, *, compat: bool = True) -> DataFrame:
    """Average rank over the number of values present, kept within 0.0001 and 0.9999. With compat missing values become 0.9999."""
    present = cube.where(F.col("value").isNotNull())
    ranked = present.withColumn("p", avg_rank("value", *SERIES) / F.count(F.lit(1)).over(Window.partitionBy(*SERIES)))
    clamped = F.when(F.col("p") >= 1, 0.9999).when(F.col("p") <= 0, 0.0001).otherwise(F.col("p"))
    out = ranked.select("lat", "lon", "sample", "feature", clamped.alias("value"))
    missing = cube.where(F.col("value").isNull()).select("lat", "lon", "sample", "feature", F.lit(0.9999 if compat else None).cast("double").alias("value"))
    return out.unionByName(missing)


def cdf(cube: DataFrame, dist: str = "norm") -> DataFrame:
    return cube.withColumn("value", distributions.cdf(F.col("value"), dist))


def invcdf(cube: DataFrame, dist: str = "norm") -> DataFrame:
    return cube.withColumn("value", distributions.ppf(F.col("value"), dist))


def normal_scores(cube: DataFrame, dist: str = "norm") -> DataFrame:
    """Percentiles through the quantile function; samples in which a value is missing are dropped."""
    whole = cube.withColumn("n", F.count("value").over(Window.partitionBy("sample"))).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("sample"))).where("n = m")
    return invcdf(percentile(whole.drop("n", "m")), dist)


def _clamp(p):
    return F.greatest(F.lit(0.0001), F.least(F.lit(0.9999), p))


@dataclass
class GammaTransformer:
    """Values above eps follow a gamma distribution per series; transform maps through its cdf to a normal, inverse back.

    alpha and beta: with a = 4 (ln mean - mean ln), alpha = (1 + sqrt(1 + a / 3)) / a and beta = mean / alpha if a > sqrt(eps);
    else by moments; else alpha 0 and beta 0.0001.
    """

    destination: str = "norm"
    eps: float = 2.220446049250313e-16
    fitted: DataFrame | None = field(default=None, repr=False)

    def fit(self, cube: DataFrame) -> "GammaTransformer":
        kept = F.when(F.col("value") > self.eps, F.col("value"))
        stats = cube.groupBy(*SERIES).agg(F.avg(kept).alias("m"), F.avg(F.ln(kept)).alias("l"), F.var_pop(kept).alias("v"))
        a = 4 * (F.ln("m") - F.col("l"))
        near, moments = a > self.eps**0.5, F.col("v") > 0
        alpha = F.when(near, (1 + F.sqrt(1 + a / 3)) / a).when(moments, F.col("m") * F.col("m") / F.col("v")).otherwise(0.0)
        beta = F.when(near, F.col("m") / alpha).when(moments, F.col("v") / F.col("m")).otherwise(0.0001)
        self.fitted = stats.select(*SERIES, alpha.alias("alpha"), beta.alias("beta"))
        return self

    def transform(self, cube: DataFrame) -> DataFrame:
        p = distributions.cdf(F.col("value"), "gamma", F.col("alpha"), F.col("beta"))
        joined = cube.join(self.fitted, list(SERIES)).withColumn("p", p)
        return joined.withColumn("value", distributions.ppf(F.when(F.col("p").isNotNull(), _clamp(F.col("p"))), self.destination)).select("lat", "lon", "sample", "feature", "value")

    def inverse_transform(self, cube: DataFrame) -> DataFrame:
        joined = cube.join(self.fitted, list(SERIES)).withColumn("p", distributions.cdf(F.col("value"), self.destination))
        return joined.withColumn("value", distributions.ppf(F.when(F.col("p").isNotNull(), _clamp(F.col("p"))), "gamma", F.col("alpha"), F.col("beta"))).select("lat", "lon", "sample", "feature", "value")


@dataclass
class EmpiricalTransformer:
    """Right-continuous empirical distribution of the fitted series, through the normal quantile function; inverse by
    linear interpolation through (ECDF(v), v), extrapolated at both ends."""

    destination: str = "norm"
    fitted: DataFrame | None = field(default=None, repr=False)

    def fit(self, cube: DataFrame) -> "EmpiricalTransformer":
        self.fitted = cube.groupBy(*SERIES).agg(F.sort_array(F.collect_list("value")).alias("s"))
        return self

    def ecdf(self, cube: DataFrame) -> DataFrame:
        """Share of fitted values <= x, kept within 0.0001 and 0.9999."""
        below = F.size(F.filter("s", lambda t: t <= F.col("value"))) / F.size("s")
        return cube.join(self.fitted, list(SERIES)).select("lat", "lon", "sample", "feature", F.when(F.col("value").isNotNull() & (F.size("s") > 0), _clamp(below)).alias("value"))

    def transform(self, cube: DataFrame) -> DataFrame:
        return invcdf(self.ecdf(cube), self.destination)

    def inverse_transform(self, cube: DataFrame) -> DataFrame:
        p = cdf(cube, self.destination).join(self.fitted, list(SERIES))
        knots = F.array_distinct("s")
        place = F.transform("k", lambda t: F.size(F.filter("s", lambda u: u <= t)) / F.size("s"))
        p = p.withColumn("k", knots).withColumn("e", place).withColumn("j", F.size(F.filter("e", lambda e: e < F.col("value"))))
        j = F.greatest(F.lit(1), F.least(F.size("k") - 1, F.col("j")))
        p = p.withColumn("j", j.cast("int"))
        e0, e1, k0, k1 = (F.get(c, i) for c, i in (("e", F.col("j") - 1), ("e", F.col("j")), ("k", F.col("j") - 1), ("k", F.col("j"))))
        value = F.when(F.size("k") == 1, F.get("k", F.lit(0))).otherwise(k0 + (F.col("value") - e0) / (e1 - e0) * (k1 - k0))
        return p.select("lat", "lon", "sample", "feature", F.when(F.col("value").isNotNull(), value).alias("value"))
