"""Linear regression on one predictor per cell, in aggregates and joins alone.

As published, the coefficients kept are those of the last fold's training part: the first n - n div k samples. The error
variance is the sum of the k folds' squared residuals over n - p - 1, p counting the constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.expr import CELL, t_cdf
from skyquilt.operators.ensemble import _rows
from skyquilt.operators.folds import kfold


def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """`lat, lon, sample, p, o` of cells without gaps: mean of x's features, and y."""
    p = x.groupBy(*CELL, "sample").agg(F.avg("value").alias("p"))
    joined = p.join(y.select(*CELL, "sample", F.col("value").alias("o")), [*CELL, "sample"])
    whole = joined.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.count(F.col("p") + F.col("o")).alias("m")).where("n = m").select(*CELL)
    return joined.join(whole, list(CELL), "left_semi")


def fit(x: DataFrame, y: DataFrame, k: int = 5, refit: str = "last_fold") -> DataFrame:
    """`lat, lon, intercept, slope, err_var, n, lo, hi`; refit='full' fits the coefficients to all samples."""
    rows = pairs(x, y)
    folds = kfold(rows, k).select("sample", "i", "n", "fold")
    rows = rows.join(F.broadcast(folds), "sample")  # one row a sample of the time axis
    out = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    train = rows.select(*CELL, "p", "o", "fold", out.alias("left_out")).where("fold <> left_out")
    coefficients = train.withColumnRenamed("left_out", "k").groupBy(*CELL, "k").agg(F.regr_slope("o", "p").alias("s"), F.regr_intercept("o", "p").alias("c"))
    held = rows.withColumnRenamed("fold", "k").join(coefficients, [*CELL, "k"]).select(*CELL, (F.col("o") - F.col("c") - F.col("s") * F.col("p")).alias("r"), "n")
    errors = held.groupBy(*CELL).agg((F.sum(F.col("r") * F.col("r")) / (F.max("n") - 3)).alias("err_var"), F.max("n").alias("n"))
    kept = rows if refit == "full" else rows.where(f"i < n - n div {int(k)}")
    last = kept.groupBy(*CELL).agg(F.regr_intercept("o", "p").alias("intercept"), F.regr_slope("o", "p").alias("slope"))
    limits = rows.groupBy(*CELL).agg(F.percentile("o", F.lit(1 / 3)).alias("lo"), F.percentile("o", F.lit(2 / 3)).alias("hi"), F.avg("p").alias("xmean"), F.stddev_pop("p").alias("xstd"))
    return last.join(errors, list(CELL)).join(limits, list(CELL))


def predict(model: DataFrame, x: DataFrame) -> DataFrame:
    p = x.groupBy(*CELL, "sample").agg(F.avg("value").alias("p"))
    return p.join(model, list(CELL)).select(*CELL, "sample", F.lit("mlr").alias("feature"), (F.col("intercept") + F.col("slope") * F.col("p")).alias("value"))


def predict_proba(model: DataFrame, x: DataFrame, probability_method: str = "error_variance") -> DataFrame:
    """Tercile probabilities of a Student t with n - 3 degrees of freedom around the prediction."""
    p = x.groupBy(*CELL, "sample").agg(F.avg("value").alias("p")).join(model, list(CELL))
    mu, spread = F.col("intercept") + F.col("slope") * F.col("p"), F.col("err_var")
    if probability_method == "adjusted_error_variance":
        d = F.col("p") - F.col("xmean")
        spread = spread * (1 + d * d / (F.col("xstd") * F.col("xstd") * F.col("n")))
    scale = F.sqrt(spread)
    p = p.withColumn("bn", t_cdf((F.col("lo") - mu) / scale, F.col("n") - 3)).withColumn("an", 1 - t_cdf((F.col("hi") - mu) / scale, F.col("n") - 3))
    return _rows(p, F.col("bn"), 1 - F.col("bn") - F.col("an"), F.col("an"))


def cross_validated(x: DataFrame, y: DataFrame, folds: DataFrame, k: int = 5) -> DataFrame:
    """`lat, lon, sample, feature, value`: each fold's centre predicted from the samples it doesn't test; all folds at once."""
    rows = pairs(x, y).join(F.broadcast(folds.select("fold", "sample", "is_test", "is_centre")), "sample")
    train = folds.where("not is_test").select("fold", "sample")
    from pyspark.sql import Window

    train = train.withColumn("i", F.row_number().over(Window.partitionBy("fold").orderBy("sample")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("fold"))).where(f"i < n - n div {int(k)}")
    fitted = rows.join(F.broadcast(train.select("fold", "sample")), ["fold", "sample"]).groupBy("fold", *CELL).agg(F.regr_intercept("o", "p").alias("c"), F.regr_slope("o", "p").alias("s"))
    return rows.where("is_centre").join(fitted, ["fold", *CELL]).select(*CELL, "sample", F.lit("mlr").alias("feature"), (F.col("c") + F.col("s") * F.col("p")).alias("value"))
