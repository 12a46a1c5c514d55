"""Cross-validation as a fold column: all folds of all cells are one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_index(cube: DataFrame) -> DataFrame:
    """`sample, i, n`: dense positions of the distinct samples, from 0. The list of samples is small beside a cube."""
    own = cube.select("sample").distinct()
    return own.withColumn("i", (F.row_number().over(Window.orderBy("sample")) - 1).cast("int")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()).cast("int"))


def circular(cube: DataFrame, window: int = 3, step: int = 1) -> DataFrame:
    """`fold, sample, is_test, is_centre`: fold f tests the window of samples around position f, wrapping at both ends."""
    if window % 2 == 0 or window < 1:
        raise ValueError("the window is an odd number")
    at = sample_index(cube)
    folds = at.where(F.col("i") % step == 0).select(F.col("i").alias("fold"))
    away = F.least(F.pmod(F.col("i") - F.col("fold"), F.col("n")), F.pmod(F.col("fold") - F.col("i"), F.col("n")))
    return at.crossJoin(F.broadcast(folds)).select("fold", "sample", (away <= (window - 1) // 2).alias("is_test"), (F.col("i") == F.col("fold")).alias("is_centre"))


def leave_one_year_out(cube: DataFrame, compat: bool = True) -> DataFrame:
    """`fold, sample, is_train, is_test`: fold y tests year y up to 31 December 00:00. With compat samples at 1 January or 31 December
    00:00 of the year are in the training part too."""
    at = F.col("sample").cast("timestamp")
    samples = cube.select("sample").distinct()
    years = samples.select(F.year("sample").alias("fold")).distinct()
    first = F.make_timestamp("fold", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    last = F.make_timestamp("fold", F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0))
    test = (at >= first) & (at <= last)
    train = (at <= first) | (at >= last) if compat else F.year("sample") != F.col("fold")
    return samples.crossJoin(F.broadcast(years)).select("fold", "sample", train.alias("is_train"), test.alias("is_test"))


def kfold(cube: DataFrame, k: int = 5) -> DataFrame:
    """`sample, i, n, fold`: contiguous folds; the first n mod k have one sample more."""
    size, extra = F.expr(f"n div {int(k)}"), F.col("n") % k
    edge = extra * (size + 1)
    fold = F.when(F.col("i") < edge, F.floor(F.col("i") / (size + 1))).otherwise(extra + F.floor((F.col("i") - edge) / F.greatest(size, F.lit(1))))
    return sample_index(cube).select("sample", "i", "n", fold.cast("int").alias("fold"))
