"""Skill metrics per cell.

`continuous(pred, obs)` and `probabilistic(pred, obs)` pair the cubes; every metric is then an aggregate over the pairs of a
cell, and `score(pairs, {...})` evaluates any number of them in one pass. As published, a missing value anywhere in a cell makes
the whole cell NULL, and vector results (one number a class) are averaged.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyquilt.functions import distributions
from skyquilt.functions.expr import CELL, avg_rank, two_sided_p

EPS = 2.220446049250313e-16
CLASSES = ("BN", "NN", "AN")


def continuous(pred: DataFrame, obs: DataFrame) -> DataFrame:
    """`lat, lon, feature, sample, p, o` of complete series, plus the mean of both per series and average ranks."""
    o = obs.select(*CELL, "sample", F.col("value").alias("o"))
    pairs = pred.select(*CELL, "feature", "sample", F.col("value").alias("p")).join(o, [*CELL, "sample"])
    own = Window.partitionBy(*CELL, "feature")
    return pairs.select("*", F.avg("p").over(own).alias("p_mean"), F.avg("o").over(own).alias("o_mean"), F.count(F.when(F.col("p").isNull() | F.col("o").isNull(), 1)).over(own).alias("gaps"))


def ranked(pairs: DataFrame) -> DataFrame:
    """Average ranks of both sides in the place of their values."""
    return pairs.withColumn("rp", avg_rank("p", *CELL, "feature")).withColumn("ro", avg_rank("o", *CELL, "feature"))


def score(pairs: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """`lat, lon` and a column per metric: aggregates per series, NULL for series with gaps, averaged over features."""
    whole = F.max("gaps") == 0
    rows = pairs.groupBy(*CELL, "feature").agg(*(F.when(whole, m).alias(n) for n, m in metrics.items()))
    return rows.groupBy(*CELL).agg(*(F.avg(n).alias(n) for n in metrics))


def _n() -> Column:
    return F.count(F.lit(1))


def _sse() -> Column:
    return F.sum((F.col("p") - F.col("o")) * (F.col("p") - F.col("o")))


def pearson() -> Column:
    return F.corr("p", "o")


def pearson_p() -> Column:
    return two_sided_p(F.corr("p", "o"), F.count(F.lit(1)))


def spearman() -> Column:
    """Over `ranked` pairs."""
    return F.corr("rp", "ro")


def spearman_p() -> Column:
    return two_sided_p(F.corr("rp", "ro"), F.count(F.lit(1)))


def nse() -> Column:
    return 1 - F.try_divide(_sse(), F.sum((F.col("o") - F.col("o_mean")) * (F.col("o") - F.col("o_mean"))))


def nnse() -> Column:
    return 1 / (2 - nse())


def kge_parts() -> tuple[Column, Column, Column]:
    """r, ratio of variances, ratio of means."""
    return F.corr("p", "o"), F.try_divide(F.var_pop("p"), F.var_pop("o")), F.try_divide(F.avg("p"), F.avg("o"))


def kge(sr: float = 1, sa: float = 1, sb: float = 1) -> Column:
    r, a, b = kge_parts()
    return 1 - F.sqrt(sr * (r - 1) * (r - 1) + sa * (a - 1) * (a - 1) + sb * (b - 1) * (b - 1))


def kge_components(component: str = "all") -> Column:
    """r, a or b, or for 'all' their mean, which is what lifting makes of the three."""
    r, a, b = kge_parts()
    return {"r": r, "a": a, "b": b, "all": (r + a + b) / 3}[component]


def index_of_agreement() -> Column:
    """Centred on the mean of the predictions, as published."""
    m = F.col("p_mean")
    wide = F.abs(F.col("p") - m) + F.abs(F.col("o") - m)
    return 1 - F.try_divide(_sse(), F.sum(wide * wide))


def bias_ratio() -> Column:
    return F.try_divide(F.avg("p"), F.avg("o"))


def ncrmse() -> Column:
    return F.try_divide(F.stddev_pop(F.col("p") - F.col("o")), F.avg("o"))


def mape() -> Column:
    return F.avg(F.abs(F.col("o") - F.col("p")) / F.greatest(F.abs(F.col("o")), F.lit(EPS)))


def log_likelihood() -> Column:
    return -_n() / 2 * (1 + math.log(2 * math.pi)) - _n() / 2 * F.ln(F.nullif(_sse() / _n(), F.lit(0.0)))


def aic(k: int = 1) -> Column:
    return -2 * log_likelihood() + 2 * k


def bic(k: int = 1) -> Column:
    return -2 * log_likelihood() + k * F.ln(_n())


def kendall_tau(pairs: DataFrame, *, p_value: bool = False) -> DataFrame:
    """`lat, lon, kendall_tau` and on request `kendall_p`: true tau-b over all pairs of samples of a cell. (The published form sorts both series first.)

    The two-sided p is exact for up to 33 samples without ties, else from the normal approximation with ties counted; means over features.
    """
    a = pairs.where("gaps = 0").select(*CELL, "feature", F.col("sample").alias("s1"), F.col("p").alias("p1"), F.col("o").alias("o1"))
    b = pairs.select(*CELL, "feature", F.col("sample").alias("s2"), F.col("p").alias("p2"), F.col("o").alias("o2"))
    both = a.join(b, [*CELL, "feature"]).where("s1 < s2")
    x, y = F.signum(F.col("p2") - F.col("p1")), F.signum(F.col("o2") - F.col("o1"))
    tau = F.sum(x * y) / F.sqrt(F.nullif(F.sum(F.abs(x)) * F.sum(F.abs(y)), F.lit(0.0)))
    found = both.groupBy(*CELL, "feature").agg(tau.alias("t"), F.sum(x * y).alias("s"), F.sum(F.abs(x)).alias("ux"), F.sum(F.abs(y)).alias("uy"), F.count(F.lit(1)).alias("all"))
    if not p_value:
        return found.groupBy(*CELL).agg(F.avg("t").alias("kendall_tau"))
    n = F.col("n")
    for v in ("p", "o"):  # sizes of ties of each variable
        ties = pairs.where("gaps = 0").groupBy(*CELL, "feature", v).agg(F.count(F.lit(1)).alias("m"))
        m = F.col("m")
        sums = [F.sum(m * (m - 1) * (2 * m + 5)).alias(f"v{v}"), F.sum(m * (m - 1)).alias(f"w{v}"), F.sum(m * (m - 1) * (m - 2)).alias(f"z{v}"), F.sum("m").alias("n")]
        found = found.join(ties.groupBy(*CELL, "feature").agg(*sums[: 4 if v == "p" else 3]), [*CELL, "feature"])
    pairs_of = n * (n - 1)
    variance = (pairs_of * (2 * n + 5) - F.col("vp") - F.col("vo")) / 18 + F.col("wp") * F.col("wo") / (2 * pairs_of) + F.col("zp") * F.col("zo") / (9 * pairs_of * F.greatest(n - 2, F.lit(1)))
    exact = pairs.sparkSession.createDataFrame(_inversions(33), "n0 long, d0 long, p0 double")  # 6,000 rows
    d = F.least((F.col("all") - F.col("s")) / 2, (F.col("all") + F.col("s")) / 2).cast("long")
    found = found.withColumn("d", d).join(F.broadcast(exact), (n == F.col("n0")) & (F.col("d") == F.col("d0")) & (F.col("ux") == F.col("all")) & (F.col("uy") == F.col("all")), "left")
    normal = 2 * distributions.cdf(-F.abs(F.col("s")) / F.sqrt(variance))
    return found.withColumn("q", F.coalesce("p0", normal)).groupBy(*CELL).agg(F.avg("t").alias("kendall_tau"), F.avg("q").alias("kendall_p"))


def _inversions(most: int) -> list[tuple[int, int, float]]:
    """(n, d, p): the chance that a permutation of n has at most d inversions or at least as many as that leaves, for d up to half."""
    out, counts = [], [1]
    for n in range(2, most + 1):
        counts = [sum(counts[max(0, k - n + 1) : k + 1]) for k in range(n * (n - 1) // 2 + 1)]
        total, below = sum(counts), 0
        for d in range(len(counts) // 2 + 1):
            below += counts[d]
            out.append((n, d, min(1.0, 2 * below / total)))
    return out


# ---- probabilities -------------------------------------------------------------------------------------------


def probabilistic(pred: DataFrame, obs: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """`lat, lon, sample, p array, o array, k, f`: probabilities and one-hot observations in class order, the observed and the most likely class
    (first of ties, from 0), and `gaps` of the whole cell."""
    order = F.array(*(F.lit(c) for c in classes))
    place = F.array_position(order, F.col("feature"))
    joined = pred.select(*CELL, "sample", "feature", F.col("value").alias("p")).join(obs.select(*CELL, "sample", "feature", F.col("value").alias("o")), [*CELL, "sample", "feature"])
    rows = joined.groupBy(*CELL, "sample").agg(F.sort_array(F.collect_list(F.struct(place.alias("c"), "p", "o"))).alias("x"))
    rows = rows.select(*CELL, "sample", F.transform("x", lambda v: v["p"]).alias("p"), F.transform("x", lambda v: v["o"]).alias("o"))
    arg = lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int")
    gap = F.when((F.size("p") < len(classes)) | F.exists("p", lambda v: v.isNull()) | F.exists("o", lambda v: v.isNull()), 1)
    own = Window.partitionBy(*CELL)
    rows = rows.withColumn("k", arg(F.col("o"))).withColumn("f", arg(F.col("p"))).withColumn("gaps", F.count(gap).over(own))
    n = F.count(F.lit(1)).over(own)
    clim = F.array(*(F.sum(F.get("o", F.lit(c))).over(own) / n for c in range(len(classes))))
    return rows.withColumn("clim", clim)


def score_cells(rows: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    whole = F.max("gaps") == 0
    return rows.groupBy(*CELL).agg(*(F.when(whole, m).alias(n) for n, m in metrics.items()))


def _squares() -> Column:
    return F.aggregate(F.zip_with("p", "o", lambda p, o: (o - p) * (o - p)), F.lit(0.0), lambda a, x: a + x)


def rps() -> Column:
    """Sum over classes of squared differences, not cumulated, as published."""
    return F.avg(_squares())


def rpss() -> Column:
    base = F.aggregate(F.transform("o", lambda o: (o - 0.333) * (o - 0.333)), F.lit(0.0), lambda a, x: a + x)
    return 1 - F.try_divide(F.avg(_squares()), F.avg(base))


def brier_score(classes: int = 3) -> Column:
    """Mean over classes of the mean squared difference."""
    return F.avg(_squares()) / classes


def brier_class(c: int) -> Column:
    """Brier score loss of one class, observation against probability."""
    d = F.get("p", F.lit(c)) - F.get("o", F.lit(c))
    return F.avg(d * d)


def ignorance() -> Column:
    """Infinite where an observed class had probability 0."""
    p = F.get("p", F.col("k"))
    return -F.avg(F.when(p > 0, F.ln(p)).when(p.isNotNull(), F.lit(float("-inf"))))


def _skill(p: Column, clim: Column) -> Column:
    """1 - ln p / ln climatology, both moved by eps as published: |p - eps|, and the mean of |o - eps|."""
    return 1 - F.ln(F.abs(p - EPS)) / F.ln(clim * (1 - EPS) + (1 - clim) * EPS)


def lss() -> Column:
    """Mean of the term at the observed class; climatology is the observed frequency."""
    return F.avg(_skill(F.get("p", F.col("k")), F.get("clim", F.col("k"))))


def owls(classes: int = 3) -> Column:
    """lss less the mean over classes of the same term times the class's distance from the observed one."""
    away = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda j: F.when(j == F.col("k"), 0.0).otherwise(F.abs(j - F.col("k")) * _skill(F.get("p", j), F.get("clim", j))))
    return F.avg(_skill(F.get("p", F.col("k")), F.get("clim", F.col("k"))) - F.aggregate(away, F.lit(0.0), lambda a, x: a + x) / classes)


def _table(c: int) -> tuple[Column, Column, Column, Column]:
    """Hits, false alarms, misses, correct rejections of the most likely class."""
    count = lambda cond: F.sum(F.when(cond, 1.0).otherwise(0.0))
    f, k = F.col("f") == c, F.col("k") == c
    return count(f & k), count(f & ~k), count(~f & k), count(~f & ~k)


def hansen_kuiper(classes: int = 3) -> Column:
    """Hit rate less false alarm rate, mean over classes; NULL if a class never or always happens."""
    parts = [F.try_divide(a, a + c) - F.try_divide(b, b + d) for a, b, c, d in map(_table, range(classes))]
    return sum(parts[1:], parts[0]) / classes


def heidke(classes: int = 3, compat: bool = True) -> Column:
    """Mean over classes of (correct - expected) / (n - expected). With compat only the second expected term is divided by n."""
    parts = []
    for a, b, c, d in map(_table, range(classes)):
        n = a + b + c + d
        expected = (a + c) * (a + b) + (b + d) * (c + d) / n if compat else ((a + c) * (a + b) + (b + d) * (c + d)) / n
        parts.append(F.try_divide(a + d - expected, n - expected))
    return sum(parts[1:], parts[0]) / classes


def f1(classes: int = 3) -> Column:
    """Mean over classes of F1 of the most likely class; 0 where it is undefined."""
    parts = [F.coalesce(F.try_divide(2 * a, 2 * a + b + c), F.lit(0.0)) for a, b, c, _ in map(_table, range(classes))]
    return sum(parts[1:], parts[0]) / classes


def confusion(rows: DataFrame) -> DataFrame:
    """`lat, lon, observed, forecast, n`."""
    return rows.groupBy(*CELL, F.col("k").alias("observed"), F.col("f").alias("forecast")).agg(F.count(F.lit(1)).alias("n"))


def grocs(rows: DataFrame) -> DataFrame:
    """`lat, lon, grocs`: generalised discrimination over all pairs of samples whose observed classes differ.

    For k_i < k_j the chance that forecast j is above i, given that they differ: above half counts 1, half counts 1/2.
    The pairs are joined within a cell and added up at once.
    """
    whole = rows.where("gaps = 0")
    a, b = (whole.select(*CELL, F.col("k").alias(f"k{i}"), F.col("p").alias(f"p{i}")) for i in (1, 2))
    both = a.join(b, list(CELL)).where("k1 < k2")
    n = F.size("p1")
    above = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + F.get("p1", i) * F.aggregate(F.slice("p2", i + 2, n), F.lit(0.0), lambda t, v: t + v))
    same = F.aggregate(F.zip_with("p1", "p2", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    share = F.round(F.try_divide(above, 1 - same), 12)
    return both.groupBy(*CELL).agg(F.avg(F.when(share > 0.5, 1.0).when(share == 0.5, 0.5).otherwise(0.0)).alias("grocs"))


def by_class(rows: DataFrame) -> DataFrame:
    """`lat, lon, c, p, o, r`: a row per class and sample of complete cells, r the average rank of p."""
    return rows.where("gaps = 0").select(*CELL, F.posexplode(F.arrays_zip("p", "o")).alias("c", "x")).select(*CELL, "c", F.col("x.p").alias("p"), F.col("x.o").alias("o")).withColumn("r", avg_rank("p", *CELL, "c"))


def _mean_of_classes(rows: DataFrame, expression: Column, name: str) -> DataFrame:
    return by_class(rows).groupBy(*CELL, "c").agg(expression.alias("v")).groupBy(*CELL).agg(F.avg("v").alias(name))


def auc(rows: DataFrame) -> DataFrame:
    """Mean over classes of the area under the ROC curve, observation against probability, by rank sums."""
    n1, n = F.sum("o"), F.count(F.lit(1))
    return _mean_of_classes(rows, F.try_divide(F.sum(F.col("r") * F.col("o")) - n1 * (n1 + 1) / 2, n1 * (n - n1)), "auc")


def point_biserial(rows: DataFrame) -> DataFrame:
    return _mean_of_classes(rows, F.corr("o", "p"), "point_biserial")


def average_precision(rows: DataFrame) -> DataFrame:
    """Mean over classes of the sum of precision times gain in recall over descending thresholds; ties are one threshold."""
    steps = by_class(rows).groupBy(*CELL, "c", "p").agg(F.sum("o").alias("hits"), F.count(F.lit(1)).alias("m"))
    down = Window.partitionBy(*CELL, "c").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("precision", F.sum("hits").over(down) / F.sum("m").over(down))
    per = steps.groupBy(*CELL, "c").agg(F.try_divide(F.sum(F.col("precision") * F.col("hits")), F.sum("hits")).alias("v"))
    return per.groupBy(*CELL).agg(F.avg("v").alias("average_precision"))


def lift(function: Callable, returns: str = "double") -> Callable[[DataFrame], DataFrame]:
    """A metric from any Python function of two arrays (predictions, observations): `lat, lon, value` of continuous pairs.

    For functions that no Column expression states; runs once a cell on Arrow batches.
    """

    def run(pairs: DataFrame) -> DataFrame:
        @F.pandas_udf(returns)
        def own(p: pd.Series, o: pd.Series) -> float:
            return float(function(p.to_numpy(), o.to_numpy()))

        return pairs.where("gaps = 0").groupBy(*CELL).agg(own("p", "o").alias("value"))

    return run
