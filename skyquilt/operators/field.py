"""Whole-field methods: EOF, principal component regression, canonical correlation.

Fields aren't collected. Points (lat, lon, feature) hold their short time axis as an array; each task adds up sample x sample Gram
matrices of its points, and only their sum, the square of the number of samples, reaches the driver for an
eigen-decomposition. Loadings and forecasts are mapped back over the points.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.expr import CELL
from skyquilt.operators import kernels, models
from skyquilt.operators.core import settled

POINT = ("lat", "lon", "feature")
CUTOFF = 1e-6


def points(cube: DataFrame) -> DataFrame:
    """`lat, lon, feature, samples, v`: complete series that vary. Settled, as fits and forecasts read them several times."""
    rows = cube.groupBy(*POINT).agg(F.sort_array(F.collect_list(F.struct("sample", "value"))).alias("s"), F.count("value").alias("n"), F.count(F.lit(1)).alias("m"), F.stddev_pop("value").alias("sd"))
    return settled(rows.where("n = m and sd > 0").select(*POINT, F.transform("s", lambda x: x["sample"]).alias("samples"), F.transform("s", lambda x: x["value"]).alias("v")))


def standardised(v: np.ndarray, train: np.ndarray) -> np.ndarray:
    """points x samples by each point's mean and population deviation over `train`; points that don't vary there are 0."""
    mean, sd = v[:, train].mean(1, keepdims=True), v[:, train].std(1, keepdims=True)
    return np.where(sd > 0, (v - mean) / np.where(sd > 0, sd, 1), 0)


def grams(rows: DataFrame, folds: list[np.ndarray], *, by: str | None = None, latitude_weights: bool = False, other: str | None = None) -> dict[tuple, np.ndarray]:
    """(group, fold) -> sum over points of z z', z standardised over the fold's training samples.

    `other` names a second array column: then z comes from `v`'s statistics for both and the matrix is other x v.
    """

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for group, part in pdf.groupby(pdf[by] if by else np.zeros(len(pdf)), sort=False):
                v = np.stack(part["v"].to_list()).astype(float)
                w = np.sqrt(np.cos(np.radians(part["lat"].to_numpy(float))))[:, None] if latitude_weights else 1.0
                for f, train in enumerate(folds):
                    z = standardised(v, train) * w
                    left = z
                    if other:
                        mean, sd = v[:, train].mean(1, keepdims=True), v[:, train].std(1, keepdims=True)
                        left = (np.stack(part[other].to_list()).astype(float) - mean) / np.where(sd > 0, sd, 1) * w
                    total[group, f] = total.get((group, f), 0) + left.T @ z
        if total:
            yield pd.DataFrame([(str(g), f, r, m[r].tolist()) for (g, f), m in total.items() for r in range(len(m))], columns=["g", "f", "r", "row"])

    parts = rows.mapInPandas(run, "g string, f int, r int, row array<double>")
    summed = parts.select("g", "f", "r", F.posexplode("row").alias("c", "x")).groupBy("g", "f", "r", "c").agg(F.sum("x").alias("x"))
    out: dict[tuple, np.ndarray] = {}
    found = summed.toPandas()  # folds x samples x samples numbers a group
    for (g, f), part in found.groupby(["g", "f"]):
        m = np.zeros((part["r"].max() + 1, part["c"].max() + 1))
        m[part["r"], part["c"]] = part["x"]
        out[g, f] = m
    return out


def decompose(gram: np.ndarray, modes: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left vectors, singular values, and all singular values over their sum, of the field behind a Gram matrix.

    Values under CUTOFF of the largest are noise of the square root and are dropped. A vector's largest component is positive.
    """
    values, vectors = np.linalg.eigh(gram)
    s, u = np.sqrt(np.maximum(values[::-1], 0)), vectors[:, ::-1]
    keep = s > CUTOFF * s[0] if len(s) and s[0] > 0 else np.zeros(len(s), bool)
    s, u = s[keep], u[:, keep]
    share = s / s.sum() if len(s) else s
    return u[:, :modes], s[:modes], share[:modes]


@dataclass
class EOF:
    """Standardised points times sqrt(cos lat), by feature or pooled. Tables: loadings `lat, lon, feature, mode, value` (times the
    weights once more, as published), scores `feature, sample, mode, value`, variance `feature, mode, value` (s over the sum of s).

    A mode's sign makes its largest loading in size positive.
    """

    modes: int | None = None
    separate: bool = True
    latitude_weights: bool = True
    loadings: DataFrame | None = field(default=None, repr=False)
    variance: DataFrame | None = field(default=None, repr=False)
    stats: DataFrame | None = field(default=None, repr=False)
    scores: DataFrame | None = field(default=None, repr=False)

    def fit(self, cube: DataFrame) -> "EOF":
        spark, rows = cube.sparkSession, points(cube)
        head = rows.select(F.size("v").alias("n")).first()
        if head is None:
            raise ValueError("no point has complete data that vary")
        n, by = head[0], "feature" if self.separate else None
        everything, weights = np.arange(n), self.latitude_weights
        found = {g: decompose(m, self.modes) for (g, _), m in grams(rows, [everything], by=by, latitude_weights=weights).items()}
        project = {g: u / s for g, (u, s, _) in found.items()}

        def run(batches):
            for pdf in batches:
                out = []
                for group, part in pdf.groupby(pdf[by] if by else np.zeros(len(pdf)), sort=False):
                    w = np.sqrt(np.cos(np.radians(part["lat"].to_numpy(float))))[:, None] if weights else np.ones((len(part), 1))
                    values = standardised(np.stack(part["v"].to_list()).astype(float), everything) * w @ project[str(group)] * w
                    out += [(*k, v.tolist()) for k, v in zip(part[list(POINT)].itertuples(index=False, name=None), values)]
                yield pd.DataFrame(out, columns=[*POINT, "v"])

        raw = rows.mapInPandas(run, "lat double, lon double, feature string, v array<double>").select(*POINT, F.posexplode("v").alias("mode", "value"))
        keys = ["mode", "feature"] if self.separate else ["mode"]
        sign = raw.groupBy(*keys).agg(F.max("value").alias("hi"), F.min("value").alias("lo")).select(*keys, F.when(F.abs("hi") < F.abs("lo"), -1.0).otherwise(1.0).alias("sign"))
        self.loadings = raw.join(F.broadcast(sign), keys).select(*POINT, "mode", (F.col("value") * F.col("sign")).alias("value"))
        self.variance = spark.createDataFrame([(g if self.separate else "all", k, float(v)) for g, (_, _, share) in found.items() for k, v in enumerate(share)], "feature string, mode int, value double")
        self.stats = cube.groupBy(*POINT).agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
        self.scores = self.transform(cube)
        return self

    def _weight(self):
        return F.sqrt(F.cos(F.radians("lat"))) if self.latitude_weights else F.lit(1.0)

    def transform(self, cube: DataFrame) -> DataFrame:
        """Scores of any samples on the fitted loadings; points without loadings don't count."""
        z = (F.col("value") - F.col("mu")) / F.col("sd") * self._weight()
        joined = cube.join(self.stats, list(POINT)).select(*POINT, "sample", z.alias("z")).join(self.loadings, list(POINT))
        keys = [F.col("feature") if self.separate else F.lit("all").alias("feature"), "sample", "mode"]
        return joined.groupBy(*keys).agg(F.sum(F.col("z") * F.col("value")).alias("value"))

    def inverse_transform(self, scores: DataFrame) -> DataFrame:
        """The field of scores; divided by the weights twice, as loadings hold them twice."""
        s = scores.withColumnRenamed("value", "score")
        s = s if self.separate else s.drop("feature")
        joined = self.loadings.join(F.broadcast(s), ["feature", "mode"] if self.separate else ["mode"])
        field_ = joined.groupBy(*POINT, "sample").agg(F.sum(F.col("score") * F.col("value")).alias("f")).join(self.stats, list(POINT))
        w = self._weight()
        return field_.select(*POINT, "sample", (F.col("f") / (w * w) * F.col("sd") + F.col("mu")).alias("value"))


@dataclass
class PCR:
    """Scores of x's leading modes as predictors of every cell of y, by linear regression per cell."""

    modes: int = 3
    separate: bool = True
    eof: EOF | None = None
    models: DataFrame | None = field(default=None, repr=False)
    grid: DataFrame | None = field(default=None, repr=False)

    def _predictors(self, scores: DataFrame) -> DataFrame:
        label = F.concat_ws("/", F.col("feature"), F.lpad(F.col("mode").cast("string"), 3, "0"))
        return self.grid.crossJoin(F.broadcast(scores.select("sample", label.alias("feature"), "value"))).select(*CELL, "sample", "feature", "value")

    def fit(self, x: DataFrame, y: DataFrame, **params) -> "PCR":
        self.x, self.y = x, y
        self.eof = EOF(self.modes, self.separate).fit(x)
        self.grid = y.select(*CELL).distinct()
        self.models = models.fit(self._predictors(self.eof.scores), y, "mlr", **params)
        return self

    def predict(self, x: DataFrame) -> DataFrame:
        return models.predict_linear(self.models, self._predictors(self.eof.transform(x)))

    def predict_proba(self, x: DataFrame, **options) -> DataFrame:
        """Terciles, or at `quantile=` or `threshold=` as models.predict_proba has them."""
        return models.predict_proba(self.models, self._predictors(self.eof.transform(x)), **options)

    def report(self) -> dict[str, DataFrame]:
        """The tables behind a report: `loadings`, `scores` and `variance` of the modes, `skill`: correlation of forecasts of the
        training samples with y by cell."""
        p = self.predict(self.x).select(*CELL, "sample", F.col("value").alias("p"))
        skill = p.join(self.y.select(*CELL, "sample", F.col("value").alias("o")), [*CELL, "sample"]).groupBy(*CELL).agg(F.corr("p", "o").alias("value"))
        return {"loadings": self.eof.loadings, "scores": self.eof.scores, "variance": self.eof.variance, "skill": skill}


def cca_operator(gx: np.ndarray, gy: np.ndarray, train: np.ndarray, xmodes: int, ymodes: int, ccamodes: int) -> tuple[np.ndarray, int, tuple]:
    """M with: standardised forecast of y from a row g of gx (against `train`) = g M Z, Z the training samples of y; the
    number of canonical modes used; and what makes the canonical variates of x."""
    ux, sx, _ = decompose(gx[np.ix_(train, train)], xmodes)
    uy, sy, _ = decompose(gy[np.ix_(train, train)], ymodes)
    a, s, bt = np.linalg.svd((ux * sx).T @ (uy * sy), full_matrices=False)
    k = int((s[:ccamodes] > 0).sum())
    return ux / sx**2 @ a[:, :k] @ bt[:k] @ uy.T, k, (ux, sx, a[:, :k], uy, sy, bt[:k])


@dataclass
class CCA:
    """Canonical correlation between the leading modes of two fields, without latitude weights.

    With search the numbers of modes are those whose k-fold forecasts have the highest rank correlation with y over all points and samples:
    x and y modes in their ranges, canonical modes from 1 to the smaller of both and one above the upper end of `ccamodes`,
    as published. Error variance: squared k-fold errors over n - k - 1.
    """

    xmodes: tuple[int, int] = (1, 5)
    ymodes: tuple[int, int] = (1, 5)
    ccamodes: tuple[int, int] = (1, 3)
    splits: int | None = None
    search_override: tuple[int, int, int] | None = None
    chosen: tuple[int, int, int] | None = None

    def fit(self, x: DataFrame, y: DataFrame) -> "CCA":
        self.px, self.py = points(x), points(y)
        head = self.py.select("samples").first()
        if head is None:
            raise ValueError("no point of y has complete data that vary")
        self.samples, n = head[0], len(head[0])
        self.kind = y.schema["sample"].dataType.simpleString()
        self.folds = list(kernels.kfold(n, self.splits or max(2, n // 5)))
        trains = [t for t, _ in self.folds] + [np.arange(n)]
        self.gx = {f: m for (_, f), m in grams(self.px, trains).items()}
        self.gy = {f: m for (_, f), m in grams(self.py, trains).items()}
        combos = [self.search_override] if self.search_override else [(i, j, k) for i in range(self.xmodes[0], self.xmodes[1] + 1) for j in range(self.ymodes[0], self.ymodes[1] + 1) for k in range(1, min(i, j, self.ccamodes[1] + 1) + 1)]
        self.chosen = combos[0] if len(combos) == 1 else self._search(combos)
        n_modes = cca_operator(self.gx[len(self.folds)], self.gy[len(self.folds)], np.arange(n), *self.chosen)[1]
        self.dof = n - n_modes - 1
        return self

    def _cv(self, combo: tuple[int, int, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(train, test, rows x train matrix) of each fold."""
        return [(train, test, self.gx[f][np.ix_(test, train)] @ cca_operator(self.gx[f], self.gy[f], train, *combo)[0]) for f, (train, test) in enumerate(self.folds)]

    def _search(self, combos: list[tuple[int, int, int]]) -> tuple[int, int, int]:
        operators = [self._cv(c) for c in combos]

        def run(batches):
            for pdf in batches:
                v = np.stack(pdf["v"].to_list()).astype(float)
                rows = []
                for c, folds in enumerate(operators):
                    out = np.empty_like(v)
                    for train, test, m in folds:
                        z, sd = standardised(v, train), v[:, train].std(1, keepdims=True)
                        out[:, test] = z[:, train] @ m.T * sd + v[:, train].mean(1, keepdims=True)
                    rows.append(pd.DataFrame({"c": c, "p": out.ravel(), "o": v.ravel()}))
                yield pd.concat(rows)

        pairs = self.py.mapInPandas(run, "c int, p double, o double")
        from skyquilt.functions.expr import avg_rank

        ranked = pairs.select("c", avg_rank("p", "c").alias("rp"), avg_rank("o", "c").alias("ro"))
        goodness = {r[0]: r[1] for r in ranked.groupBy("c").agg(F.corr("rp", "ro")).collect()}
        return combos[max(range(len(combos)), key=lambda c: (goodness.get(c) if goodness.get(c) is not None else -999, -c))]

    def _forecast(self, matrix: np.ndarray, samples: list, levels: tuple[float, ...] = (1 / 3, 2 / 3)) -> DataFrame:
        """`lat, lon, feature, samples, mu, err_var, marks` of each point: marks are its quantiles at the levels; matrix is new
        samples x training samples."""
        cv = self._cv(self.chosen)

        def run(batches):
            for pdf in batches:
                v = np.stack(pdf["v"].to_list()).astype(float)
                errors = np.zeros(len(v))
                for train, test, m in cv:
                    z, sd = standardised(v, train), v[:, train].std(1, keepdims=True)
                    errors += ((z[:, train] @ m.T * sd + v[:, train].mean(1, keepdims=True) - v[:, test]) ** 2).sum(1)
                mu = standardised(v, np.arange(v.shape[1])) @ matrix.T * v.std(1, keepdims=True) + v.mean(1, keepdims=True)
                marks = np.quantile(v, levels, axis=1).T
                yield pd.DataFrame({"lat": pdf["lat"], "lon": pdf["lon"], "feature": pdf["feature"], "mu": mu.tolist(), "err_var": errors / self_dof if self_dof > 0 else np.nan, "marks": marks.tolist()})

        self_dof = self.dof
        found = self.py.select(*POINT, "v").mapInPandas(run, "lat double, lon double, feature string, mu array<double>, err_var double, marks array<double>")
        names = self.py.sparkSession.createDataFrame([(samples,)], f"samples array<{self.kind}>")
        return found.crossJoin(F.broadcast(names))

    def _matrix(self, x: DataFrame | None) -> tuple[np.ndarray, list]:
        full = len(self.folds)
        operator = cca_operator(self.gx[full], self.gy[full], np.arange(len(self.samples)), *self.chosen)[0]
        if x is None:
            return self.gx[full] @ operator, self.samples
        new = points_like(x, self.px)
        cross = grams(new, [np.arange(len(self.samples))], other="u")
        return next(iter(cross.values())) @ operator, new.select("new_samples").first()[0]

    def predict(self, x: DataFrame | None = None) -> DataFrame:
        """Of the training samples, or of x's; points of x that fitting didn't use don't count."""
        out = self._forecast(*self._matrix(x)).select(*POINT, F.posexplode("samples").alias("i", "sample"), "mu")
        return out.select(*POINT, "sample", F.get("mu", F.col("i")).alias("value"))

    def predict_proba(self, x: DataFrame | None = None, *, quantile: float | list[float] | None = None) -> DataFrame:
        """Terciles as features BN, NN, AN, or the probabilities of at most a point's quantiles, a feature each."""
        from skyquilt.functions.expr import t_cdf

        levels = (1 / 3, 2 / 3) if quantile is None else tuple(models._listed(quantile))
        out = self._forecast(*self._matrix(x), levels).select(*POINT, F.posexplode("samples").alias("i", "sample"), "mu", "err_var", "marks")
        mu, scale, dof = F.get("mu", F.col("i")), F.sqrt("err_var"), F.lit(self.dof)
        p = [t_cdf((F.get("marks", F.lit(k)) - mu) / scale, dof) for k in range(len(levels))]
        named = list(zip(map(str, levels), p)) if quantile is not None else [("BN", p[0]), ("NN", p[1] - p[0]), ("AN", 1 - p[1])]
        each = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in named)))
        return out.select(*CELL, "sample", each.alias("e")).select(*CELL, "sample", "e.feature", "e.value")

    def error_variance(self) -> DataFrame:
        return self._forecast(*self._matrix(None)).select(*POINT, F.col("err_var").alias("value"))

    def report(self) -> dict[str, DataFrame]:
        """The tables behind a report: loadings of both fields' modes and canonical variates (correlation of a point's series with
        a score) as `x_eof`, `y_eof`, `x_cca`, `y_cca` with `lat, lon, feature, mode, value`; the scores as `<name>_scores` with
        `sample, mode, value`; and `canonical_correlations`: `mode, value`."""
        spark, found, out = self.py.sparkSession, self.patterns(), {}
        for name in ("x_eof", "y_eof", "x_cca", "y_cca"):
            scores = found[f"{name}_scores"]
            rows = [(self.samples[i], k, float(v)) for (i, k), v in np.ndenumerate(scores)]
            out[f"{name}_scores"] = spark.createDataFrame(rows, f"sample {self.kind}, mode int, value double")
            unit = (scores - scores.mean(0)) / scores.std(0)

            def run(batches, unit=unit):
                for pdf in batches:
                    z = standardised(np.stack(pdf["v"].to_list()).astype(float), np.arange(len(unit)))
                    yield pd.DataFrame({"lat": pdf["lat"], "lon": pdf["lon"], "feature": pdf["feature"], "l": (z @ unit / len(unit)).tolist()})

            loadings = (self.px if name[0] == "x" else self.py).select(*POINT, "v").mapInPandas(run, "lat double, lon double, feature string, l array<double>")
            out[name] = loadings.select(*POINT, F.posexplode("l").alias("mode", "value"))
        rows = [(k, float(v)) for k, v in enumerate(found["canonical_correlations"])]
        return out | {"canonical_correlations": spark.createDataFrame(rows, "mode int, value double")}

    def patterns(self) -> dict[str, np.ndarray]:
        """Of the training samples: scores of both fields' modes and canonical variates, and canonical correlations."""
        full = len(self.folds)
        _, _, (ux, sx, a, uy, sy, bt) = cca_operator(self.gx[full], self.gy[full], np.arange(len(self.samples)), *self.chosen)
        return {"x_eof_scores": ux * sx, "y_eof_scores": uy * sy, "x_cca_scores": ux @ a, "y_cca_scores": uy @ bt.T, "canonical_correlations": np.linalg.svd(ux.T @ uy, compute_uv=False)[: a.shape[1]]}


def points_like(x: DataFrame, fitted: DataFrame) -> DataFrame:
    """The fitted points with the series `u` of x at them and its samples."""
    rows = x.groupBy(*POINT).agg(F.sort_array(F.collect_list(F.struct("sample", "value"))).alias("s"))
    rows = rows.select(*POINT, F.transform("s", lambda v: v["sample"]).alias("new_samples"), F.transform("s", lambda v: v["value"]).alias("u"))
    return fitted.join(rows, list(POINT))
