"""One model per cell: fits and scores in Arrow batches of cells, models kept as a table.

A cell's samples are gathered to one row (its time axis is short), so fitting is a map over rows after one shuffle by cell.
Cells with a missing value aren't sent to Python: they get a model with ok = false, and NULL forecasts. Random draws are
seeded by the cell's place, so results don't depend on partitioning.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.expr import CELL
from skyquilt.operators import kernels

MODEL = "lat double, lon double, kind string, ok boolean, p map<string,struct<shape:array<int>,data:array<double>>>"


def cells(x: DataFrame, y: DataFrame | None = None) -> DataFrame:
    """`lat, lon, samples array, x array<double>, width int, y array<double>, whole boolean`, samples and features ascending."""
    wide = x.groupBy(*CELL, "sample").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("f"), F.count("value").alias("have"), F.count(F.lit(1)).alias("all"))
    wide = wide.select(*CELL, "sample", F.transform("f", lambda v: v["value"]).alias("x"), (F.col("have") == F.col("all")).alias("full"))
    if y is not None:
        wide = wide.join(y.select(*CELL, "sample", F.col("value").alias("y")), [*CELL, "sample"]).withColumn("full", F.col("full") & F.col("y").isNotNull())
    else:
        wide = wide.withColumn("y", F.lit(None).cast("double"))
    rows = wide.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("sample", "x", "y"))).alias("s"), F.min("full").alias("whole"))
    return rows.select(*CELL, F.transform("s", lambda v: v["sample"]).alias("samples"), F.flatten(F.transform("s", lambda v: v["x"])).alias("x"), F.size(F.get("s", F.lit(0))["x"]).alias("width"), F.transform("s", lambda v: v["y"]).alias("y"), "whole")


def seed_of(lat: float, lon: float, seed: int) -> int:
    return zlib.crc32(struct.pack("<ddq", lat, lon, seed))


def _pack(model: dict) -> dict:
    return {k: {"shape": list(np.shape(v)), "data": np.asarray(v, float).ravel().tolist()} for k, v in model.items()}


def _unpack(p: dict) -> dict:
    return {k: np.array(v["data"], float).reshape(v["shape"]) for k, v in (p.items() if isinstance(p, dict) else p)}


def fit(x: DataFrame, y: DataFrame, kind: str, *, seed: int = 0, params: DataFrame | None = None, **fixed) -> DataFrame:
    """The model table. `params` (lat, lon, params map<string,string>) overrides parameters by cell."""
    if kind not in kernels.KINDS:
        raise ValueError(f"no kind of model {kind!r}")
    own_kind, activations = kernels.KINDS[kind], dict(kernels.ACTIVATIONS)
    gathered = cells(x, y)
    if params is not None:
        gathered = gathered.join(params.select(*CELL, "params"), list(CELL), "left")
    else:
        gathered = gathered.withColumn("params", F.lit(None).cast("map<string,string>"))

    def run(batches):
        import ast

        kernels.ACTIVATIONS.update(activations)

        def typed(text):
            try:
                return ast.literal_eval(text)
            except (ValueError, SyntaxError):
                return text

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                own = fixed | {k: typed(v) for k, v in dict(row.params or {}).items()}
                random = np.random.default_rng(seed_of(row.lat, row.lon, seed))
                try:
                    model = own_kind.fit(np.array(row.x, float).reshape(-1, row.width), np.array(row.y, float), random, **own)
                    out.append((row.lat, row.lon, kind, True, _pack(model)))
                except (ValueError, np.linalg.LinAlgError):
                    out.append((row.lat, row.lon, kind, False, {}))
            yield pd.DataFrame(out, columns=["lat", "lon", "kind", "ok", "p"])

    fitted = gathered.where("whole").select("lat", "lon", "x", "width", "y", "params").mapInPandas(run, MODEL)
    stubs = gathered.where("not whole").select("lat", "lon", F.lit(kind).alias("kind"), F.lit(False).alias("ok"), F.create_map().cast("map<string,struct<shape:array<int>,data:array<double>>>").alias("p"))
    return fitted.unionByName(stubs)


def _apply(models: DataFrame, x: DataFrame, function, labels: list[str]) -> DataFrame:
    """A value per label and sample: function(kind, model, matrix) -> n x labels, the kind an entry of kernels.KINDS."""
    kinds, activations = dict(kernels.KINDS), dict(kernels.ACTIVATIONS)
    joined = cells(x).select(*CELL, "samples", "x", "width", "whole").join(models, list(CELL))
    kind = x.schema["sample"].dataType.simpleString()

    def run(batches):
        kernels.ACTIVATIONS.update(activations)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                matrix = np.array([np.nan if v is None else v for v in row.x], float).reshape(-1, row.width)
                values = np.full((len(matrix), len(labels)), np.nan)
                rows = ~np.isnan(matrix).any(1)
                if row.ok and rows.any():
                    values[rows] = np.asarray(function(kinds[row.kind], _unpack(row.p), matrix[rows])).reshape(rows.sum(), len(labels))
                out.append((row.lat, row.lon, list(row.samples), values.ravel().tolist()))
            yield pd.DataFrame(out, columns=["lat", "lon", "samples", "v"])

    found = joined.mapInPandas(run, f"lat double, lon double, samples array<{kind}>, v array<double>")
    rows = found.select(*CELL, F.posexplode("samples").alias("i", "sample"), "v")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.nanvl(F.get("v", F.col("i") * len(labels) + k), F.lit(None).cast("double")).alias("value")) for k, n in enumerate(labels))))
    return rows.select(*CELL, "sample", each.alias("e")).select(*CELL, "sample", "e.feature", "e.value")


def _listed(value) -> list[float]:
    return [float(v) for v in (value if isinstance(value, (list, tuple, np.ndarray)) else [value])]


def predict(models: DataFrame, x: DataFrame, *, quantile: float | list[float] | None = None, **options) -> DataFrame:
    """A cube with feature '0'; of several quantiles with a feature each, named by it. Options go to the kernel."""
    if quantile is None or not isinstance(quantile, (list, tuple, np.ndarray)):
        given = options if quantile is None else options | {"quantile": float(quantile)}
        return _apply(models, x, lambda kind, m, v: kind.predict(m, v, **given), ["0"])
    levels = _listed(quantile)
    return _apply(models, x, lambda kind, m, v: np.column_stack([kind.predict(m, v, quantile=q, **options) for q in levels]), [str(q) for q in levels])


def predict_proba(models: DataFrame, x: DataFrame, *, quantile: float | list[float] | None = None, threshold: float | list[float] | None = None, **options) -> DataFrame:
    """Terciles as features BN, NN, AN; of quantiles of a cell's training values, or of thresholds, the probabilities of at
    most these, a feature each, named by quantile or threshold."""
    if quantile is None and threshold is None:
        return _apply(models, x, lambda kind, m, v: kind.proba(m, v, **options), ["BN", "NN", "AN"])
    if quantile is not None and threshold is not None:
        raise ValueError("either quantiles or thresholds")
    levels = _listed(threshold if quantile is None else quantile)
    if quantile is not None and not all(0 < q < 1 for q in levels):
        raise ValueError("quantiles lie between 0 and 1")

    def run(kind, m, v):
        if quantile is None:
            return kind.nonexceed(m, v, levels, **options)
        train = m["train"] if m["train"].ndim == 1 else m["train"][0]  # models of one feature each have the same values
        return kind.nonexceed(m, v, np.quantile(train, levels, method=kind.marks), **options)

    return _apply(models, x, run, [str(q) for q in levels])


def transform(models: DataFrame, x: DataFrame, n_components: int, **options) -> DataFrame:
    """A cube with features '0', '1', ... of what the kind's transform gives; of forests the leaf in each tree."""
    return _apply(models, x, lambda kind, m, v: kind.transform(m, v, **options)[:, :n_components], [str(k) for k in range(n_components)])


def activation(models: DataFrame, x: DataFrame, threshold: list[float]) -> DataFrame:
    """Of kind epoelm: the mean activation of all estimators at thresholds, a feature each."""
    return _apply(models, x, lambda kind, m, v: kernels.epoelm_activation(m, v, threshold), [str(float(q)) for q in threshold])


def density(models: DataFrame, x: DataFrame, threshold: list[float]) -> DataFrame:
    """Of kind epoelm: the predictand's density at thresholds, a feature each."""
    return _apply(models, x, lambda kind, m, v: np.column_stack([kernels.epoelm_density(m, v, q) for q in threshold]), [str(float(q)) for q in threshold])


def predict_linear(models: DataFrame, x: DataFrame) -> DataFrame:
    """Models of kind mlr scored by Column expressions: no Python."""
    wide = x.groupBy(*CELL, "sample").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("f"), F.count(F.lit(1)).alias("n"), F.count("value").alias("have"))
    coef = models.where("ok").select(*CELL, F.col("p")["coef"]["data"].alias("coef"), (F.col("p")["intercept"]["data"][0] > 0).alias("constant"))
    terms = F.zip_with(F.when(F.col("constant"), F.slice("coef", 2, 1 << 20)).otherwise(F.col("coef")), F.transform("f", lambda v: v["value"]), lambda a, b: a * b)
    value = F.aggregate(terms, F.when(F.col("constant"), F.get("coef", F.lit(0))).otherwise(0.0), lambda s, v: s + v)
    return wide.join(coef, list(CELL), "left").select(*CELL, "sample", F.lit("0").alias("feature"), F.when(F.col("n") == F.col("have"), value).alias("value"))


def tune(x: DataFrame, y: DataFrame, kind: str, genes: dict[str, list], *, seed: int = 0, generations: int = 10, score: Callable = kernels.kge) -> DataFrame:
    """`lat, lon, goodness, params map<string,string>`: evolutionary search per cell, seeded by its place, for the highest
    score(forecasts, values)."""
    own_kind, activations = kernels.KINDS[kind], dict(kernels.ACTIVATIONS)

    def run(batches):
        kernels.ACTIVATIONS.update(activations)
        kernels.KINDS[kind] = own_kind
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                random = np.random.default_rng(seed_of(row.lat, row.lon, seed))
                best, found = kernels.tune(kind, np.array(row.x, float).reshape(-1, row.width), np.array(row.y, float), genes, random, generations=generations, score=score)
                out.append((row.lat, row.lon, best, {k: v if isinstance(v, str) else repr(v) for k, v in found.items()}))
            yield pd.DataFrame(out, columns=["lat", "lon", "goodness", "params"])

    return cells(x, y).where("whole").select("lat", "lon", "x", "width", "y").mapInPandas(run, "lat double, lon double, goodness double, params map<string,string>")
