"""Hindcasts: forecast all cross-validation folds in one plan, score them per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquilt.functions.expr import CELL
from skyquilt.operators import folds, mlr, verify
from skyquilt.operators.ensemble import Ensemble
from skyquilt.operators.prep import OneHotEncoder, drymask
from skyquilt.operators.select import apply_mask


def ensemble_rpss(x: DataFrame, y: DataFrame, *, dry_threshold: float | None = None) -> DataFrame:
    """`lat, lon, rpss` of raw tercile shares against climatology; cells under the dry threshold are left out."""
    if dry_threshold is not None:
        y = apply_mask(y, drymask(y, dry_threshold=dry_threshold))
    rows = verify.probabilistic(Ensemble().fit(x).predict_proba(x), OneHotEncoder().fit(y).transform(y))
    return verify.score_cells(rows, {"rpss": verify.rpss()})


def mlr_pearson(x: DataFrame, y: DataFrame, window: int = 3) -> DataFrame:
    """`lat, lon, pearson` of cross-validated regression."""
    predicted = mlr.cross_validated(x, y, folds.circular(y, window))
    return verify.score(verify.continuous(predicted, y), {"pearson": verify.pearson()})


def ensemble_report(x: DataFrame, y: DataFrame) -> DataFrame:
    """`lat, lon` and every probabilistic score that is one aggregate, in one pass."""
    rows = verify.probabilistic(Ensemble().fit(x).predict_proba(x), OneHotEncoder().fit(y).transform(y))
    return verify.score_cells(rows, {f.__name__: f() for f in (verify.rps, verify.rpss, verify.brier_score, verify.lss, verify.owls, verify.f1)}).select(*CELL, *(F.col(c) for c in ("rps", "rpss", "brier_score", "lss", "owls", "f1")))
