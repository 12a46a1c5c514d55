import itertools
from collections import Counter
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.operators import diagnostics, field, folds, kernels, mlr, models, prep, verify
from skyquilt.operators.ensemble import ACPAC, Ensemble
from skyquilt.plans import hindcast
from skyquilt.sources import parameters

from .cubes import array, counted, cube, days

RNG = np.random.default_rng(1)
CLASSES = ["BN", "NN", "AN"]
X = RNG.normal(size=(2, 2, 20, 3))
Y = X.mean(-1, keepdims=True) * 2 + RNG.normal(size=(2, 2, 20, 1)) + 5


def probabilities(n):
    p = RNG.dirichlet(np.ones(3), size=n)
    k = RNG.integers(0, 3, n)
    k[:3] = [0, 1, 2]
    return p, np.eye(3)[k], k


# ---- ensembles -----------------------------------------------------------------------------------------------


def test_ensemble_counts_missing_members(spark):
    x = X.copy()
    x[0, 0, 4, 1] = np.nan
    got = array(Ensemble().fit(cube(spark, x)).predict_proba(cube(spark, x)), CLASSES)
    lo, hi = (np.nanquantile(x.reshape(2, 2, -1), q, axis=-1, method="midpoint")[..., None, None] for q in (1 / 3, 2 / 3))
    with np.errstate(invalid="ignore"):
        bn, an = (x <= lo).mean(-1), (x > hi).mean(-1)
    assert got == pytest.approx(np.stack([bn, 1 - bn - an, an], axis=-1))
    assert array(Ensemble().predict(cube(spark, x)))[..., 0] == pytest.approx(np.nanmean(x, -1))


def test_acpac(spark):
    model = ACPAC().fit(cube(spark, X), cube(spark, Y))
    raw = array(Ensemble().fit(cube(spark, X)).predict_proba(cube(spark, X)), CLASSES)
    obs = array(prep.OneHotEncoder().fit(cube(spark, Y)).transform(cube(spark, Y)), CLASSES)
    sd = obs.std(2, keepdims=True) / raw.std(2, keepdims=True)
    pac = ((obs - 0.333) * (raw - 0.333)).mean(2, keepdims=True) / np.sqrt(((obs - 0.333) ** 2 * raw**2).mean(2, keepdims=True))
    p = raw * sd * pac
    for _ in range(3):
        for low in (True, False):
            e = np.where(p < 0, p - 0.01, 0) if low else np.where(p > 1, p - 0.99, 0)
            p = p + (e.sum(-1, keepdims=True) - e) / 2
        p = p - (p.sum(-1, keepdims=True) - 1) / 3
    assert array(model.predict_proba(cube(spark, X)), CLASSES) == pytest.approx(p)
    clim = Y.mean(-1).mean(-1)[..., None, None]
    a = ((X - clim) * (Y.mean(-1, keepdims=True) - clim)).mean(2) / (X - clim).std(2) ** 2
    assert array(model.predict(cube(spark, X)))[..., 0] == pytest.approx((X * a[:, :, None]).mean(-1))


# ---- regression ----------------------------------------------------------------------------------------------


def test_single_predictor_regression_agrees_with_kernel(spark):
    x, y = cube(spark, X), cube(spark, Y)
    table = mlr.fit(x, y)
    got = array(mlr.predict_proba(table, x), CLASSES)
    for i in range(2):
        for j in range(2):
            m = kernels.mlr_fit(X[i, j].mean(-1, keepdims=True), Y[i, j, :, 0], None)
            row = table.where(f"lat = {i} and lon = {j}").first()
            assert (row.intercept, row.slope, row.err_var) == pytest.approx((*m["coef"], m["err_var"][0]))
            assert got[i, j] == pytest.approx(kernels.mlr_proba(m, X[i, j].mean(-1, keepdims=True)))
    adjusted = array(mlr.predict_proba(table, x, "adjusted_error_variance"), CLASSES)
    m = kernels.mlr_fit(X[1, 0].mean(-1, keepdims=True), Y[1, 0, :, 0], None)
    assert adjusted[1, 0] == pytest.approx(kernels.mlr_proba(m, X[1, 0].mean(-1, keepdims=True), adjusted=True))
    cv = array(mlr.cross_validated(x, y, folds.circular(y, 3)))
    rest = [i for i in range(20) if i not in (4, 5, 6)]
    m = kernels.mlr_fit(X[0, 1, rest].mean(-1, keepdims=True), Y[0, 1, rest, 0], None)
    assert cv[0, 1, 5, 0] == pytest.approx(kernels.mlr_predict(m, X[0, 1, [5]].mean(-1, keepdims=True))[0])
    full = mlr.fit(x, y, refit="full").where("lat = 0 and lon = 0").first()
    assert (full.slope, full.intercept) == pytest.approx(tuple(np.polyfit(X[0, 0].mean(-1), Y[0, 0, :, 0], 1)))


def test_models_per_cell(spark):
    x, gaps = cube(spark, X), Y.copy()
    gaps[0, 0, 3] = np.nan
    y = cube(spark, gaps)
    table = models.fit(x, y, "mlr")
    assert sorted((r.lat, r.lon, r.ok) for r in table.collect()) == [(0, 0, False), (0, 1, True), (1, 0, True), (1, 1, True)]
    by_expression, by_python = array(models.predict_linear(table, x)), array(models.predict(table, x))
    assert np.isnan(by_expression[0, 0]).all() and by_expression == pytest.approx(by_python, nan_ok=True)
    for kind in ("elm", "epoelm", "melr", "elr", "qrf", "rf_classifier"):
        fixed = {"n_estimators": 7} if kind not in ("melr", "elr") else {}
        a = array(models.predict_proba(models.fit(x, y, kind, **fixed), x), CLASSES)
        b = array(models.predict_proba(models.fit(x.repartition(3), y.repartition(5), kind, **fixed), x), CLASSES)
        assert np.isnan(a[0, 0]).all() and a[0, 1].sum(-1) == pytest.approx(np.ones(20))
        assert a == pytest.approx(b, nan_ok=True), kind
    with pytest.raises(ValueError):
        models.fit(x, y, "nothing")


def test_kernels_learn(spark):
    x = RNG.normal(size=(200, 2))
    y = 3 * x[:, 0] - x[:, 1] + 0.3 * RNG.normal(size=200) + 4
    r = lambda: np.random.default_rng(0)
    third = kernels.classes_of(y)
    for kind in ("elm", "epoelm", "qrf", "rf_regressor"):
        model = kernels.KINDS[kind].fit(x, y, r(), **({"n_estimators": 20} if "elm" not in kind else {}))
        if kind == "epoelm":
            p = kernels.epoelm_proba(model, x)
        else:
            assert np.corrcoef(kernels.KINDS[kind].predict(model, x), y)[0, 1] > 0.8, kind
            continue
        assert (p.argmax(1) == third).mean() > 0.5
    for kind in ("melr", "elr", "mlr", "rf_classifier"):
        model = kernels.KINDS[kind].fit(x, y, r(), **({"n_estimators": 20} if kind == "rf_classifier" else {}))
        assert (kernels.KINDS[kind].proba(model, x).argmax(1) == third).mean() > 0.5, kind
    m = kernels.KINDS["nan_classifier"]
    assert np.isnan(m.proba(m.fit(x, y, r()), x)).all()
    counts = RNG.poisson(np.exp(0.5 + 0.8 * x[:, 0]))
    assert kernels.irls(x, counts.astype(float), "poisson") == pytest.approx([0.5, 0.8, 0], abs=0.15)
    amounts = RNG.gamma(5, np.exp(1 + 0.5 * x[:, 1]) / 5)
    assert kernels.irls(x, amounts, "gamma") == pytest.approx([1, 0, 0.5], abs=0.15)
    hits = (RNG.random(200) < kernels.expit(1 + 2 * x[:, 0])).astype(float)
    beta = kernels.irls(x, hits, "binomial")
    design = np.column_stack([np.ones(200), x])
    assert design.T @ (hits - kernels.expit(design @ beta)) == pytest.approx(np.zeros(3), abs=1e-6)
    nb = kernels.nb_fit(np.abs(x), y, r())
    assert kernels.nb_proba(nb, np.abs(x)).sum(1) == pytest.approx(np.ones(200))
    assert kernels.insert_zeros(np.ones((2, 1)), [1], 3).tolist() == [[0, 1, 0]] * 2
    model = kernels.epoelm_fit(x, y, r(), encoding="binary", initialization="uniform", standardize_y=True)
    low, high = kernels.epoelm_nonexceed(model, x, (y.mean() - 1, y.mean() + 1)).T
    assert (high >= low).mean() > 0.99 and (kernels.epoelm_density(model, x, y.mean()) > 0).all()
    assert (kernels.epoelm_crps(model, x[:5], y[:5]) >= 0).all()
    with pytest.raises(ValueError):
        kernels.epoelm_fit(x, np.ones(200), r())


def test_forest_leaves_partition_training_rows():
    x, y = RNG.normal(size=(60, 3)), RNG.normal(size=60).round(1)
    model = kernels.forest_fit(x, y, np.random.default_rng(0), n_estimators=5, min_leaf=3)
    for tree, leaves in zip(model["trees"], model["leaves"]):
        assert (tree[leaves.astype(int), 0] == -1).all()
    new = RNG.normal(size=(20, 3))
    ends = kernels.forest_leaves(model, new)
    assert ends.shape == (20, 5)
    for i, row in enumerate(ends):
        pooled = np.concatenate([y[model["leaves"][t] == leaf] for t, leaf in enumerate(row)])
        for q in (0.0, 0.1, 0.3, 0.5, 0.95, 1.0):
            assert kernels.qrf_predict(model, new, q)[i] == pytest.approx(np.quantile(pooled, q))
        assert kernels.qrf_nonexceed(model, new, [0.0, 0.4])[i] == pytest.approx([(pooled < 0.0).mean(), (pooled < 0.4).mean()])


def test_quantiles_thresholds_and_kinds_of_ones_own(spark):
    x, y = cube(spark, X), cube(spark, Y)
    forest = models.fit(x, y, "qrf", n_estimators=10)
    several = models.predict(forest, x, quantile=[0.1, 0.9])
    low = models.predict(forest, x, quantile=0.1).where("value is not null").collect()
    by = {(r.lat, r.lon, r.sample): r.value for r in several.where("feature = '0.1'").collect()}
    assert low and all(by[r.lat, r.lon, r.sample] == pytest.approx(r.value) for r in low)
    for kind in ("mlr", "melr", "elr", "qrf", "epoelm"):
        fitted = models.fit(x, y, kind)
        rows = models.predict_proba(fitted, x, quantile=[0.25, 0.75]).where("value is not null").groupBy("lat", "lon", "sample").pivot("feature", ["0.25", "0.75"]).max("value").collect()
        assert rows and all(-1e-9 <= r["0.25"] <= r["0.75"] + 1e-9 <= 1 + 1e-8 for r in rows), kind
        assert models.predict_proba(fitted, x, threshold=1.0).select("feature").distinct().collect()[0][0] == "1.0"
    with pytest.raises(ValueError):
        models.predict_proba(forest, x, quantile=0.5, threshold=1.0)
    leaves = models.transform(forest, x, 3)
    assert {r[0] for r in leaves.select("feature").distinct().collect()} == {"0", "1", "2"}
    kernels.register("middle", kernels.Kind(lambda x, y, random: {"m": np.array([np.median(y)])}, lambda m, x: np.full(len(x), m["m"][0])))
    kernels.register_activation("cube", lambda a: a**3)
    try:
        assert models.predict(models.fit(x, y, "middle"), x).where("value is not null").count() == len(low)
        assert models.predict(models.fit(x, y, "elm", activation="cube"), x).where("value is not null").count() == len(low)
        found = models.tune(x, y, "elm", {"hidden": [2, 3], "activation": ["cube", "tanh"]}, generations=1, score=lambda p, o: -float(abs(p - o).mean()))
        assert all(r.goodness <= 0 for r in found.collect())
    finally:
        del kernels.KINDS["middle"], kernels.ACTIVATIONS["cube"]


def test_exact_p_of_kendall():
    table = {(n, d): p for n, d, p in verify._inversions(8)}
    for n in (2, 4, 6):
        counts = Counter(sum(a > b for i, a in enumerate(q) for b in q[i + 1 :]) for q in itertools.permutations(range(n)))
        for d in range(n * (n - 1) // 4 + 1):
            assert table[n, d] == pytest.approx(min(1, 2 * sum(c for k, c in counts.items() if k <= d) / sum(counts.values())))


def test_p_of_kendall_with_ties(spark):
    """tau = 1 - 2 * 1 / 5.48 ...: by hand from scipy's formula for x = 1 2 2 3 4, y = 1 3 2 2 5."""
    x, y = [1, 2, 2, 3, 4], [1, 3, 2, 2, 5]
    pairs = spark.createDataFrame([(0.0, 0.0, k, "f", float(a), float(b), 0) for k, (a, b) in enumerate(zip(x, y))], "lat double, lon double, sample int, feature string, p double, o double, gaps int")
    r = verify.kendall_tau(pairs, p_value=True).first()
    s = sum(np.sign(x[j] - x[i]) * np.sign(y[j] - y[i]) for i in range(5) for j in range(i + 1, 5))
    variance = (5 * 4 * 15 - 2 * 9 - 2 * 9) / 18 + 2 * 2 / (2 * 20)
    assert r.kendall_tau == pytest.approx(s / 9) and r.kendall_p == pytest.approx(math.erfc(abs(s) / math.sqrt(variance) / math.sqrt(2)))


def test_tuning_and_parameter_files(spark, tmp_path):
    genes = {"hidden": [2, 4], "regularization": [-10, 0], "activation": ["relu", "lin"]}
    found = models.tune(cube(spark, X), cube(spark, Y), "elm", genes, generations=2)
    rows = sorted(found.collect())
    assert rows == sorted(models.tune(cube(spark, X).repartition(3), cube(spark, Y), "elm", genes, generations=2).collect())
    assert all(r.goodness < 1 and set(r.params) == set(genes) for r in rows)
    assert models.fit(cube(spark, X), cube(spark, Y), "elm", params=found).where("ok").count() == 4
    parameters.save_parameters_text(found, str(tmp_path / "t"))
    assert [(r.lat, r.lon, r.params) for r in parameters.load_parameters(spark, str(tmp_path / "t")).collect()] == [(r.lat, r.lon, r.params) for r in rows]
    (tmp_path / "p").write_text("1.0 2.0 {'a': 1, 'b': None, 'c': True}\n0.0 2.0 nan\n")
    assert [r.params for r in parameters.load_parameters(spark, str(tmp_path / "p")).collect()] == [{}, {"a": "1", "b": None, "c": "true"}]
    parameters.save_parameters(found, str(tmp_path / "j"))
    assert spark.read.schema("lat double, lon double, params map<string,string>").json(str(tmp_path / "j")).count() == 4


# ---- fields --------------------------------------------------------------------------------------------------


def field_cube(spark):
    t = RNG.normal(size=(2, 12))
    v = np.einsum("ijm,mk->ijk", RNG.normal(size=(4, 3, 2)), t) + 0.1 * RNG.normal(size=(4, 3, 12)) + 10
    return cube(spark, v[..., None], lats=[-20.0, 0.0, 20.0, 40.0]), v


def test_eof(spark):
    c, v = field_cube(spark)
    z = ((v - v.mean(-1, keepdims=True)) / v.std(-1, keepdims=True) * np.sqrt(np.cos(np.radians([-20, 0, 20, 40])))[:, None, None]).reshape(12, 12)
    _, s, vt = np.linalg.svd(z.T, full_matrices=False)
    eof = field.EOF(3).fit(c)
    share = [r.value for r in eof.variance.orderBy("mode").collect()]
    keep = s > 1e-6 * s[0]
    assert share == pytest.approx((s / s[keep].sum())[:3], rel=1e-6)
    weights = np.repeat(np.sqrt(np.cos(np.radians([-20, 0, 20, 40]))), 3)
    rows = eof.loadings.where("mode = 0").orderBy("lat", "lon").collect()
    got = np.array([r.value for r in rows])
    assert abs(got) == pytest.approx(abs(vt[0] * weights), abs=1e-8) and abs(got.max()) >= abs(got.min())
    scores = np.array([r.value for r in eof.scores.where("mode = 0").orderBy("sample").collect()])
    assert abs(scores) == pytest.approx(abs(z.T @ (vt[0] * weights)), abs=1e-8)
    plain = field.EOF(None, latitude_weights=False).fit(c)
    assert array(plain.inverse_transform(plain.scores)) == pytest.approx(v[..., None], abs=1e-6)
    pooled = field.EOF(2, separate=False).fit(c.unionAll(c.withColumn("feature", F.lit("g"))))
    assert pooled.scores.select("feature").distinct().collect()[0][0] == "all" and pooled.scores.count() == 24


def test_pcr_and_cca(spark):
    c, v = field_cube(spark)
    y = cube(spark, (v[:2] * 1.5 + 0.05 * RNG.normal(size=(2, 3, 12)))[..., None], lats=[1.0, 2.0])
    pcr = field.PCR(2).fit(c, y)
    assert np.corrcoef(array(pcr.predict(c)).ravel(), array(y).ravel())[0, 1] > 0.95
    assert array(pcr.predict_proba(c), CLASSES).sum(-1) == pytest.approx(np.ones((2, 3, 12)))
    cca = field.CCA(search_override=(2, 2, 2)).fit(c, y)
    fitted = array(cca.predict())
    assert np.corrcoef(fitted.ravel(), array(y).ravel())[0, 1] > 0.95
    assert array(cca.predict(c)) == pytest.approx(fitted)
    assert array(cca.predict_proba(), CLASSES).sum(-1) == pytest.approx(np.ones((2, 3, 12)))
    assert (np.array([r.value for r in cca.error_variance().collect()]) > 0).all()
    assert cca.patterns()["canonical_correlations"][0] <= 1 + 1e-9
    assert field.CCA(xmodes=(1, 2), ymodes=(1, 2)).fit(c, y).chosen[0] == 2

    # against the direct method: decompositions of whole matrices
    zx, zy = (((a - a.mean(0)) / a.std(0)) for a in (v.reshape(12, 12).T, array(y)[..., 0].reshape(6, 12).T))
    ux, sx, vx = np.linalg.svd(zx, full_matrices=False)
    uy, sy, vy = np.linalg.svd(zy, full_matrices=False)
    a, _, bt = np.linalg.svd((zx @ vx[:2].T).T @ (zy @ vy[:2].T))
    want = zx @ vx[:2].T / sx[:2] @ a @ bt * sy[:2] @ vy[:2] * array(y)[..., 0].reshape(6, 12).T.std(0) + array(y)[..., 0].reshape(6, 12).T.mean(0)
    assert fitted[..., 0].reshape(6, 12).T == pytest.approx(want, abs=1e-6)


# ---- metrics -------------------------------------------------------------------------------------------------


def pairs_of(spark, p, o):
    return verify.continuous(cube(spark, p[None, None, :, None]), cube(spark, o[None, None, :, None]))


def kendall(p, o):
    i, j = np.triu_indices(len(p), 1)
    x, y = np.sign(p[j] - p[i]), np.sign(o[j] - o[i])
    return (x * y).sum() / math.sqrt(abs(x).sum() * abs(y).sum())


def test_continuous_metrics(spark):
    o = RNG.normal(size=15) + 4
    p = (o + RNG.normal(size=15)).round(1)
    n, sse, r = 15, ((p - o) ** 2).sum(), np.corrcoef(p, o)[0, 1]
    a, b = p.var() / o.var(), p.mean() / o.mean()
    ll = -n / 2 * (1 + math.log(2 * math.pi)) - n / 2 * math.log(sse / n)
    want = {"pearson": r, "nse": 1 - sse / ((o - o.mean()) ** 2).sum(), "kge": 1 - math.sqrt((r - 1) ** 2 + (a - 1) ** 2 + (b - 1) ** 2), "kge_components": (r + a + b) / 3, "index_of_agreement": 1 - sse / ((abs(p - p.mean()) + abs(o - p.mean())) ** 2).sum(), "bias_ratio": b, "ncrmse": (p - o).std() / o.mean(), "mape": (abs(o - p) / abs(o)).mean(), "log_likelihood": ll, "aic": -2 * ll + 2, "bic": -2 * ll + math.log(n)}
    want["nnse"] = 1 / (2 - want["nse"])
    t = abs(r) * math.sqrt(13 / (1 - r * r))
    want["pearson_p"] = 2 * (1 - kernels.t_cdf(np.array([t]), 13)[0])
    row = verify.score(pairs_of(spark, p, o), {k: getattr(verify, k)() for k in want}).first()
    for k, v in want.items():
        assert row[k] == pytest.approx(v), k
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    ranked = verify.score(verify.ranked(pairs_of(spark, p, o)), {"s": verify.spearman(), "q": verify.spearman_p()}).first()
    assert ranked.s == pytest.approx(np.corrcoef(rank(p), rank(o))[0, 1]) and 0 <= ranked.q <= 1
    assert verify.kendall_tau(pairs_of(spark, p, o)).first().kendall_tau == pytest.approx(kendall(p, o))
    own = verify.lift(lambda p, o: np.abs(p - o).max())(pairs_of(spark, p, o)).first().value
    assert own == pytest.approx(abs(p - o).max())


def test_bounds_and_gaps(spark):
    o = RNG.normal(size=9)
    names = ("pearson", "nse", "kge", "index_of_agreement")
    same = verify.score(pairs_of(spark, o, o), {k: getattr(verify, k)() for k in names}).first()
    assert [same[k] for k in names] == pytest.approx([1] * 4)
    assert verify.score(pairs_of(spark, -o, o), {"r": verify.pearson()}).first().r == pytest.approx(-1)
    gap = o.copy()
    gap[2] = np.nan
    assert verify.score(pairs_of(spark, o, gap), {"r": verify.pearson(), "b": verify.bias_ratio()}).first()[2:] == (None, None)
    flat = verify.score(pairs_of(spark, o, np.zeros(9)), {"n": verify.ncrmse(), "e": verify.nse()}).first()
    assert (flat.n, flat.e) == (None, None)


def test_probabilistic_metrics(spark):
    p, o, k = probabilities(25)
    rows = verify.probabilistic(cube(spark, p[None, None], features=CLASSES), cube(spark, o[None, None], features=CLASSES))
    f, clim = p.argmax(1), o.mean(0)
    eps = verify.EPS
    skill = 1 - np.log(abs(p - eps)) / np.log(abs(o - eps).mean(0))
    hit = np.array([[((f == c) & (k == c)).sum(), ((f == c) & (k != c)).sum(), ((f != c) & (k == c)).sum(), ((f != c) & (k != c)).sum()] for c in range(3)], float)
    a, b, c_, d = hit.T
    own = skill[np.arange(25), k]
    distance = abs(np.arange(3) - k[:, None])
    expected = ((a + c_) * (a + b) + (b + d) * (c_ + d)) / 25
    want = {"rps": ((p - o) ** 2).sum(1).mean(), "rpss": 1 - ((p - o) ** 2).sum() / ((0.333 - o) ** 2).sum(), "brier_score": ((p - o) ** 2).mean(), "ignorance": -np.log(p[np.arange(25), k]).mean(), "lss": own.mean(), "owls": (own - (distance * skill).mean(1)).mean(), "hansen_kuiper": (a / (a + c_) - b / (b + d)).mean(), "f1": (2 * a / (2 * a + b + c_)).mean()}
    row = verify.score_cells(rows, {n: getattr(verify, n)() for n in want}).first()
    for n, v in want.items():
        assert row[n] == pytest.approx(v), n
    assert clim.sum() == pytest.approx(1)
    h = verify.score_cells(rows, {"h": verify.heidke(compat=False)}).first().h
    assert h == pytest.approx(((a + d - expected) / (25 - expected)).mean())
    i, j = np.array([(i, j) for i in range(25) for j in range(25) if k[i] < k[j]]).T
    s = (p[i, 0] * (p[j, 1] + p[j, 2]) + p[i, 1] * p[j, 2]) / (1 - (p[i] * p[j]).sum(1))
    assert verify.grocs(rows).first().grocs == pytest.approx(np.where(s > 0.5, 1, np.where(s == 0.5, 0.5, 0)).mean())
    auc = np.mean([np.mean([(x > y) + 0.5 * (x == y) for x in p[k == c, c] for y in p[k != c, c]]) for c in range(3)])
    assert verify.auc(rows).first().auc == pytest.approx(auc)
    assert verify.point_biserial(rows).first().point_biserial == pytest.approx(np.mean([np.corrcoef(o[:, c], p[:, c])[0, 1] for c in range(3)]))
    order = [np.argsort(-p[:, c]) for c in range(3)]
    ap = np.mean([(np.cumsum(o[r, c]) / np.arange(1, 26) * o[r, c]).sum() / o[:, c].sum() for c, r in enumerate(order)])
    assert verify.average_precision(rows).first().average_precision == pytest.approx(ap)
    assert verify.confusion(rows).agg(F.sum("n")).first()[0] == 25


def test_diagnostics(spark):
    p, o, _ = probabilities(40)
    pc, oc = cube(spark, p[None, None], features=CLASSES), cube(spark, o[None, None], features=CLASSES)
    bins = {(r.feature, r.bin): r for r in diagnostics.reliability(pc, oc).collect()}
    for (name, b), r in bins.items():
        c = CLASSES.index(name)
        inside = np.floor(p[:, c] * 0.9999999999999 * 10) == b
        assert (r.n, r.hit_rate) == (inside.sum(), pytest.approx(o[inside, c].mean()))
    auc = {r.feature: r.auc for r in diagnostics.roc_auc(pc, oc).collect()}
    want = [np.mean([(x > y) + 0.5 * (x == y) for x in p[o[:, c] == 1, c] for y in p[o[:, c] == 0, c]]) for c in range(3)]
    assert [auc[n] for n in CLASSES] == pytest.approx(want) and auc["macro"] == pytest.approx(np.mean(want))
    parts = {r.feature: r for r in diagnostics.reliability_scores(pc, oc).collect()}
    assert all(r.rel >= 0 and r.res >= 0 and 0 <= r.unc <= 0.25 for r in parts.values())
    best = {r["sample"]: r.feature for r in diagnostics.dominant(pc).collect()}
    assert [best[s] for s in days(40)] == [CLASSES[i] for i in p.argmax(1)]
    t = diagnostics.taylor(cube(spark, X), cube(spark, Y)).where("feature = 'f0'").first()
    assert t.corr == pytest.approx(np.corrcoef(X[..., 0].ravel(), Y.ravel())[0, 1]) and t.angle == pytest.approx((1 - t.corr) * math.pi / 2)


def test_workflows_and_streaming(spark, tmp_path):
    x, y = cube(spark, X), cube(spark, Y)
    assert hindcast.ensemble_rpss(x, y).count() == 4 and hindcast.mlr_pearson(x, y).count() == 4
    assert hindcast.ensemble_report(x, y).columns == ["lat", "lon", "rps", "rpss", "brier_score", "lss", "owls", "f1"]
    assert hindcast.ensemble_rpss(x, y, dry_threshold=-99.0).where("rpss is not null").count() == 4

    from skyquilt.streaming import scoring

    stamped = y.withColumn("sample", F.col("sample").cast("timestamp"))
    stamped.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stamped.schema).parquet(str(tmp_path / "in"))
    thresholds = prep.terciles(y)

    def drained(df, mode):
        query = df.writeStream.format("memory").queryName(f"q{abs(hash((id(df), mode)))}").outputMode(mode).start()
        query.processAllAvailable()
        out = spark.table(query.name).collect()
        query.stop()
        return out

    kinds = drained(scoring.classify(stream, thresholds), "append")
    assert len(kinds) == 80 and {r.category for r in kinds} == set(CLASSES)
    running = {(r.lat, r.lon): r for r in drained(scoring.running_normal(stream), "complete")}
    assert running[1.0, 0.0].mu == pytest.approx(Y[1, 0].mean()) and running[1.0, 0.0].sd == pytest.approx(Y[1, 0].std())
    assert len(drained(scoring.score_linear(stream, mlr.fit(x, y).select("lat", "lon", "intercept", "slope")), "append")) == 80
    assert drained(scoring.windowed_mean(stream, "60 days"), "complete")
    assert json.dumps(hindcast.__doc__)


def test_fields_are_computed_once(spark):
    c, _ = field_cube(spark)
    n = c.count()
    (x, made_x), (y, made_y) = counted(spark, c), counted(spark, c)
    assert field.CCA(search_override=(2, 2, 2)).fit(x, y).predict().count() > 0
    assert (made_x.value, made_y.value) == (n, n)
