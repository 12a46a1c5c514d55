import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt.functions import distributions
from skyquilt.functions.expr import ACTIVATIONS, avg_rank, nan_to_null, q_mid, t_cdf
from skyquilt.operators import core, folds, kernels, prep, rolling, select, spatial
from skyquilt.sources.cubes import observed_cube

from .cubes import array, counted, cube, days, series

RNG = np.random.default_rng(0)
CLASSES = ["BN", "NN", "AN"]


# ---- roles, checks -------------------------------------------------------------------------------------------


def test_roles_are_guessed():
    assert core.guess_columns(["Lat", "LONG", "init", "member"]) == {"lat": "Lat", "lon": "LONG", "sample": "init", "feature": "member"}
    assert core.guess_columns(["y", "x", "t", "whatever"])["feature"] == "whatever"
    assert core.guess_columns(["y", "x", "odd", "odder"])["sample"] is None
    assert core.guess_columns(["a", "b", "T", "M"], lat="a", lon="b") == {"lat": "a", "lon": "b", "sample": "T", "feature": "M"}
    assert core.guess_columns(["T", "S", "X", "Y"])["sample"] == "T"
    with pytest.raises(ValueError):
        core.guess_columns(["a"], lat="z")


def test_checks(spark):
    c = cube(spark, RNG.normal(size=(2, 2, 3, 1)))
    core.check(c)
    with pytest.raises(ValueError, match="repeat"):
        core.check(c.unionAll(c))
    with pytest.raises(ValueError, match="has no"):
        core.check(c.drop("feature"))
    core.check_compatible(c, c.where("feature = 'f0'"))
    with pytest.raises(ValueError, match="sample"):
        core.check_compatible(c, c.where("sample > '1999-01-15'"))
    assert tuple(core.shape(c).first()) == (2, 2, 3, 1)
    assert core.dense(c.where("lat = 0 or lon = 0")).count() == 9
    assert core.dense(c.where("not (lat = 1 and sample > '1999-02-15')")).where("value is null").count() == 2
    a, b = core.align_blocks(c, c)
    assert a.join(b, ["lat", "lon", "sample", "feature", "block"]).count() == 12
    nan = spark.createDataFrame([(1.0,), (float("nan"),)], "v double").select(F.avg(nan_to_null(F.col("v")))).first()[0]
    assert nan == 1.0


def test_cubes_are_computed_once(spark):
    c = cube(spark, np.ones((2, 2, 3, 1)))
    x, made = counted(spark, c)
    d = core.dense(x)
    assert d.count() == d.where("value is not null").count() == 12
    assert made.value == 12
    (x, made_x), (y, made_y) = counted(spark, c), counted(spark, c)
    core.check_compatible(x, y)
    assert (made_x.value, made_y.value) == (12, 12)
    for other, named in ((c.where("lat = 0 and sample > '1999-01-15'"), "lat, lon"), (c.where("sample > '1999-01-15'"), "sample")):
        for pair in ((c, other), (other, c)):
            with pytest.raises(ValueError, match=f"differ in {named}$"):
                core.check_compatible(*pair)
    core.check_compatible(c.where("false"), c.where("false"))
    assert not any("lineitem" in f or "orders" in f for f in observed_cube(spark, "/root/testdata/sf0.001").inputFiles())


# ---- functions -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_quantiles(spark, n):
    v = RNG.normal(size=n).round(1)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    for q in (0.0, 0.33, 0.5, 2 / 3, 1.0):
        assert df.select(q_mid("v", q)).first()[0] == pytest.approx(np.quantile(v, q, method="midpoint"))


def test_average_rank_and_student(spark):
    v = [3.0, 1.0, 3.0, 2.0, 3.0]
    rows = spark.createDataFrame([(1, x) for x in v], "k int, v double").withColumn("r", avg_rank("v", "k")).collect()
    assert sorted((r.v, r.r) for r in rows) == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]
    assert [round(spark.range(1).select(t_cdf(F.lit(t), F.lit(n))).first()[0], 6) for t, n in ((0.0, 5), (1.0, 1), (2.015048, 5), (-1.812461, 10), (1.710882, 24))] == [0.5, 0.75, 0.95, 0.05, 0.95]
    grid = np.linspace(-4, 4, 9)
    for n in (1, 2, 7, 12):
        assert kernels.t_cdf(grid, n) == pytest.approx([spark.range(1).select(t_cdf(F.lit(float(t)), F.lit(n))).first()[0] for t in grid])


def test_activations_agree(spark):
    x = np.linspace(-3, 3, 7)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1)
    for name, f in ACTIVATIONS.items():
        assert [r[0] for r in df.select(f(F.col("x"))).collect()] == pytest.approx(kernels.ACTIVATIONS[name](x).tolist())


def test_distributions():
    assert distributions.norm_cdf(np.array([0, 1.959963985])) == pytest.approx([0.5, 0.975])
    assert distributions.norm_ppf(np.array([0.9999])) == pytest.approx([3.719016485])
    x = np.linspace(0.01, 20, 50)
    assert distributions.gamma_cdf(x, 1.0, 2.0) == pytest.approx(1 - np.exp(-x / 2))
    assert distributions.gamma_cdf(x, 2.0, 1.0) == pytest.approx(1 - np.exp(-x) * (1 + x))
    for a in (0.3, 1.0, 7.5):
        p = np.linspace(0.001, 0.999, 21)
        assert distributions.gamma_cdf(distributions.gamma_ppf(p, a, 3.0), a, 3.0) == pytest.approx(p, abs=1e-9)
    assert np.isnan(distributions.gamma_cdf(np.array([1.0]), 0.0, 1.0)[0])


# ---- preparation ---------------------------------------------------------------------------------------------


def test_dateline(spark):
    c = cube(spark, np.ones((1, 4, 1, 1)), lons=[179.0, 180.0, 181.0, 359.0])
    assert sorted(r.lon for r in prep.reformat(c).collect()) == [-179.0, -1.0, 179.0, 180.0]


def test_drymask(spark):
    v = np.zeros((1, 3, 6, 1))
    v[0, 1] = 5
    v[0, 2] = np.nan
    for method in ("quantile", "mean"):
        assert [r.value for r in prep.drymask(cube(spark, v), method=method).orderBy("lon").collect()] == [None, 1.0, 1.0]
    with pytest.raises(ValueError):
        prep.drymask(cube(spark, v), method="median")


def test_climatology(spark):
    samples = [dt.date(y, m, d) for y in (2000, 2001) for m in (1, 2, 12) for d in (1, 15)] + [dt.date(2001, 12, 31)]
    v = RNG.normal(size=len(samples))
    got = {r["sample"]: r.value for r in prep.remove_climatology(cube(spark, v[None, None, :, None], samples=samples)).collect()}
    for s, x in got.items():
        month = [i for i, t in enumerate(samples) if (t.year, t.month) == (s.year, s.month)]
        clim = [i for i, t in enumerate(samples) if t.month == s.month]
        assert x == pytest.approx(v[month].mean() - v[clim].mean())
    assert len(got) == 6


def test_one_hot_quirks(spark):
    v = np.array([-2.0, -1.0, 0.0, 1.0, np.nan, 2.0])
    enc = prep.OneHotEncoder(-1.5, 1.5, explicit=True)
    assert array(enc.fit(series(spark, v)).transform(series(spark, v)), CLASSES)[0, 0].tolist() == [[1, 0, 0], [0, 1, 0], [0, 0, 0], [0, 1, 0], [0, 0, 0], [0, 0, 1]]
    exact = prep.OneHotEncoder(-1.5, 1.5, explicit=True, compat=False)
    assert array(exact.fit(series(spark, v)).transform(series(spark, v)), CLASSES)[0, 0, 2].tolist() == [0, 1, 0]
    gone = cube(spark, np.full((1, 1, 3, 1), np.nan))
    assert np.isnan(array(prep.OneHotEncoder().fit(gone).transform(gone), CLASSES)).all()
    ties = np.array([1.0, 1.0, 1.0, 2.0, 3.0])
    low, high = np.quantile(ties, 0.33, method="midpoint"), np.quantile(ties, 0.67, method="midpoint")
    want = np.stack([ties < low, (ties >= low) & (ties <= high), ties > high], axis=1).astype(float)
    assert array(prep.OneHotEncoder().fit(series(spark, ties)).transform(series(spark, ties)), CLASSES)[0, 0].tolist() == want.tolist()


@pytest.mark.parametrize("scaler", [prep.MinMax(), prep.MinMax(0, 1), prep.Normal()])
def test_scalers_invert(spark, scaler):
    v = RNG.normal(size=(2, 2, 7, 2))
    v[0, 0, 2, 0] = np.nan
    v[1, 1, :, 1] = 4.0
    c = cube(spark, v)
    fitted = scaler.fit(c)
    out = array(fitted.transform(c))
    if isinstance(scaler, prep.Normal):
        assert np.nanstd(out[0, 0, :, 0]) == pytest.approx(1)
    else:
        assert np.nanmin(out[0, 0, :, 0]) == pytest.approx(scaler.min) and np.nanmax(out[0, 0, :, 0]) == pytest.approx(scaler.max)
    assert array(fitted.inverse_transform(fitted.transform(c))) == pytest.approx(v, nan_ok=True)


def test_percentile(spark):
    v = [3.0, 1.0, np.nan, 3.0, 2.0]
    assert array(prep.percentile(series(spark, v)))[0, 0, :, 0].tolist() == [0.875, 0.25, 0.9999, 0.875, 0.5]
    assert np.isnan(array(prep.percentile(series(spark, v), compat=False))[0, 0, 2, 0])
    assert array(prep.percentile(series(spark, [1.0, 2.0])))[0, 0, :, 0].tolist() == [0.5, 0.9999]


def test_transformers(spark):
    v = RNG.gamma(2.0, 3.0, size=40)
    c = series(spark, v)
    gamma = prep.GammaTransformer().fit(c)
    alpha, beta = gamma.fitted.select("alpha", "beta").first()
    a = 4 * (math.log(v.mean()) - np.log(v).mean())
    assert alpha == pytest.approx((1 + math.sqrt(1 + a / 3)) / a) and beta == pytest.approx(v.mean() / alpha)
    assert array(gamma.inverse_transform(gamma.transform(c)))[0, 0, :, 0] == pytest.approx(v, rel=1e-6)
    constant = prep.GammaTransformer().fit(series(spark, [2.0, 2.0])).fitted.first()
    assert (constant.alpha, constant.beta) == (0.0, 0.0001)
    ecdf = prep.EmpiricalTransformer().fit(c)
    p = array(ecdf.ecdf(c))[0, 0, :, 0]
    assert p == pytest.approx(np.clip([(v <= x).mean() for x in v], 0.0001, 0.9999))
    back = array(ecdf.inverse_transform(ecdf.transform(c)))[0, 0, :, 0]
    inner = v < v.max()
    assert back[inner] == pytest.approx(v[inner], rel=1e-6)


def gamma_sum(x, alpha, beta):
    """The distribution function by so many terms of its series that no more count."""
    return math.fsum(math.exp(-x / beta + (alpha + k) * math.log(x / beta) - math.lgamma(alpha + k + 1)) for k in range(20000))


def test_gamma_inverse_of_large_shapes(spark):
    for alpha in (499.0, 500.0, 2600.0, 200000.0, 1.2e6):
        p = np.array([1e-4, 0.02, 0.49, 0.5, 0.51, 0.98, 0.9999])
        x = distributions.gamma_ppf(p, alpha, 0.3)
        assert [gamma_sum(v, alpha, 0.3) for v in x] == pytest.approx(p, abs=1e-8)
    v = np.random.default_rng(1).normal(53000, 110, size=27)
    c = series(spark, v)
    gamma = prep.GammaTransformer().fit(c)
    moved = gamma.inverse_transform(gamma.transform(c).withColumn("value", F.col("value") + 0.1))
    alpha, beta = gamma.fitted.select("alpha", "beta").first()
    assert alpha > 100000
    want = [distributions.norm_cdf(distributions.norm_ppf(np.array([gamma_sum(x, alpha, beta)])) + 0.1)[0] for x in v]
    assert [gamma_sum(x, alpha, beta) for x in array(moved)[0, 0, :, 0]] == pytest.approx(want, abs=1e-8)


def test_gamma_transform_of_large_shapes(spark):
    v = np.random.default_rng(1).normal(53000, 70, size=27)
    c = series(spark, v)
    gamma = prep.GammaTransformer().fit(c)
    alpha, beta = gamma.fitted.select("alpha", "beta").first()
    assert alpha > 200000
    want = distributions.norm_ppf(np.array([gamma_sum(x, alpha, beta) for x in v]))
    assert array(gamma.transform(c))[0, 0, :, 0] == pytest.approx(want, abs=1e-7)




def test_normal_scores(spark):
    v = RNG.normal(size=(1, 1, 6, 2))
    v[0, 0, 3, 1] = np.nan
    out = array(prep.normal_scores(cube(spark, v)))
    assert out.shape == (1, 1, 5, 2)
    rank = np.argsort(np.argsort(np.delete(v[0, 0, :, 0], 3))) + 1
    assert out[0, 0, :, 0] == pytest.approx(distributions.norm_ppf(np.clip(rank / 5, 0.0001, 0.9999)))


# ---- rolling -------------------------------------------------------------------------------------------------


def test_rolling_pools_and_leap_day(spark):
    samples = [dt.date(1999, 2, 28), dt.date(2000, 2, 27), dt.date(2000, 2, 29), dt.date(2001, 2, 26), dt.date(2001, 3, 20), dt.date(2002, 2, 25)]
    c = cube(spark, np.arange(6.0)[None, None, :, None], samples=samples)
    pooled = {}
    for r in rolling.pools(c, lead_low=3, lead_high=3, base_year=1999, n_years=3).collect():
        pooled.setdefault(r.md, []).append(r.value)
    for md in {s.strftime("%m-%d") for s in samples}:
        m, d = map(int, md.split("-"))
        base = dt.date(1999, m, min(d, 28) if m == 2 else d)
        want = [float(i) for i, s in enumerate(samples) if any(abs((s - (base + dt.timedelta(days=365 * (j + 1)))).days) <= 3 for j in range(3))]
        assert sorted(pooled.get(md, [])) == want
    enc = rolling.RollingOneHotEncoder(3, 3, 1999, 3).fit(c)
    out = array(enc.transform(c), CLASSES)
    assert (out.sum(-1) == 1).all()
    same = rolling.RollingOneHotEncoder(3, 3, 1999, 3, compat=True).fit(c)
    assert same.transform(c).count() == 18
    assert rolling.RollingMinMax(3, 3, 1999, 3).fit(c).transform(c).count() == 6


# ---- spatial -------------------------------------------------------------------------------------------------


def bilinear(v, lats, lons, la, lo):
    out = np.empty((len(la), len(lo)))
    for i, a in enumerate(np.clip(la, lats[0], lats[-1])):
        row = np.array([np.interp(a, lats, v[:, j]) for j in range(v.shape[1])])
        out[i] = [np.interp(o, lons, row) for o in np.clip(lo, lons[0], lons[-1])]
    return out


def test_regrid(spark):
    lats, lons = [0.0, 1.0, 3.0, 7.0], [10.0, 12.0, 13.0]
    v = RNG.normal(size=(4, 3, 2, 1))
    c = cube(spark, v, lats, lons)
    la, lo = [-5.0, 0.5, 2.0, 7.0, 9.0], [9.0, 10.5, 12.0, 99.0]
    got = array(spatial.regrid(c, lo, la))
    for t in range(2):
        assert got[:, :, t, 0] == pytest.approx(bilinear(v[:, :, t, 0], lats, lons, la, lo))
    assert spatial.regrid(c, lons, lats) is c
    v[1, 1, 0, 0] = np.nan
    got = array(spatial.regrid(cube(spark, v, lats, lons), [12.0, 12.9], [1.0, 3.0]))
    assert np.isnan(got[0, 0, 0, 0]) and not np.isnan(got[1:, :, 0]).any() and not np.isnan(got[:, :, 1]).any()
    x, y = spatial.match(cube(spark, RNG.normal(size=(2, 2, 1, 1)), lons=[170.0, 190.0]), cube(spark, RNG.normal(size=(3, 2, 1, 1)), lons=[175.0, 185.0]))
    assert sorted({r.lon for r in x.collect()}) == sorted({r.lon for r in y.collect()}) == [-175.0, 175.0]


@pytest.mark.parametrize("kernel", [1, 3, 5])
def test_smoothing(spark, kernel):
    v = RNG.normal(size=(4, 3, 1, 1))
    v[2, 1] = np.nan
    got = array(spatial.gaussian_smooth(cube(spark, v), kernel))[:, :, 0, 0]
    filled = np.where(np.isnan(v[:, :, 0, 0]), np.nanmean(v), v[:, :, 0, 0])
    r = (kernel - 1) // 2
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / 2) ** 2)
    w /= w.sum()
    padded = np.pad(filled, r, mode="symmetric")
    want = np.array([[(padded[i : i + 2 * r + 1, j : j + 2 * r + 1] * np.outer(w, w)).sum() for j in range(3)] for i in range(4)])
    want[2, 1] = np.nan
    assert got == pytest.approx(want, nan_ok=True)


# ---- folds ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,window", [(5, 1), (6, 3), (7, 5)])
def test_circular_folds(spark, n, window):
    c = cube(spark, np.zeros((1, 1, n, 1)))
    order = days(n)
    r = (window - 1) // 2
    found = {}
    for row in folds.circular(c, window).collect():
        if row.is_test:
            found.setdefault(row.fold, set()).add(order.index(row["sample"]))
        assert row.is_centre == (order.index(row["sample"]) == row.fold)
    assert found == {f: {(f + d) % n for d in range(-r, r + 1)} for f in range(n)}
    assert {x.fold for x in folds.circular(c, window, step=2).collect()} == set(range(0, n, 2))
    with pytest.raises(ValueError):
        folds.circular(c, 2)


def test_years_and_kfold(spark):
    samples = [dt.date(2000, 1, 1), dt.date(2000, 6, 1), dt.date(2000, 12, 31), dt.date(2001, 1, 1), dt.date(2001, 7, 1)]
    c = cube(spark, np.zeros((1, 1, 5, 1)), samples=samples)
    leak = {(r.fold, r["sample"]) for r in folds.leave_one_year_out(c).where("is_train and is_test").collect()}
    assert leak == {(2000, samples[0]), (2000, samples[2]), (2001, samples[3])}
    assert folds.leave_one_year_out(c, compat=False).where("is_train = is_test").count() == 0
    for n, k in ((7, 3), (10, 5), (3, 5)):
        got = [r.fold for r in folds.kfold(cube(spark, np.zeros((1, 1, n, 1))), k).orderBy("i").collect()]
        assert got == [f for f, (_, test) in enumerate(kernels.kfold(n, k)) for _ in test]


# ---- selection -----------------------------------------------------------------------------------------------


def test_selection(spark):
    v = RNG.normal(size=(3, 2, 4, 2))
    c = cube(spark, v)
    assert array(select.crop(c, lat=(1, 2))) == pytest.approx(v[1:])
    assert array(select.nearest(c, "lat", [0.4, 1.5]))[:, 0, 0, 0] == pytest.approx(v[[0, 1], 0, 0, 0])
    assert array(select.at_positions(c, "sample", 0, -1)) == pytest.approx(v[:, :, [0, 3]])
    assert array(select.where(c, F.col("value") > 0, 0.0)) == pytest.approx(np.where(v > 0, v, 0))
    assert array(select.stack(select.unstack(c, "feature", ["f0", "f1"]), "feature", ["f0", "f1"]).select(*c.columns)) == pytest.approx(v)
    v[1, 1, 2, 0] = np.nan
    c = cube(spark, v)
    assert select.drop_incomplete_points(c).count() == (12 - 1) * 4
    assert select.reindex(c.where("lat > 0"), c).where("value is null").count() == 16 + 1
    assert array(select.mean_over(c, "feature").withColumn("feature", F.lit("m")))[1, 1, 2, 0] == pytest.approx(v[1, 1, 2, 1])
    assert select.mean_over(c, "feature", strict=True).where("value is null").count() == 1
    assert select.concat("feature", a=c.where("feature = 'f0'"), b=c.where("feature = 'f1'")).count() == c.count()
    assert select.merge(a=select.mean_over(c.where("lat < 2"), "sample", "feature"), b=select.mean_over(c.where("lat > 0"), "sample", "feature")).count() == 6
    assert {r.feature for r in select.relabel(c, "feature", {"f0": "zero"}).collect()} == {"zero", "f1"}
