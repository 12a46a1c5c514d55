"""Query names with their Spark functions and the SQL that returns the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyquilt.functions import expr
from skyquilt.operators import core, diagnostics, field, folds, mlr, models, prep, rolling, select, spatial, verify
from skyquilt.operators.core import guessed, shape
from skyquilt.operators.ensemble import ACPAC, Ensemble
from skyquilt import sqlparts as sql
from skyquilt.plans import hindcast
from skyquilt.sources import parameters
from skyquilt.sources.cubes import model_cube, observed_cube

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

LL, S4 = "lat, lon", "lat, lon, sample, feature"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to 6 places, so that sums in another order compare equal; -0.0 as 0.0."""
    return df.select(*((F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema))


# ---- SQL parts -----------------------------------------------------------------------------------------------

_G = "g AS (SELECT n_nationkey, CAST(-20 + 10 * n_regionkey AS DOUBLE) AS lat, CAST(150 + 15 * (n_nationkey // 5) AS DOUBLE) AS lon FROM nation)"
_LO = "lo AS (SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority, lat, lon FROM orders JOIN customer ON o_custkey = c_custkey JOIN g ON c_nationkey = n_nationkey)"


def _mean(v: str) -> str:
    return f"CAST(sum(CAST({v} AS DECIMAL(18,2))) AS DOUBLE) / count(*)"


def _dense(name: str, raw: str) -> str:
    return f"{name} AS (SELECT {S4}, value FROM (SELECT DISTINCT lat, lon FROM {raw}) CROSS JOIN (SELECT DISTINCT sample FROM {raw}) CROSS JOIN (SELECT DISTINCT feature FROM {raw}) LEFT JOIN {raw} USING ({S4}))"


_X0 = f"x0 AS (SELECT lat, lon, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS sample, o_orderpriority AS feature, {_mean('o_totalprice')} AS value FROM lo GROUP BY ALL)"


def _obs(name: str, period: str) -> str:
    return f"{name}0 AS (SELECT lat, lon, CAST(date_trunc('{period}', o_orderdate) AS DATE) AS sample, 'obs' AS feature, {_mean('l_extendedprice')} AS value FROM lineitem JOIN lo ON l_orderkey = o_orderkey GROUP BY ALL), " + _dense(name, name + "0")


X = [_G, _LO, _X0, _dense("x", "x0")]
Y = [_G, _LO, _obs("y", "quarter")]
YM = [_G, _LO, _obs("ym", "month")]
XY = X + Y[2:]


def lit(v: float) -> str:
    return f"{v:.17g}e0"


def mid(values: str, q: float) -> str:
    """Midpoint quantile of a sorted list expression."""
    at = f"{lit(q)} * (len({values}) - 1)"
    return f"CASE WHEN len({values}) > 0 THEN ({values}[CAST(floor({at}) AS INT) + 1] + {values}[CAST(ceil({at}) AS INT) + 1]) / 2 END"


LIST = "coalesce(list_sort(list(value) FILTER (value IS NOT NULL)), [])"


def th(name: str, source: str, low: float, high: float, keys: str = LL) -> list[str]:
    return [f"{name}_l AS (SELECT {keys}, {LIST} AS s FROM {source} GROUP BY {keys})", f"{name} AS (SELECT {keys}, {mid('s', low)} AS lo, {mid('s', high)} AS hi FROM {name}_l)"]


def r(*names: str) -> str:
    return ", ".join(f"round({e}, 6) + 0e0 AS {n}" for e, n in (x.split(" := ")[::-1] if " := " in x else (x, x) for x in names))


def add(name: str, query: Callable[[SparkSession, str], DataFrame], ctes: list[str] | None = None, final: str | None = None, digits: int = 6) -> None:
    _QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir), digits)
    if final:
        _SQL[name] = "WITH " + ",\n".join(ctes) + "\n" + final


def x_(f):
    return lambda s, d: f(model_cube(s, d))


def y_(f):
    return lambda s, d: f(observed_cube(s, d))


def ym_(f):
    return lambda s, d: f(observed_cube(s, d, "month"))


def xy_(f):
    return lambda s, d: f(model_cube(s, d), observed_cube(s, d))


# ---- cubes and selection -------------------------------------------------------------------------------------

add("cube_build", x_(lambda x: x), X, f"SELECT {S4}, {r('value')} FROM x")
add("cube_observed_monthly", ym_(lambda y: y), YM, f"SELECT {S4}, {r('value')} FROM ym")
add("cube_shape", x_(shape), X, "SELECT count(DISTINCT lat) AS n_lat, count(DISTINCT lon) AS n_lon, count(DISTINCT sample) AS n_sample, count(DISTINCT feature) AS n_feature FROM x")
add("guess_columns_rename", x_(lambda x: guessed(x.toDF("Y", "LONG", "TIME", "MEMBER", "value"))), X, f"SELECT {S4}, {r('value')} FROM x")
add("crop_region", x_(lambda x: select.crop(x, lat=(-10, 10), lon=(165, 195))), X, f"SELECT {S4}, {r('value')} FROM x WHERE lat BETWEEN -10 AND 10 AND lon BETWEEN 165 AND 195")
add("nearest_label", x_(lambda x: select.nearest(x, "lat", [-14.0, 3.0, 17.5])), X + ["t AS (SELECT unnest([-14e0, 3e0, 17.5e0]) AS t)", "b AS (SELECT t, arg_min(lat, (abs(lat - t), lat)) AS lat FROM t CROSS JOIN (SELECT DISTINCT lat FROM x) GROUP BY t)"], f"SELECT t AS lat, lon, sample, feature, {r('value')} FROM x JOIN b USING (lat)")
add("positional_select", x_(lambda x: select.at_positions(x, "sample", 0, 3, -1)), X + ["p AS (SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT sample FROM x))"], f"SELECT {S4}, {r('value')} FROM x WHERE sample IN (SELECT sample FROM p WHERE i IN (0, 3) OR i - n = -1)")
add("where_other", x_(lambda x: select.where(x, F.col("value") > 180000, 0.0)), X, f"SELECT {S4}, round(CASE WHEN value > 180000 THEN value ELSE 0e0 END, 6) + 0e0 AS value FROM x")
add("expand_axis", y_(lambda y: select.expand(y, "nd", 0)), Y, f"SELECT {S4}, {r('value')}, 0 AS nd FROM y")
add("relabel_axis", y_(lambda y: select.relabel(y, "feature", {"obs": "truth"})), Y, f"SELECT lat, lon, sample, 'truth' AS feature, {r('value')} FROM y")
_PRI = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
add("unstack_features", lambda s, d: (lambda x: select.unstack(x.withColumn("feature", F.substring("feature", 1, 1)), "feature", list("12345")).toDF("lat", "lon", "sample", "f1", "f2", "f3", "f4", "f5"))(model_cube(s, d)), X, "SELECT lat, lon, sample, " + ", ".join(f"round(max(value) FILTER (feature[1] = '{k}'), 6) + 0e0 AS f{k}" for k in "12345") + " FROM x GROUP BY ALL")
add("stack_roundtrip", lambda s, d: (lambda x: select.stack(select.unstack(x.withColumn("feature", F.substring("feature", 1, 1)), "feature", list("12345")), "feature", list("12345")))(model_cube(s, d)).select("lat", "lon", "sample", "feature", "value"), X, f"SELECT lat, lon, sample, feature[1] AS feature, {r('value')} FROM x")
add("drop_incomplete_points", x_(select.drop_incomplete_points), X + ["k AS (SELECT lat, lon, feature FROM x GROUP BY ALL HAVING count(value) = count(*))"], f"SELECT {S4}, {r('value')} FROM x SEMI JOIN k USING (lat, lon, feature)")
add("reindex_dense", lambda s, d: (lambda x: select.reindex(x.where("value > 180000"), x))(model_cube(s, d)), X, f"SELECT {S4}, round(CASE WHEN value > 180000 THEN value END, 6) + 0e0 AS value FROM x")
add("fill_spatial_mean", x_(prep.fill_spatial_mean), X, f"SELECT {S4}, round(coalesce(value, avg(value) OVER (PARTITION BY sample, feature)), 6) + 0e0 AS value FROM x")
add("elementwise_difference", xy_(lambda x, y: select.combine(x, y, F.col("a") - F.col("b"), ("lat", "lon", "sample"))), XY, "SELECT x.lat, x.lon, x.sample, x.feature, round(x.value - y.value, 6) + 0e0 AS value FROM x JOIN y USING (lat, lon, sample)")
_MASK = [f"dm_l AS (SELECT lat, lon, feature, {LIST} AS s FROM y GROUP BY ALL)", f"mask AS (SELECT lat, lon, avg(CASE WHEN {mid('s', 0.33)} < 51000 THEN NULL ELSE 1e0 END) AS value FROM dm_l GROUP BY ALL)"]
add("mask_multiply", y_(lambda y: select.apply_mask(y, prep.drymask(y, dry_threshold=51000))), Y + _MASK, "SELECT y.lat, y.lon, y.sample, y.feature, round(y.value * mask.value, 6) + 0e0 AS value FROM y JOIN mask USING (lat, lon)")
add("concat_union", lambda s, d: (lambda y: select.concat("feature", low=y.where("lat < 0"), high=y.where("lat >= 0")))(observed_cube(s, d)), Y, f"SELECT lat, lon, sample, CASE WHEN lat < 0 THEN 'low' ELSE 'high' END AS feature, {r('value')} FROM y")
add("merge_outer", lambda s, d: (lambda y: select.merge(mean=select.mean_over(y.where("lat <= 0"), "sample", "feature"), sd=prep.std(y.where("lat >= 0")).drop("feature")))(observed_cube(s, d)), Y + ["a AS (SELECT lat, lon, avg(value) AS mean FROM y WHERE lat <= 0 GROUP BY ALL)", "b AS (SELECT lat, lon, stddev_pop(value) AS sd FROM y WHERE lat >= 0 GROUP BY ALL)"], f"SELECT lat, lon, {r('mean', 'sd')} FROM a FULL JOIN b USING (lat, lon)")
add("mean_skip", x_(lambda x: select.mean_over(x, "sample")), X, "SELECT lat, lon, feature, round(avg(value), 6) + 0e0 AS value FROM x GROUP BY ALL")
add("mean_strict", x_(lambda x: select.mean_over(x, "sample", strict=True)), X, "SELECT lat, lon, feature, round(CASE WHEN count(*) = count(value) THEN avg(value) END, 6) + 0e0 AS value FROM x GROUP BY ALL")

# ---- preparation ---------------------------------------------------------------------------------------------

add("reformat_lon", x_(prep.reformat), X, f"SELECT lat, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon, sample, feature, {r('value')} FROM x")
_SER = "lat, lon, feature"
add("quantile_midpoint", x_(lambda x: prep.quantile(x, 0.33)), X + [f"l AS (SELECT {_SER}, {LIST} AS s FROM x GROUP BY ALL)"], f"SELECT {_SER}, round({mid('s', 0.33)}, 6) + 0e0 AS value FROM l")
add("quantile_linear", x_(lambda x: prep.quantile(x, 0.9, "linear")), X, f"SELECT {_SER}, round(quantile_cont(value, 0.9), 6) + 0e0 AS value FROM x GROUP BY ALL")
add("std_field", x_(prep.std), X, f"SELECT {_SER}, round(stddev_pop(value), 6) + 0e0 AS value FROM x GROUP BY ALL")
add("terciles", x_(prep.terciles), X + th("t", "x", 1 / 3, 2 / 3), f"SELECT lat, lon, {r('lo', 'hi')} FROM t")
add("drymask_quantile", y_(lambda y: prep.drymask(y, dry_threshold=51000)), Y + _MASK, "SELECT lat, lon, value FROM mask")
add("drymask_mean", y_(lambda y: prep.drymask(y, dry_threshold=52500, method="mean")), Y + ["m AS (SELECT lat, lon, feature, avg(value) AS v FROM y GROUP BY ALL)"], "SELECT lat, lon, avg(CASE WHEN v < 52500 THEN NULL ELSE 1e0 END) AS value FROM m GROUP BY ALL")
_OHT = th("ot", "y", 0.33, 0.67)
_OH = _OHT + ["ow AS (SELECT lat, lon, sample, CASE WHEN any_ THEN CAST(coalesce(value < lo, false) AS INT)::DOUBLE END AS bn, CASE WHEN any_ THEN CAST(coalesce(value >= lo AND value <= hi AND value <> 0, false) AS INT)::DOUBLE END AS nn, CASE WHEN any_ THEN CAST(coalesce(value > hi, false) AS INT)::DOUBLE END AS an FROM (SELECT *, count(value) OVER (PARTITION BY lat, lon) > 0 AS any_ FROM y) JOIN ot USING (lat, lon))"]
_LONG = "UNPIVOT INCLUDE NULLS {} ON bn AS 'BN', nn AS 'NN', an AS 'AN' INTO NAME feature VALUE value"


def _long(table: str) -> str:
    return "SELECT lat, lon, sample, feature, round(value, 6) + 0e0 AS value FROM (" + " UNION ALL ".join(f"SELECT lat, lon, sample, '{c.upper()}' AS feature, {c} AS value FROM {table}" for c in ("bn", "nn", "an")) + ")"


add("onehot_thresholds", y_(lambda y: prep.OneHotEncoder().fit(y).thresholds), Y + _OHT, f"SELECT lat, lon, {r('lo', 'hi')} FROM ot")
add("onehot_transform", y_(lambda y: prep.OneHotEncoder().fit(y).transform(y)), Y + _OH, _long("ow"))
add("onehot_explicit", y_(lambda y: prep.OneHotEncoder(50000, 55000, explicit=True).fit(y).transform(y)), Y + ["w AS (SELECT lat, lon, sample, CAST(coalesce(value < 50000, false) AS INT)::DOUBLE AS bn, CAST(coalesce(value BETWEEN 50000 AND 55000, false) AS INT)::DOUBLE AS nn, CAST(coalesce(value > 55000, false) AS INT)::DOUBLE AS an FROM y)"], _long("w"))
_MM = [f"f AS (SELECT {_SER}, min(value) AS lo, CASE WHEN max(value) = min(value) THEN 1 ELSE max(value) - min(value) END AS rg FROM x GROUP BY ALL)"]
add("minmax_transform", x_(lambda x: prep.MinMax().fit(x).transform(x)), X + _MM, f"SELECT {S4}, round((value - lo) / rg * 2 - 1, 6) + 0e0 AS value FROM x JOIN f USING ({_SER})")
add("minmax_inverse", x_(lambda x: (lambda m: m.inverse_transform(m.transform(x)))(prep.MinMax().fit(x))), X, f"SELECT {S4}, {r('value')} FROM x")
_NO = [f"f AS (SELECT {_SER}, avg(value) AS mu, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS sd FROM x GROUP BY ALL)"]
add("normal_transform", x_(lambda x: prep.Normal().fit(x).transform(x)), X + _NO, f"SELECT {S4}, round((value - mu) / sd, 6) + 0e0 AS value FROM x JOIN f USING ({_SER})")
add("normal_inverse", x_(lambda x: (lambda m: m.inverse_transform(m.transform(x)))(prep.Normal().fit(x))), X, f"SELECT {S4}, {r('value')} FROM x")
_PCT = "CASE WHEN value IS NULL THEN 0.9999e0 WHEN p >= 1 THEN 0.9999e0 WHEN p <= 0 THEN 0.0001e0 ELSE p END"
_RANK = f"(rank() OVER (PARTITION BY {_SER} ORDER BY value NULLS LAST) + (count(*) OVER (PARTITION BY {_SER}, value) - 1) / 2e0)"
add("percentile_rank", x_(prep.percentile), X + [f"p AS (SELECT *, {_RANK} / count(value) OVER (PARTITION BY {_SER}) AS p FROM x)"], f"SELECT {S4}, round({_PCT}, 6) + 0e0 AS value FROM p")
_CL = ["k AS (SELECT *, month(sample) AS m FROM ym WHERE sample <= (SELECT make_date(max(year(sample))::INT, 12, 31) FROM ym))", f"mo AS (SELECT {_SER}, CAST(date_trunc('month', sample) AS DATE) AS sample, any_value(m) AS m, avg(value) AS v FROM k GROUP BY {_SER}, date_trunc('month', sample))", f"cl AS (SELECT {_SER}, m, avg(value) AS c FROM k GROUP BY ALL)"]
add("remove_climatology", ym_(prep.remove_climatology), YM + _CL, f"SELECT {S4}, round(v - c, 6) + 0e0 AS value FROM mo JOIN cl USING ({_SER}, m)")
add("gamma_fit_params", y_(lambda y: prep.GammaTransformer().fit(y).fitted), Y + [f"s AS (SELECT {_SER}, avg(value) AS m, avg(ln(value)) AS l, var_pop(value) AS v FROM y WHERE value > 2.220446049250313e-16 GROUP BY ALL)", "a AS (SELECT *, 4 * (ln(m) - l) AS a FROM s)", f"b AS (SELECT {_SER}, m, v, CASE WHEN a > 1.4901161193847656e-8 THEN (1 + sqrt(1 + a / 3)) / a WHEN v > 0 THEN m * m / v ELSE 0 END AS alpha, a FROM a)"], f"SELECT {_SER}, round(alpha, 6) + 0e0 AS alpha, round(CASE WHEN a > 1.4901161193847656e-8 THEN m / alpha WHEN v > 0 THEN v / m ELSE 0.0001 END, 6) + 0e0 AS beta FROM b")
add("ecdf_percentile", y_(lambda y: prep.EmpiricalTransformer().fit(y).ecdf(y)), Y + [f"e AS (SELECT {S4}, cume_dist() OVER (PARTITION BY {_SER} ORDER BY value) AS p FROM y WHERE value IS NOT NULL)"], f"SELECT {S4}, round(CASE WHEN p IS NOT NULL THEN least(0.9999, greatest(0.0001, p)) END, 6) + 0e0 AS value FROM y LEFT JOIN e USING ({S4})")
_GAM = [f"gs AS (SELECT {_SER}, avg(value) AS m, avg(ln(value)) AS l, var_pop(value) AS v FROM y WHERE value > 2.220446049250313e-16 GROUP BY ALL)", "ga AS (SELECT *, 4 * (ln(m) - l) AS a FROM gs)", f"gp AS (SELECT {_SER}, CASE WHEN a > 1.4901161193847656e-8 THEN (1 + sqrt(1 + a / 3)) / a WHEN v > 0 THEN m * m / v END AS alpha, m FROM ga)", f"gc AS (SELECT {S4}, value, alpha, m / alpha AS beta FROM y LEFT JOIN gp USING ({_SER}))", f"gd AS (SELECT *, CASE WHEN value IS NOT NULL THEN least(0.9999, greatest(0.0001, {sql.gamma_cdf('value', 'alpha', 'beta')})) END AS p FROM gc)"]
add("gamma_transform", y_(lambda y: prep.GammaTransformer().fit(y).transform(y)), Y + _GAM, f"SELECT {S4}, round({sql.norm_ppf('p')}, 6) + 0e0 AS value FROM gd")
add("gamma_inverse", y_(lambda y: (lambda g: g.inverse_transform(g.transform(y).withColumn("value", F.col("value") + 0.1)))(prep.GammaTransformer().fit(y))), Y + _GAM + [f"ge AS (SELECT *, {sql.norm_ppf('p')} + 0.1e0 AS z FROM gd)", f"gf AS (SELECT *, CASE WHEN z IS NOT NULL THEN least(0.9999, greatest(0.0001, {sql.norm_cdf('z')})) END AS r FROM ge)"], f"SELECT {S4}, round(CASE WHEN r IS NOT NULL THEN {sql.gamma_ppf('r', 'alpha', 'beta')} END, 3) + 0e0 AS value FROM gf", digits=3)
_ECD = [f"e0 AS (SELECT {S4}, value AS v, cume_dist() OVER (PARTITION BY {_SER} ORDER BY value) AS e FROM y WHERE value IS NOT NULL)", f"e1 AS (SELECT {S4}, v, e, CASE WHEN e IS NOT NULL THEN least(0.9999, greatest(0.0001, e)) END AS p FROM y LEFT JOIN e0 USING ({S4}))"]
add("empirical_transform", y_(lambda y: prep.EmpiricalTransformer().fit(y).transform(y)), Y + _ECD, f"SELECT {S4}, round({sql.norm_ppf('p')}, 6) + 0e0 AS value FROM e1")
add("empirical_inverse", y_(lambda y: (lambda e: e.inverse_transform(e.transform(y).withColumn("value", F.col("value") + 0.1)))(prep.EmpiricalTransformer().fit(y))), Y + _ECD[:1] + [f"e1z AS (SELECT {S4}, {sql.norm_ppf('p')} + 0.1e0 AS z FROM ({_ECD[1].split(' AS (', 1)[1]})", f"e1 AS (SELECT {S4}, {sql.norm_cdf('z')} AS p FROM e1z)", f"ek AS (SELECT DISTINCT {_SER}, v, e FROM e0)", f"el AS (SELECT *, lag(v) OVER w AS v0, lag(e) OVER w AS e0, row_number() OVER w AS j, count(*) OVER (PARTITION BY {_SER}) AS n FROM ek WINDOW w AS (PARTITION BY {_SER} ORDER BY v))", f"em2 AS (SELECT e1.{S4.replace(', ', ', e1.')}, p, arg_min(struct_pack(v0 := el.v0, v := el.v, e0 := el.e0, e := el.e), CASE WHEN el.e >= p THEN el.j ELSE 1000 - el.j END) AS k, max(n) AS n, max(el.v) AS sole FROM e1 LEFT JOIN el ON e1.lat = el.lat AND e1.lon = el.lon AND e1.feature = el.feature AND (el.j > 1 OR el.n = 1) GROUP BY ALL)"], f"SELECT {S4}, round(CASE WHEN p IS NULL THEN NULL WHEN n = 1 THEN sole ELSE k.v0 + (p - k.e0) / (k.e - k.e0) * (k.v - k.v0) END, 3) + 0e0 AS value FROM em2", digits=3)
add("normal_scores", y_(prep.normal_scores), Y + ["ns AS (SELECT * FROM y WHERE sample NOT IN (SELECT sample FROM y WHERE value IS NULL))", f"nr AS (SELECT *, {_RANK} / count(value) OVER (PARTITION BY {_SER}) AS p FROM ns)", f"nq AS (SELECT {S4}, {_PCT} AS q FROM nr)"], f"SELECT {S4}, round({sql.norm_ppf('q')}, 6) + 0e0 AS value FROM nq")
add("normal_cdf", x_(lambda x: prep.cdf(prep.Normal().fit(x).transform(x))), X + [f"nz AS (SELECT {S4}, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END AS z FROM x WINDOW w AS (PARTITION BY {_SER}))"], f"SELECT {S4}, round(CASE WHEN z IS NOT NULL THEN {sql.norm_cdf('z')} END, 6) + 0e0 AS value FROM nz")
_RO = dict(lead_low=45, lead_high=45, base_year=1994, n_years=8)
_DAYS = ["md AS (SELECT DISTINCT strftime(sample, '%m-%d') AS md FROM ym)", "dy AS (SELECT md, coalesce(try_cast('1994-' || md AS DATE), DATE '1994-02-28') AS b, unnest(range(0, 8)) AS j FROM md)", f"pool AS (SELECT {_SER}, md, value FROM ym JOIN dy ON ym.sample BETWEEN b + CAST(365 * (j + 1) - 45 AS INT) AND b + CAST(365 * (j + 1) + 45 AS INT))"]
add("rolling_minmax", ym_(lambda y: rolling.RollingMinMax(**_RO).fit(y).transform(y)), YM + _DAYS + [f"f AS (SELECT {_SER}, md, min(value) AS lo, max(value) AS hi FROM pool GROUP BY ALL)"], f"SELECT ym.lat, ym.lon, sample, ym.feature, round(CASE WHEN hi <> lo THEN (value - lo) / (hi - lo) * 2 - 1 END, 6) + 0e0 AS value FROM ym LEFT JOIN f ON ym.lat = f.lat AND ym.lon = f.lon AND ym.feature = f.feature AND f.md = strftime(sample, '%m-%d')")
add("rolling_onehot", ym_(lambda y: rolling.RollingOneHotEncoder(**_RO).fit(y).transform(y)), YM + _DAYS + th("f", "pool", 1 / 3, 2 / 3, _SER + ", md") + ["w AS (SELECT ym.lat, ym.lon, sample, CAST(coalesce(value <= lo, false) AS INT)::DOUBLE AS bn, CAST(coalesce(value > hi, false) AS INT)::DOUBLE AS an FROM ym LEFT JOIN f ON ym.lat = f.lat AND ym.lon = f.lon AND ym.feature = f.feature AND f.md = strftime(sample, '%m-%d'))", "w2 AS (SELECT *, 1 - an - bn AS nn FROM w)"], _long("w2"))
add("regrid_bilinear", y_(lambda y: spatial.regrid(y, [157.5, 172.5, 187.5, 202.5], [-15.0, -7.5, 0.0, 7.5, 15.0])), Y + ["ta AS (SELECT unnest([-15e0, -7.5e0, 0e0, 7.5e0, 15e0]) AS la)", "tb AS (SELECT unnest([157.5e0, 172.5e0, 187.5e0, 202.5e0]) AS lo)", "na AS (SELECT la, arg_min(lat, (abs(lat - la), lat)) AS nl FROM ta CROSS JOIN (SELECT DISTINCT lat FROM y) GROUP BY la)", "nb AS (SELECT lo, arg_min(lon, (abs(lon - lo), lon)) AS nl FROM tb CROSS JOIN (SELECT DISTINCT lon FROM y) GROUP BY lo)", "yf AS (SELECT lat, lon, sample, feature, value IS NULL AS gone, coalesce(value, avg(value) OVER (PARTITION BY sample, feature)) AS value FROM y)"], "SELECT na.la AS lat, nb.lo AS lon, sample, feature, round(CASE WHEN NOT bool_or(gone AND lat = na.nl AND lon = nb.nl) THEN sum(value * (1 - abs(lat - na.la) / 10) * (1 - abs(lon - nb.lo) / 15)) END, 6) + 0e0 AS value FROM yf JOIN na ON abs(lat - na.la) < 10 JOIN nb ON abs(lon - nb.lo) < 15 GROUP BY na.la, nb.lo, sample, feature")
add("match_grids", xy_(lambda x, y: spatial.match(x, y.where("lat <= 10 and lon <= 195"))[0]), X + ["xr AS (SELECT lat, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon, sample, feature, value FROM x)"], f"SELECT {S4}, {r('value')} FROM xr WHERE lat <= 10 AND (lon <= -165 OR lon > 0)")
_W = spatial.weights(3)
add("gaussian_smooth", y_(spatial.gaussian_smooth), Y + ["ix AS (SELECT lat, row_number() OVER (ORDER BY lat) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT lat FROM y))", "jx AS (SELECT lon, row_number() OVER (ORDER BY lon) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT lon FROM y))", "wt AS (SELECT * FROM (VALUES " + ", ".join(f"({d}, {lit(w)})" for d, w in _W) + ") AS v(d, w))", "na AS (SELECT a.lat AS to_lat, b.lat, w FROM ix a CROSS JOIN wt JOIN ix b ON b.i = CASE WHEN a.i + d < 0 THEN -1 - (a.i + d) WHEN a.i + d >= a.n THEN 2 * a.n - 1 - (a.i + d) ELSE a.i + d END)", "nb AS (SELECT a.lon AS to_lon, b.lon, w FROM jx a CROSS JOIN wt JOIN jx b ON b.i = CASE WHEN a.i + d < 0 THEN -1 - (a.i + d) WHEN a.i + d >= a.n THEN 2 * a.n - 1 - (a.i + d) ELSE a.i + d END)", "yf AS (SELECT lat, lon, sample, feature, coalesce(value, avg(value) OVER (PARTITION BY sample, feature)) AS v FROM y)", "sm AS (SELECT to_lat AS lat, to_lon AS lon, sample, feature, sum(v * na.w * nb.w) AS s FROM yf JOIN na USING (lat) JOIN nb USING (lon) GROUP BY ALL)"], f"SELECT {S4}, round(CASE WHEN value IS NOT NULL THEN s END, 6) + 0e0 AS value FROM y JOIN sm USING ({S4})")

# ---- folds ---------------------------------------------------------------------------------------------------

_IX = ["ix AS (SELECT sample, CAST(row_number() OVER (ORDER BY sample) - 1 AS INT) AS i, CAST(count(*) OVER () AS INT) AS n FROM (SELECT DISTINCT sample FROM y))"]
_CV = _IX + ["cv AS (SELECT b.i AS fold, a.sample, least(((a.i - b.i) % a.n + a.n) % a.n, ((b.i - a.i) % a.n + a.n) % a.n) <= 1 AS is_test, a.i = b.i AS is_centre FROM ix a CROSS JOIN ix b)"]
add("cv_circular_folds", y_(lambda y: folds.circular(y, 3)), Y + _CV, "SELECT fold, sample, is_test, is_centre FROM cv")
add("cv_leave_one_year_out", ym_(folds.leave_one_year_out), YM, "SELECT CAST(yr AS INT) AS fold, sample, sample <= make_date(yr::INT, 1, 1) OR sample >= make_date(yr::INT, 12, 31) AS is_train, sample BETWEEN make_date(yr::INT, 1, 1) AND make_date(yr::INT, 12, 31) AS is_test FROM (SELECT DISTINCT sample FROM ym) CROSS JOIN (SELECT DISTINCT year(sample) AS yr FROM ym)")
_KF = _IX + ["kf AS (SELECT sample, i, n, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INT) AS fold FROM ix)"]
add("cv_kfold", y_(folds.kfold), Y + _KF, "SELECT sample, i, n, fold FROM kf")

# ---- ensembles -----------------------------------------------------------------------------------------------

_EN = th("et", "x", 1 / 3, 2 / 3) + ["es AS (SELECT lat, lon, sample, avg(CASE WHEN value <= lo THEN 1e0 ELSE 0e0 END) AS bn, avg(CASE WHEN value > hi THEN 1e0 ELSE 0e0 END) AS an FROM x JOIN et USING (lat, lon) GROUP BY ALL)", "ep AS (SELECT lat, lon, sample, bn, 1 - bn - an AS nn, an FROM es)"]
_EM = ["em AS (SELECT lat, lon, sample, avg(value) AS p FROM x GROUP BY ALL)"]
add("ensemble_proba", x_(lambda x: Ensemble().fit(x).predict_proba(x)), X + _EN, _long("ep"))
add("ensemble_mean", x_(lambda x: Ensemble().fit(x).predict(x)), X + _EM, f"SELECT lat, lon, sample, 'M' AS feature, {r('value := p')} FROM em")
_CO = "SELECT lat, lon, sample, '{C}' AS feature, ep.{c} AS p, ow.{c} AS o FROM ep JOIN ow USING (lat, lon, sample)"
_PC = _EN + _OH + ["pc AS (" + " UNION ALL ".join(_CO.format(C=c.upper(), c=c) for c in ("bn", "nn", "an")) + ")"]
_AC = _PC + ["sc AS (SELECT lat, lon, feature, stddev_pop(o) / nullif(stddev_pop(p), 0) AS sdratio, avg((o - 0.333e0) * (p - 0.333e0)) / nullif(sqrt(avg((o - 0.333e0) * (o - 0.333e0) * p * p)), 0) AS pac FROM pc GROUP BY ALL)"]
add("acpac_pac", xy_(lambda x, y: ACPAC().fit(x, y).scaling), XY + _AC, f"SELECT lat, lon, feature, {r('sdratio', 'pac')} FROM sc")


def _acpac_rounds() -> list[str]:
    out = ["v AS (SELECT pc.lat, pc.lon, sample, pc.feature, p * (sdratio * pac) AS v FROM pc JOIN sc USING (lat, lon, feature))", "r0 AS (SELECT lat, lon, sample, max(v) FILTER (feature = 'BN') AS bn, max(v) FILTER (feature = 'NN') AS nn, max(v) FILTER (feature = 'AN') AS an FROM v GROUP BY ALL)"]
    names, last = ("bn", "nn", "an"), "r0"
    for k in range(1, 4):
        for tag, cond, away in (("a", "< 0", "0.01e0"), ("b", "> 1", "0.99e0")):
            e = {n: f"CASE WHEN {n} {cond} THEN {n} - {away} ELSE 0 END / 2" for n in names}
            out.append(f"r{k}{tag} AS (SELECT lat, lon, sample, " + ", ".join(f"{n} + (" + " + ".join(e[m] for m in names if m != n) + f") AS {n}" for n in names) + f" FROM {last})")
            last = f"r{k}{tag}"
        out.append(f"r{k} AS (SELECT lat, lon, sample, " + ", ".join(f"{n} - (bn + nn + an - 1) / 3 AS {n}" for n in names) + f" FROM {last})")
        last = f"r{k}"
    return out


add("acpac_proba", xy_(lambda x, y: ACPAC().fit(x, y).predict_proba(x)), XY + _AC + _acpac_rounds(), _long("r3"))
add("acpac_predict", xy_(lambda x, y: ACPAC().fit(x, y).predict(x)), XY + ["cl AS (SELECT lat, lon, avg(value) AS c FROM y GROUP BY ALL)", "ob AS (SELECT lat, lon, sample, avg(value) AS o FROM y GROUP BY ALL)", "sl AS (SELECT lat, lon, feature, avg((value - c) * (o - c)) / nullif(var_pop(value - c), 0) AS a FROM x JOIN ob USING (lat, lon, sample) JOIN cl USING (lat, lon) GROUP BY ALL)"], "SELECT lat, lon, sample, '0' AS feature, round(avg(value * a), 3) + 0e0 AS value FROM x JOIN sl USING (lat, lon, feature) GROUP BY ALL", 3)

# ---- regression ----------------------------------------------------------------------------------------------


def t_sql(t: str, dof: str) -> str:
    """Student's t distribution in DuckDB; t and dof are columns."""
    c2 = f"pow(cos(atan({t} / sqrt({dof}))), 2)"
    product = lambda term: f"coalesce(list_product(list_transform(range(1, j + 1), lambda i: {term})), 1)"
    even = f"sin(atan({t} / sqrt({dof}))) * list_sum(list_transform(range(0, {dof} // 2), lambda j: pow({c2}, j) * {product('(2 * i - 1) / (2e0 * i)')}))"
    odd = f"(atan({t} / sqrt({dof})) + sin(atan({t} / sqrt({dof}))) * cos(atan({t} / sqrt({dof}))) * coalesce(list_sum(list_transform(range(0, ({dof} - 1) // 2), lambda j: pow({c2}, j) * {product('(2 * i) / (2 * i + 1e0)')})), 0)) * 2 / pi()"
    return f"(0.5e0 + CASE WHEN {dof} % 2 = 1 THEN {odd} ELSE {even} END / 2)"


_PR = _EM + ["pr0 AS (SELECT lat, lon, sample, p, value AS o FROM em JOIN y USING (lat, lon, sample))", "pr AS (SELECT * FROM pr0 SEMI JOIN (SELECT lat, lon FROM pr0 GROUP BY ALL HAVING count(*) = count(p + o)) USING (lat, lon))"]
_ML = _PR + _KF + ["rw AS (SELECT pr.*, i, n, fold FROM pr JOIN kf USING (sample))", "fc AS (SELECT lat, lon, l, regr_slope(o, p) AS s, regr_intercept(o, p) AS c FROM rw CROSS JOIN (SELECT unnest(range(0, 5)) AS l) WHERE fold <> l GROUP BY ALL)", "ev AS (SELECT rw.lat, rw.lon, sum(pow(o - c - s * p, 2)) / (max(n) - 3) AS err_var, max(n) AS n FROM rw JOIN fc ON rw.lat = fc.lat AND rw.lon = fc.lon AND fold = l GROUP BY ALL)", "lf AS (SELECT lat, lon, regr_intercept(o, p) AS intercept, regr_slope(o, p) AS slope FROM rw WHERE i < n - n // 5 GROUP BY ALL)", f"lm AS (SELECT lat, lon, quantile_cont(o, {lit(1 / 3)}) AS lo, quantile_cont(o, {lit(2 / 3)}) AS hi, avg(p) AS xmean, stddev_pop(p) AS xstd FROM rw GROUP BY ALL)", "md AS (SELECT * FROM lf JOIN ev USING (lat, lon) JOIN lm USING (lat, lon))"]
add("mlr_coef", xy_(lambda x, y: mlr.fit(x, y).select("lat", "lon", "intercept", "slope", F.round("err_var", 2).alias("err_var"))), XY + _ML, f"SELECT lat, lon, {r('intercept', 'slope')}, round(err_var, 2) AS err_var FROM md")
add("mlr_predict", xy_(lambda x, y: mlr.predict(mlr.fit(x, y), x)), XY + _ML, "SELECT lat, lon, sample, 'mlr' AS feature, round(intercept + slope * p, 6) + 0e0 AS value FROM em JOIN md USING (lat, lon)")
_MP = _ML + ["tt AS (SELECT lat, lon, sample, (lo - intercept - slope * p) / sqrt(err_var) AS tl, (hi - intercept - slope * p) / sqrt(err_var) AS th, n - 3 AS v FROM em JOIN md USING (lat, lon))", f"tp AS (SELECT lat, lon, sample, {t_sql('tl', 'v')} AS bn, 1 - {t_sql('th', 'v')} AS an FROM tt)", "tw AS (SELECT lat, lon, sample, bn, 1 - bn - an AS nn, an FROM tp)"]
add("mlr_tercile_proba", xy_(lambda x, y: mlr.predict_proba(mlr.fit(x, y), x)), XY + _MP, _long("tw"))
_MC = _PR + _CV + ["tr AS (SELECT fold, sample, row_number() OVER (PARTITION BY fold ORDER BY sample) - 1 AS i, count(*) OVER (PARTITION BY fold) AS n FROM cv WHERE NOT is_test)", "ft AS (SELECT fold, lat, lon, regr_intercept(o, p) AS c, regr_slope(o, p) AS s FROM pr JOIN tr USING (sample) WHERE i < n - n // 5 GROUP BY ALL)", "mc AS (SELECT pr.lat, pr.lon, pr.sample, c + s * pr.p AS p, o FROM pr JOIN cv USING (sample) JOIN ft ON ft.fold = cv.fold AND ft.lat = pr.lat AND ft.lon = pr.lon WHERE is_centre)"]
add("mlr_predict_cv", xy_(lambda x, y: mlr.cross_validated(x, y, folds.circular(y, 3))), XY + _MC, "SELECT lat, lon, sample, 'mlr' AS feature, round(p, 6) + 0e0 AS value FROM mc")

# ---- continuous metrics --------------------------------------------------------------------------------------

_SE = "lat, lon"
_CP = _EM + [f"c0 AS (SELECT lat, lon, sample, p, value AS o FROM em JOIN y USING (lat, lon, sample))", f"c AS (SELECT *, avg(p) OVER w AS pm, avg(o) OVER w AS om, rank() OVER (PARTITION BY {_SE} ORDER BY p) + (count(*) OVER (PARTITION BY {_SE}, p) - 1) / 2e0 AS rp, rank() OVER (PARTITION BY {_SE} ORDER BY o) + (count(*) OVER (PARTITION BY {_SE}, o) - 1) / 2e0 AS ro FROM c0 WHERE (lat, lon) NOT IN (SELECT (lat, lon) FROM c0 WHERE p IS NULL OR o IS NULL) WINDOW w AS (PARTITION BY {_SE}))"]
_NSE = "(1 - sum((p - o) * (p - o)) / nullif(sum((o - om) * (o - om)), 0))"
_KGE = ("corr(p, o)", "(var_pop(p) / nullif(var_pop(o), 0))", "(avg(p) / nullif(avg(o), 0))")
_LLK = f"(-count(*) / 2e0 * (1 + ln(2 * pi())) - count(*) / 2e0 * ln(nullif(sum((p - o) * (p - o)) / count(*), 0)))"


def continuous(x: DataFrame, y: DataFrame) -> DataFrame:
    return verify.continuous(Ensemble().fit(x).predict(x), y)


def cells_of(table: str, select_: str) -> str:
    """The rows of a grouped select, and NULL for cells of the table that it leaves out."""
    return f"SELECT * FROM (SELECT DISTINCT lat, lon FROM {table}) LEFT JOIN ({select_}) USING (lat, lon)"


def _metric(name: str, spark_metric: Callable, sql: str, ranks: bool = False) -> None:
    pairs_ = (lambda x, y: verify.ranked(continuous(x, y))) if ranks else continuous
    add(name, xy_(lambda x, y: verify.score(pairs_(x, y), {name: spark_metric()})), XY + _CP, cells_of("c0", f"SELECT lat, lon, round({sql}, 6) + 0e0 AS {name} FROM c GROUP BY lat, lon"))


_metric("pearson", verify.pearson, "corr(p, o)")
_metric("spearman", verify.spearman, "corr(rp, ro)", True)
_metric("nse", verify.nse, _NSE)
_metric("nnse", verify.nnse, f"1 / (2 - {_NSE})")
_metric("kge", verify.kge, f"1 - sqrt(({_KGE[0]} - 1) * ({_KGE[0]} - 1) + ({_KGE[1]} - 1) * ({_KGE[1]} - 1) + ({_KGE[2]} - 1) * ({_KGE[2]} - 1))")
_metric("kge_components", verify.kge_components, f"({_KGE[0]} + {_KGE[1]} + {_KGE[2]}) / 3")
_metric("index_of_agreement", verify.index_of_agreement, "1 - sum((p - o) * (p - o)) / nullif(sum((abs(p - pm) + abs(o - pm)) * (abs(p - pm) + abs(o - pm))), 0)")
_metric("bias_ratio", verify.bias_ratio, "avg(p) / nullif(avg(o), 0)")
_metric("ncrmse", verify.ncrmse, "stddev_pop(p - o) / nullif(avg(o), 0)")
_metric("mape", verify.mape, "avg(abs(o - p) / greatest(abs(o), 2.220446049250313e-16))")
_metric("log_likelihood", verify.log_likelihood, _LLK)
_metric("aic", verify.aic, f"-2 * {_LLK} + 2")
_metric("bic", verify.bic, f"-2 * {_LLK} + ln(count(*))")
for _name, _of, _ranks in (("pearson_p", "p, o", False), ("spearman_p", "rp, ro", True)):
    _pairs = (lambda x, y: verify.ranked(continuous(x, y))) if _ranks else continuous
    _fn = verify.spearman_p if _ranks else verify.pearson_p
    add(_name, xy_(lambda x, y, pairs_=_pairs, fn=_fn, n=_name: verify.score(pairs_(x, y), {n: fn()})), XY + _CP + [f"q AS (SELECT lat, lon, corr({_of}) AS r, CAST(count(*) AS INT) - 2 AS v FROM c GROUP BY ALL)", "q2 AS (SELECT lat, lon, v, abs(r) * sqrt(v / (1 - r * r)) AS t FROM q)"], cells_of("c0", f"SELECT lat, lon, round(2 * (1 - {t_sql('t', 'v')}), 6) + 0e0 AS {_name} FROM q2"))
add("kendall_tau", xy_(lambda x, y: verify.kendall_tau(continuous(x, y))), XY + _CP + ["k AS (SELECT a.lat, a.lon, sign(b.p - a.p) AS dx, sign(b.o - a.o) AS dy FROM c a JOIN c b ON a.lat = b.lat AND a.lon = b.lon AND a.sample < b.sample)"], "SELECT lat, lon, round(sum(dx * dy) / sqrt(nullif(sum(abs(dx)) * sum(abs(dy)), 0)), 6) + 0e0 AS kendall_tau FROM k GROUP BY ALL")
add("all_continuous_one_pass", xy_(lambda x, y: verify.score(continuous(x, y), {n: f() for n, f in (("pearson", verify.pearson), ("nse", verify.nse), ("kge", verify.kge), ("bias_ratio", verify.bias_ratio))})), XY + _CP, cells_of("c0", f"SELECT lat, lon, round(corr(p, o), 6) + 0e0 AS pearson, round({_NSE}, 6) + 0e0 AS nse, round(1 - sqrt(({_KGE[0]} - 1) * ({_KGE[0]} - 1) + ({_KGE[1]} - 1) * ({_KGE[1]} - 1) + ({_KGE[2]} - 1) * ({_KGE[2]} - 1)), 6) + 0e0 AS kge, round(avg(p) / nullif(avg(o), 0), 6) + 0e0 AS bias_ratio FROM c GROUP BY lat, lon"))

# ---- probabilistic metrics -----------------------------------------------------------------------------------


def probabilistic(x: DataFrame, y: DataFrame) -> DataFrame:
    return verify.probabilistic(Ensemble().fit(x).predict_proba(x), prep.OneHotEncoder().fit(y).transform(y))


_PW = _EN + _OH + ["pw AS (SELECT lat, lon, sample, [ep.bn, ep.nn, ep.an] AS p, [ow.bn, ow.nn, ow.an] AS o, list_position([ow.bn, ow.nn, ow.an], greatest(ow.bn, ow.nn, ow.an)) - 1 AS k, list_position([ep.bn, ep.nn, ep.an], greatest(ep.bn, ep.nn, ep.an)) - 1 AS f, [avg(ow.bn) OVER w, avg(ow.nn) OVER w, avg(ow.an) OVER w] AS clim FROM ep JOIN ow USING (lat, lon, sample) WHERE ow.bn IS NOT NULL WINDOW w AS (PARTITION BY lat, lon))"]
_SQ = "(pow(o[1] - p[1], 2) + pow(o[2] - p[2], 2) + pow(o[3] - p[3], 2))"
_SB = "(pow(o[1] - 0.333e0, 2) + pow(o[2] - 0.333e0, 2) + pow(o[3] - 0.333e0, 2))"
_EPS = "2.220446049250313e-16"


def _sk(j: str) -> str:
    return f"(1 - ln(abs(p[{j}] - {_EPS})) / ln(clim[{j}] * (1 - {_EPS}) + (1 - clim[{j}]) * {_EPS}))"


_HIT = [f"CAST(count(*) FILTER (f = {c} AND k = {c}) AS DOUBLE)" for c in range(3)]
_FAL = [f"CAST(count(*) FILTER (f = {c} AND k <> {c}) AS DOUBLE)" for c in range(3)]
_MIS = [f"CAST(count(*) FILTER (f <> {c} AND k = {c}) AS DOUBLE)" for c in range(3)]
_REJ = [f"CAST(count(*) FILTER (f <> {c} AND k <> {c}) AS DOUBLE)" for c in range(3)]
_HK = " + ".join(f"({a} / nullif({a} + {c}, 0) - {b} / nullif({b} + {d}, 0))" for a, b, c, d in zip(_HIT, _FAL, _MIS, _REJ))
_HS = lambda e: " + ".join(f"(({a} + {d} - {e(a, b, c, d)}) / nullif(count(*) - {e(a, b, c, d)}, 0))" for a, b, c, d in zip(_HIT, _FAL, _MIS, _REJ))
_F1 = " + ".join(f"coalesce(2 * {a} / nullif(2 * {a} + {b} + {c}, 0), 0)" for a, b, c in zip(_HIT, _FAL, _MIS))
for _name, _fn, _sql in (
    ("rps", verify.rps, f"avg({_SQ})"),
    ("rpss", verify.rpss, f"1 - avg({_SQ}) / nullif(avg({_SB}), 0)"),
    ("brier_score", verify.brier_score, f"avg({_SQ}) / 3"),
    ("brier_score_loss", lambda: verify.brier_class(0), "avg((p[1] - o[1]) * (p[1] - o[1]))"),
    ("ignorance", verify.ignorance, "-avg(CASE WHEN p[k + 1] > 0 THEN ln(CASE WHEN p[k + 1] > 0 THEN p[k + 1] ELSE 1 END) ELSE CAST('-inf' AS DOUBLE) END)"),
    ("lss", verify.lss, f"avg({_sk('k + 1')})"),
    ("owls", verify.owls, f"avg({_sk('k + 1')} - (" + " + ".join(f"abs({j} - k) * {_sk(str(j + 1))}" for j in range(3)) + ") / 3)"),
    ("hansen_kuiper", verify.hansen_kuiper, f"({_HK}) / 3"),
    ("heidke", verify.heidke, "(" + _HS(lambda a, b, c, d: f"(({a} + {c}) * ({a} + {b}) + ({b} + {d}) * ({c} + {d}) / count(*))") + ") / 3"),
    ("heidke_corrected", lambda: verify.heidke(compat=False), "(" + _HS(lambda a, b, c, d: f"((({a} + {c}) * ({a} + {b}) + ({b} + {d}) * ({c} + {d})) / count(*))") + ") / 3"),
    ("f1", verify.f1, f"({_F1}) / 3"),
):
    add(_name, xy_(lambda x, y, n=_name, fn=_fn: verify.score_cells(probabilistic(x, y), {n: fn()})), XY + _PW, f"SELECT lat, lon, round({_sql}, 6) + 0e0 AS {_name} FROM pw GROUP BY lat, lon")
add("confusion_matrix", xy_(lambda x, y: verify.confusion(probabilistic(x, y))), XY + _PW, "SELECT lat, lon, CAST(k AS INT) AS observed, CAST(f AS INT) AS forecast, count(*) AS n FROM pw GROUP BY ALL")
add("grocs", xy_(lambda x, y: verify.grocs(probabilistic(x, y))), XY + _PW + ["gp AS (SELECT a.lat, a.lon, round((0e0 + a.p[1] * (b.p[2] + b.p[3]) + a.p[2] * b.p[3]) / nullif(1 - (a.p[1] * b.p[1] + a.p[2] * b.p[2] + a.p[3] * b.p[3]), 0), 12) AS s FROM pw a JOIN pw b ON a.lat = b.lat AND a.lon = b.lon AND a.k < b.k)"], "SELECT lat, lon, round(avg(CASE WHEN s > 0.5 THEN 1e0 WHEN s = 0.5 THEN 0.5e0 ELSE 0e0 END), 6) + 0e0 AS grocs FROM gp GROUP BY ALL")
_BC = _PC + ["bc AS (SELECT *, rank() OVER (PARTITION BY lat, lon, feature ORDER BY p) + (count(*) OVER (PARTITION BY lat, lon, feature, p) - 1) / 2e0 AS r FROM pc WHERE o IS NOT NULL)"]
add("auc", xy_(lambda x, y: verify.auc(probabilistic(x, y))), XY + _BC + ["a AS (SELECT lat, lon, feature, (sum(r * o) - sum(o) * (sum(o) + 1) / 2) / nullif(sum(o) * (count(*) - sum(o)), 0) AS v FROM bc GROUP BY ALL)"], "SELECT lat, lon, round(avg(v), 6) + 0e0 AS auc FROM a GROUP BY ALL")
add("point_biserial", xy_(lambda x, y: verify.point_biserial(probabilistic(x, y))), XY + _BC + ["a AS (SELECT lat, lon, feature, corr(o, p) AS v FROM bc GROUP BY ALL)"], "SELECT lat, lon, round(avg(v), 6) + 0e0 AS point_biserial FROM a GROUP BY ALL")
add("average_precision", xy_(lambda x, y: verify.average_precision(probabilistic(x, y))), XY + _BC + ["st AS (SELECT lat, lon, feature, p, sum(o) AS h, count(*) AS m FROM bc GROUP BY ALL)", "sp AS (SELECT *, sum(h) OVER w / sum(m) OVER w AS pr FROM st WINDOW w AS (PARTITION BY lat, lon, feature ORDER BY p DESC ROWS UNBOUNDED PRECEDING))", "a AS (SELECT lat, lon, feature, sum(pr * h) / nullif(sum(h), 0) AS v FROM sp GROUP BY ALL)"], "SELECT lat, lon, round(avg(v), 6) + 0e0 AS average_precision FROM a GROUP BY ALL")

# ---- diagnostics and workflows -------------------------------------------------------------------------------


def forecast_and_truth(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    return Ensemble().fit(x).predict_proba(x), prep.OneHotEncoder().fit(y).transform(y)


_BIN = _PC + ["rb AS (SELECT feature, CAST(floor(p * 0.9999999999999e0 * 10) AS INT) AS bin, count(*) AS n, avg(o) AS h, avg(p) AS f, sum(o) AS so FROM pc WHERE o IS NOT NULL GROUP BY 1, 2)"]
add("reliability_bins", xy_(lambda x, y: diagnostics.reliability(*forecast_and_truth(x, y))), XY + _BIN, "SELECT feature, bin, n, round(CASE WHEN n >= 0.01 * sum(n) OVER (PARTITION BY feature) THEN h END, 6) + 0e0 AS hit_rate, round(CASE WHEN n >= 0.01 * sum(n) OVER (PARTITION BY feature) THEN f END, 6) + 0e0 AS forecast FROM rb")
add("reliability_scores", xy_(lambda x, y: diagnostics.reliability_scores(*forecast_and_truth(x, y))), XY + _BIN + ["ra AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS al, sum(so) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS ba FROM rb)", "rs AS (SELECT feature, sum(n / al * pow(f - h, 2)) AS rel, sum(n / al * pow(h - ba, 2)) AS res, max(ba * (1 - ba)) AS unc FROM ra GROUP BY ALL)"], f"SELECT feature, {r('rel', 'res', 'unc')}, round((res - rel) / nullif(unc, 0), 6) + 0e0 AS bss FROM rs")
_ROC = _PC + ["rp AS (SELECT feature, round(p, 9) AS threshold, sum(o) AS h, count(*) AS n FROM pc WHERE o IS NOT NULL GROUP BY 1, 2)", "rq AS (SELECT feature, threshold, sum(n - h) OVER w / nullif(sum(n - h) OVER (PARTITION BY feature), 0) AS fpr, sum(h) OVER w / nullif(sum(h) OVER (PARTITION BY feature), 0) AS tpr FROM rp WINDOW w AS (PARTITION BY feature ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"]


def _snapped(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    p, o = forecast_and_truth(x, y)
    return p.withColumn("value", F.round("value", 9)), o


add("roc_points", xy_(lambda x, y: diagnostics.roc_points(*_snapped(x, y))), XY + _ROC, f"SELECT feature, {r('threshold', 'fpr', 'tpr')} FROM rq")
add("roc_auc", xy_(lambda x, y: diagnostics.roc_auc(*_snapped(x, y))), XY + _ROC + ["rl AS (SELECT feature, fpr, tpr, coalesce(lag(fpr) OVER w, 0) AS f0, coalesce(lag(tpr) OVER w, 0) AS t0 FROM rq WINDOW w AS (PARTITION BY feature ORDER BY threshold DESC))", "ar AS (SELECT feature, sum((fpr - f0) * (tpr + t0) / 2) AS auc FROM rl GROUP BY ALL)"], "SELECT feature, round(auc, 6) + 0e0 AS auc FROM ar UNION ALL SELECT 'macro', round(avg(auc), 6) + 0e0 FROM ar")
add("taylor_stats", xy_(diagnostics.taylor), XY + ["z AS (SELECT x.feature, x.value AS p, y.value AS o FROM x JOIN y USING (lat, lon, sample) WHERE x.value IS NOT NULL AND y.value IS NOT NULL)"], "SELECT feature, round(stddev_pop(p), 6) + 0e0 AS std, round(corr(p, o), 6) + 0e0 AS corr, round(stddev_pop(p - o), 6) + 0e0 AS crms, round((1 - corr(p, o)) * pi() / 2, 6) + 0e0 AS angle FROM z GROUP BY ALL")
add("dominant_tercile", x_(lambda x: diagnostics.dominant(Ensemble().fit(x).predict_proba(x))), X + _EN, "SELECT lat, lon, sample, CASE WHEN bn >= nn AND bn >= an THEN 'BN' WHEN nn >= an THEN 'NN' ELSE 'AN' END AS feature, round(greatest(bn, nn, an), 6) + 0e0 AS value FROM ep")
add("hindcast_ensemble_rpss", xy_(hindcast.ensemble_rpss), XY + _PW, f"SELECT lat, lon, round(1 - avg({_SQ}) / nullif(avg({_SB}), 0), 6) + 0e0 AS rpss FROM pw GROUP BY lat, lon")
add("hindcast_mlr_pearson", xy_(hindcast.mlr_pearson), XY + _MC, "SELECT lat, lon, round(corr(p, o), 6) + 0e0 AS pearson FROM mc GROUP BY ALL")


# ---- fitted per cell or per field; iterative or seeded, so without SQL ----------------------------------------


def _fitted(kind: str, apply: Callable = models.predict_proba, **params) -> Callable:
    return xy_(lambda x, y: apply(models.fit(prep.fill_spatial_mean(x), y, kind, **params), prep.fill_spatial_mean(x)))


_XF = [f"xf AS (SELECT {S4}, coalesce(value, avg(value) OVER (PARTITION BY sample, feature)) AS value FROM x)"]
_F5 = [f"f{k}" for k in range(1, 6)]
_WD = ["wd0 AS (SELECT lat, lon, sample, " + ", ".join(f"max(value) FILTER (feature[1] = '{k}') AS f{k}" for k in range(1, 6)) + " FROM xf GROUP BY ALL)", "wd1 AS (SELECT w.*, y.value AS y FROM wd0 w JOIN y USING (lat, lon, sample))", "wd AS (SELECT *, CAST(row_number() OVER c - 1 AS INT) AS i, CAST(count(*) OVER (PARTITION BY lat, lon) AS INT) AS n FROM wd1 WHERE (lat, lon) NOT IN (SELECT (lat, lon) FROM wd1 WHERE y IS NULL) WINDOW c AS (PARTITION BY lat, lon ORDER BY sample))"]
_XYF, _KEEP = XY + _XF + _WD, "lat, lon, sample, i, n, y"


def everywhere(value: str, table: str, features: list[str] | None = None, digits: int = 6) -> str:
    """Values of the table's cells, NULL for cells that have no model, as models' forecasts have them."""
    names = f" CROSS JOIN (SELECT unnest({features}) AS feature)" if features else ""
    key = "lat, lon, sample" + (", feature" if features else "")
    return f"SELECT {key}{'' if features else ', ' + chr(39) + '0' + chr(39) + ' AS feature'}, round({value}, {digits}) + 0e0 AS value FROM (SELECT DISTINCT lat, lon, sample FROM xf){names} LEFT JOIN {table} USING ({key})"


def terciles_long(table: str) -> str:
    return f"(SELECT lat, lon, sample, unnest(['BN', 'NN', 'AN']) AS feature, unnest([bn, 1 - bn - an, an]) AS v FROM {table})"


_MM = sql.least_squares("mm", "wd", "lat, lon", _F5, "y", train="i < n - n // 5", keep=_KEEP)
add("mlr_multi", _fitted("mlr", models.predict_linear), _XYF + _MM, everywhere("fit", "mm"))
_FOLD = "CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END"
_ME = [f"wk AS (SELECT wd.*, {_FOLD} AS fold, l FROM wd CROSS JOIN (SELECT unnest(range(0, 5)) AS l))"] + sql.least_squares("mk", "wk", "lat, lon, l", _F5, "y", train="fold <> l", keep="lat, lon, sample, i, n, y, fold, l") + ["mv AS (SELECT lat, lon, max(n) - 7 AS dof, sum(pow(fit - y, 2)) FILTER (WHERE fold = l) / (max(n) - 7) AS ev FROM mk GROUP BY ALL)", f"mq AS (SELECT lat, lon, quantile_cont(y, {lit(1 / 3)}) AS lo, quantile_cont(y, {lit(2 / 3)}) AS hi FROM wd GROUP BY ALL)"]
_MT = _MM + _ME + ["mt AS (SELECT lat, lon, sample, (lo - fit) / sqrt(ev) AS tl, (hi - fit) / sqrt(ev) AS th, CAST(dof AS INT) AS dof FROM mm JOIN mv USING (lat, lon) JOIN mq USING (lat, lon))", f"mp AS (SELECT lat, lon, sample, {t_sql('tl', 'dof')} AS bn, 1 - {t_sql('th', 'dof')} AS an FROM mt)"]
add("mlr_multi_proba", _fitted("mlr"), _XYF + _MT, everywhere("v", terciles_long("mp"), ["BN", "NN", "AN"]))
add("elm_predict", _fitted("elm", models.predict))
add("elm_proba", _fitted("elm"))
add("epoelm_predict", _fitted("epoelm", models.predict))
add("epoelm_proba", _fitted("epoelm"))
_LIM = ["lm1 AS (SELECT lat, lon, list_sort(list(y)) AS s, avg(y) AS ym, greatest(stddev_pop(y), 2.220446049250313e-16) AS ys FROM wd GROUP BY ALL)", f"lm2 AS (SELECT lat, lon, ym, ys, unnest([{mid('s', 0.33)}, {mid('s', 0.67)}, {mid('s', 1 / 3)}, {mid('s', 2 / 3)}]) AS q, unnest([1, 2, 3, 4]) AS c FROM lm1)", "mr AS (SELECT lat, lon, sample, f1, f2, f3, f4, f5, (q - ym) / ys AS q, c, CASE WHEN wd.y < lm2.q THEN 0.999e0 ELSE 0.001e0 END AS y FROM wd JOIN lm2 USING (lat, lon))"]
_MELR = _LIM + sql.reweighted("me", "mr", "lat, lon", [*_F5, "q"], "binomial", train="c < 3", keep="lat, lon, sample, c, y", rounds=14) + ["mp AS (SELECT lat, lon, sample, max(1 / (1 + exp(-eta))) FILTER (c = 3) AS bn, 1 - max(1 / (1 + exp(-eta))) FILTER (c = 4) AS an FROM me GROUP BY ALL)"]
add("melr_proba", _fitted("melr"), _XYF + _MELR, everywhere("v", terciles_long("mp"), ["BN", "NN", "AN"]))
_ELR = _LIM + ["er AS (SELECT lat, lon, sample, q, c, y, unnest([1, 2, 3, 4, 5]) AS f, unnest([f1, f2, f3, f4, f5]) AS v FROM mr)"] + sql.reweighted("ee", "er", "lat, lon, f", ["v", "q"], "binomial", train="c < 3", keep="lat, lon, f, sample, c, y", rounds=14) + ["mp AS (SELECT lat, lon, sample, avg(1 / (1 + exp(-eta))) FILTER (c = 3) AS bn, 1 - avg(1 / (1 + exp(-eta))) FILTER (c = 4) AS an FROM ee GROUP BY ALL)"]
add("elr_proba", _fitted("elr"), _XYF + _ELR, everywhere("v", terciles_long("mp"), ["BN", "NN", "AN"]))
add("qrf_quantile", _fitted("qrf", lambda m, x: models.predict(m, x, quantile=[0.1, 0.5, 0.9])))
add("qrf_proba", _fitted("qrf"))
add("qrf_nonexceedance", _fitted("qrf", lambda m, x: models.predict_proba(m, x, quantile=[0.2, 0.8])))
add("qrf_leaves", _fitted("qrf", lambda m, x: models.transform(m, x, 5), n_estimators=5))
add("rf_regressor", _fitted("rf_regressor", models.predict))
add("rf_classifier", _fitted("rf_classifier"))
add("epoelm_threshold_proba", _fitted("epoelm", lambda m, x: models.predict_proba(m, x, threshold=[30000, 40000, 50000])))
add("epoelm_density", _fitted("epoelm", lambda m, x: models.density(m, x, [30000, 40000])))
add("epoelm_activation", _fitted("epoelm", lambda m, x: models.activation(m, x, [40000])))
_LEVELS = [0.2, 0.5, 0.8]


def _at_levels(m: DataFrame, x: DataFrame) -> DataFrame:
    return models.predict_proba(m, x, quantile=_LEVELS)


def levels_long(table: str, column: str = "v") -> str:
    return f"(SELECT lat, lon, sample, unnest({[str(q) for q in _LEVELS]}) AS feature, unnest([{', '.join(f'{column}{k}' for k in range(3))}]) AS v FROM {table})"


def _levels_t(fit: str, dof: str, cells: str, keep: str) -> list[str]:
    """Student probabilities of at most the levels' quantiles: from `fit` (of samples), `mv` (ev, dof) and values `y` of `cells`."""
    return [f"lq AS (SELECT lat, lon, {', '.join(f'quantile_cont({keep}, {lit(q)}) AS m{k}' for k, q in enumerate(_LEVELS))} FROM {cells} GROUP BY ALL)", f"lt AS (SELECT lat, lon, sample, {', '.join(f'(m{k} - fit) / sqrt(ev) AS t{k}' for k in range(3))}, CAST(dof AS INT) AS dof FROM {fit} JOIN {dof} USING (lat, lon) JOIN lq USING (lat, lon))", f"lp AS (SELECT lat, lon, sample, {', '.join(f'{t_sql(f"t{k}", "dof")} AS v{k}' for k in range(3))} FROM lt)"]


add("mlr_quantile_proba", _fitted("mlr", _at_levels), _XYF + _MM + _ME + _levels_t("mm", "mv", "wd", "y"), everywhere("v", levels_long("lp"), [str(q) for q in _LEVELS]))
_LIQ = [_LIM[0], f"lm2 AS (SELECT lat, lon, ym, ys, unnest([{', '.join(mid('s', q) for q in (0.33, 0.67, *_LEVELS))}]) AS q, unnest([1, 2, 3, 4, 5]) AS c FROM lm1)", _LIM[2]]
_LEV = ", ".join(f"avg(1 / (1 + exp(-eta))) FILTER (c = {k + 3}) AS v{k}" for k in range(3))
add("melr_quantile_proba", _fitted("melr", _at_levels), _XYF + _LIQ + sql.reweighted("me", "mr", "lat, lon", [*_F5, "q"], "binomial", train="c < 3", keep="lat, lon, sample, c, y", rounds=14) + [f"lp AS (SELECT lat, lon, sample, {_LEV} FROM me GROUP BY ALL)"], everywhere("v", levels_long("lp"), [str(q) for q in _LEVELS], digits=5), digits=5)
add("elr_quantile_proba", _fitted("elr", _at_levels), _XYF + _LIQ + [_ELR[3]] + sql.reweighted("ee", "er", "lat, lon, f", ["v", "q"], "binomial", train="c < 3", keep="lat, lon, f, sample, c, y", rounds=14) + [f"lp AS (SELECT lat, lon, sample, {_LEV} FROM ee GROUP BY ALL)"], everywhere("v", levels_long("lp"), [str(q) for q in _LEVELS], digits=5), digits=5)
_NB = [f"nl AS (SELECT lat, lon, quantile_cont(y, {lit(1 / 3)}) AS lo, quantile_cont(y, {lit(2 / 3)}) AS hi FROM wd GROUP BY ALL)", "nc AS (SELECT wd.*, CASE WHEN y < lo THEN 0 WHEN y > hi THEN 2 ELSE 1 END AS c FROM wd JOIN nl USING (lat, lon))", "nf AS (SELECT lat, lon, c, count(*) AS m, " + ", ".join(f"sum(f{k}) + 1 AS s{k}" for k in range(1, 6)) + " FROM nc GROUP BY ALL)", "ne AS (SELECT wd.lat, wd.lon, sample, c, ln(m / sum(m) OVER (PARTITION BY wd.lat, wd.lon, sample)) + " + " + ".join(f"f{k} * ln(s{k} / (s1 + s2 + s3 + s4 + s5))" for k in range(1, 6)) + " AS a FROM wd JOIN nf USING (lat, lon))", "nx AS (SELECT lat, lon, sample, c, exp(a - max(a) OVER w) / sum(exp(a - ma)) OVER w AS v FROM (SELECT *, max(a) OVER (PARTITION BY lat, lon, sample) AS ma FROM ne) WINDOW w AS (PARTITION BY lat, lon, sample))", "np AS (SELECT lat, lon, sample, ['BN', 'NN', 'AN'][c + 1] AS feature, v FROM nx)"]
add("naive_bayes", _fitted("naive_bayes"), _XYF + _NB, everywhere("v", "np", ["BN", "NN", "AN"]))
for _name, _family in (("poisson_regression", "poisson"), ("gamma_regression", "gamma")):
    add(_name, _fitted(_family, models.predict), _XYF + sql.reweighted("gl", "wd", "lat, lon", _F5, _family, keep="lat, lon, sample, y", rounds=20), everywhere("exp(eta)", "gl", digits=2), digits=2)
add("nan_regression", _fitted("nan_regression", models.predict), X, "SELECT DISTINCT lat, lon, sample, '0' AS feature, CAST(NULL AS DOUBLE) AS value FROM x")
add("nan_classifier", _fitted("nan_classifier"), X, "SELECT DISTINCT lat, lon, sample, f AS feature, CAST(NULL AS DOUBLE) AS value FROM x CROSS JOIN (SELECT unnest(['BN', 'NN', 'AN']) AS f)")
add("tune_params", lambda s, d: models.tune(prep.fill_spatial_mean(model_cube(s, d)), observed_cube(s, d), "elm", {"hidden": [2, 5], "regularization": [-10, -5, 0], "activation": ["relu", "tanh"]}).select("lat", "lon", "goodness", F.array_join(F.array_sort(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("params")))
_EZ = [f"ez AS MATERIALIZED (SELECT {S4}, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z0, sqrt(cos(radians(lat))) AS wt, avg(value) OVER w AS mu, stddev_pop(value) OVER w AS sd, CAST(dense_rank() OVER (ORDER BY sample) AS INT) AS i FROM xf WINDOW w AS (PARTITION BY {_SER}))", "eg AS MATERIALIZED (SELECT a.feature, a.i, b.i AS j, sum(a.z0 * a.wt * b.z0 * b.wt) AS x FROM ez a JOIN ez b USING (lat, lon, feature) GROUP BY ALL)"]
_EOF = XY + _XF + _EZ + sql.eigenvectors("ev", "eg", "feature", 3) + [f"el AS MATERIALIZED (SELECT lat, lon, feature, mode, sum(z0 * wt * u / sqrt(ew)) * any_value(wt) AS value FROM ez JOIN ev USING (feature, i) GROUP BY ALL)", "es AS (SELECT feature, mode, CASE WHEN abs(max(value)) < abs(min(value)) THEN -1 ELSE 1 END AS sg FROM el GROUP BY ALL)", "eo AS MATERIALIZED (SELECT lat, lon, feature, mode, value * sg AS value FROM el JOIN es USING (feature, mode))", "sc AS MATERIALIZED (SELECT feature, sample, mode, sum(z0 * wt * eo.value) AS value FROM ez JOIN eo USING (lat, lon, feature) GROUP BY ALL)"]


def _eof(f: Callable, modes: int = 3) -> Query:
    return x_(lambda x: f(field.EOF(modes).fit(prep.fill_spatial_mean(x))))


add("eof_loadings", _eof(lambda e: e.loadings), _EOF, f"SELECT {_SER}, mode, {r('value')} FROM eo")
add("eof_scores", _eof(lambda e: e.scores), _EOF, f"SELECT feature, sample, mode, {r('value')} FROM sc")
add("eof_variance", _eof(lambda e: e.variance), XY + _XF + _EZ + sql.eigenvectors("ev", "eg", "feature", 3) + sql.root_trace("rt", "eg", "feature"), "SELECT DISTINCT feature, mode, round(sqrt(ew) / total, 6) + 0e0 AS value FROM ev JOIN rt USING (feature)")
add("eof_inverse", _eof(lambda e: e.inverse_transform(e.scores)), _EOF, f"SELECT {S4}, round(sum(eo.value * sc.value) / any_value(wt * wt) * any_value(sd) + any_value(mu), 3) + 0e0 AS value FROM ez JOIN eo USING (lat, lon, feature) JOIN sc USING (feature, mode, sample) GROUP BY ALL", digits=3)
_P10 = [f"g{k}{m}" for k in range(1, 6) for m in range(2)]
_PCR = _EOF + _WD + ["sw AS (SELECT sample, " + ", ".join(f"max(value) FILTER (feature[1] = '{g[1]}' AND mode = {g[2]}) AS {g}" for g in _P10) + " FROM sc GROUP BY ALL)", "pw0 AS (SELECT wd.lat, wd.lon, wd.i, wd.n, wd.y, sw.* FROM wd JOIN sw USING (sample))"] + sql.least_squares("mm", "pw0", "lat, lon", _P10, "y", train="i < n - n // 5", keep=_KEEP)
add("pcr_predict", xy_(lambda x, y: field.PCR(2).fit(prep.fill_spatial_mean(x), y).predict(prep.fill_spatial_mean(x))), _PCR, everywhere("fit", "mm"))
_PCP = _PCR + [f"wk AS (SELECT pw0.*, {_FOLD} AS fold, l FROM pw0 CROSS JOIN (SELECT unnest(range(0, 5)) AS l))"] + sql.least_squares("mk", "wk", "lat, lon, l", _P10, "y", train="fold <> l", keep="lat, lon, sample, i, n, y, fold, l") + [m.replace("max(n) - 7", "max(n) - 12") for m in _MT[-4:]]
add("pcr_proba", xy_(lambda x, y: field.PCR(2).fit(prep.fill_spatial_mean(x), y).predict_proba(prep.fill_spatial_mean(x))), _PCP, everywhere("v", terciles_long("mp"), ["BN", "NN", "AN"]))
_CI = ["ci AS (SELECT sample, CAST(row_number() OVER (ORDER BY sample) - 1 AS INT) AS i, CAST(count(*) OVER () AS INT) AS n FROM (SELECT DISTINCT sample FROM y))", f"cf AS (SELECT sample, i, n, f, f = n // 5 OR f <> CASE WHEN i < (n % (n // 5)) * (n // (n // 5) + 1) THEN i // (n // (n // 5) + 1) ELSE n % (n // 5) + (i - (n % (n // 5)) * (n // (n // 5) + 1)) // (n // (n // 5)) END AS tr FROM ci CROSS JOIN (SELECT unnest(range(0, (SELECT max(n) // 5 + 1 FROM ci))) AS f))"]


def _field(name: str, cube: str) -> list[str]:
    """Standardised by the training samples of each fold; f = n // 5 stands for all samples."""
    return [f"{name}p AS (SELECT {_SER} FROM {cube} GROUP BY ALL HAVING count(value) = count(*) AND stddev_pop(value) > 0)", f"{name}z AS MATERIALIZED (SELECT {_SER}, f, i, tr, value, mu, sd, CASE WHEN sd > 0 THEN (value - mu) / sd ELSE 0 END AS z FROM (SELECT {_SER}, f, i, tr, value, avg(value) FILTER (WHERE tr) OVER w AS mu, stddev_pop(value) FILTER (WHERE tr) OVER w AS sd FROM {cube} JOIN {name}p USING ({_SER}) JOIN cf USING (sample) WINDOW w AS (PARTITION BY {_SER}, f)))", f"{name}g AS MATERIALIZED (SELECT f, a.i, b.i AS j, sum(a.z * b.z) AS x, any_value(a.tr) AS ti, any_value(b.tr) AS tj FROM {name}z a JOIN {name}z b USING ({_SER}, f) GROUP BY ALL)", f"{name}t AS MATERIALIZED (SELECT f, i, j, x FROM {name}g WHERE ti AND tj)", *sql.eigenvectors(f"{name}e", f"{name}t", "f", 3)]


_CCA = XY + _XF + _CI + _field("cx", "xf") + _field("cy", "y") + ["cc AS MATERIALIZED (SELECT f, a.mode AS a, b.mode AS b, sum(a.u * b.u) * sqrt(any_value(a.ew) * any_value(b.ew)) AS x FROM cxe a JOIN cye b USING (f, i) GROUP BY ALL)", "cg AS MATERIALIZED (SELECT f, p.a AS i, q.a AS j, sum(p.x * q.x) AS x FROM cc p JOIN cc q USING (f, b) GROUP BY ALL)", *sql.eigenvectors("ce", "cg", "f", 2), "cw AS MATERIALIZED (SELECT f, p.i AS a, cc.b, sum(p.u * q.u * cc.x / sqrt(p.ew)) AS w FROM ce p JOIN ce q USING (f, mode) JOIN cc ON cc.f = p.f AND cc.a = q.i GROUP BY ALL)", "cp AS MATERIALIZED (SELECT f, cxg.i, mode AS a, sum(x * u / ew) AS p FROM cxg JOIN cxe ON cxe.f = cxg.f AND cxe.i = cxg.j GROUP BY cxg.f, cxg.i, mode)".replace("SELECT f,", "SELECT cxg.f,"), f"cl AS MATERIALIZED (SELECT {_SER}, f, mode AS b, sum(u * z) AS l FROM cyz JOIN cye USING (f, i) GROUP BY ALL)", f"ch AS MATERIALIZED (SELECT {_SER}, f, i, tr, value, mu + sd * sum(p * w * l) AS v FROM cyz JOIN cp USING (f, i) JOIN cw USING (f, a) JOIN cl USING ({_SER}, f, b) GROUP BY {_SER}, f, i, tr, value, mu, sd)", "cm AS (SELECT lat, lon, sample, ch.feature, v FROM ch JOIN ci USING (i) WHERE f = n // 5)"]
add("cca_predict", xy_(lambda x, y: field.CCA(search_override=(3, 3, 2)).fit(prep.fill_spatial_mean(x), y).predict()), _CCA, "SELECT lat, lon, sample, feature, round(v, 6) + 0e0 AS value FROM cm")
_CPB = _CCA + [f"cv AS (SELECT lat, lon, max(n) - 3 AS dof, sum(pow(v - value, 2)) FILTER (WHERE NOT tr) / (max(n) - 3) AS ev FROM ch JOIN ci USING (i) GROUP BY ALL)", f"cq AS (SELECT lat, lon, quantile_cont(value, {lit(1 / 3)}) AS lo, quantile_cont(value, {lit(2 / 3)}) AS hi FROM y JOIN cyp USING ({_SER}) GROUP BY ALL)", "ct AS (SELECT lat, lon, sample, (lo - v) / sqrt(ev) AS tl, (hi - v) / sqrt(ev) AS th, CAST(dof AS INT) AS dof FROM cm JOIN cv USING (lat, lon) JOIN cq USING (lat, lon))", f"cb AS (SELECT lat, lon, sample, {t_sql('tl', 'dof')} AS bn, 1 - {t_sql('th', 'dof')} AS an FROM ct)"]
add("cca_proba", xy_(lambda x, y: field.CCA(search_override=(3, 3, 2)).fit(prep.fill_spatial_mean(x), y).predict_proba()), _CPB, f"SELECT lat, lon, sample, feature, round(v, 6) + 0e0 AS value FROM {terciles_long('cb')}")
add("pcr_quantile_proba", xy_(lambda x, y: field.PCR(2).fit(prep.fill_spatial_mean(x), y).predict_proba(prep.fill_spatial_mean(x), quantile=_LEVELS)), _PCP[:-3] + _levels_t("mm", "mv", "pw0", "y"), everywhere("v", levels_long("lp"), [str(q) for q in _LEVELS]))
add("cca_quantile_proba", xy_(lambda x, y: field.CCA(search_override=(3, 3, 2)).fit(prep.fill_spatial_mean(x), y).predict_proba(quantile=_LEVELS)), _CPB[:-3] + ["cn AS (SELECT lat, lon, sample, v AS fit FROM cm)", f"yy AS (SELECT lat, lon, value AS yv FROM y JOIN cyp USING ({_SER}))"] + _levels_t("cn", "cv", "yy", "yv"), f"SELECT lat, lon, sample, feature, round(v, 6) + 0e0 AS value FROM {levels_long('lp')}")
add("cca_report_x_cca", xy_(lambda x, y: field.CCA(search_override=(3, 3, 2)).fit(prep.fill_spatial_mean(x), y).report()["x_cca"].select("lat", "lon", "feature", "mode", F.abs("value").alias("value"))), _CCA + ["cu AS (SELECT cxe.i, ce.mode, sum(cxe.u * ce.u) AS s FROM cxe JOIN ce ON ce.f = cxe.f AND ce.i = cxe.mode WHERE cxe.f = (SELECT max(f) FROM cf) GROUP BY ALL)"], f"SELECT {_SER}, mode, round(abs(corr(z, s)), 6) + 0e0 AS value FROM cxz JOIN cu USING (i) WHERE f = (SELECT max(f) FROM cf) GROUP BY {_SER}, mode")
add("pcr_report_skill", xy_(lambda x, y: field.PCR(2).fit(prep.fill_spatial_mean(x), y).report()["skill"]), _PCR, "SELECT * FROM (SELECT DISTINCT lat, lon FROM y) LEFT JOIN (SELECT lat, lon, round(corr(fit, y), 6) + 0e0 AS value FROM mm GROUP BY ALL) USING (lat, lon)")
add("cca_search", xy_(lambda x, y: field.CCA().fit(prep.fill_spatial_mean(x), y).error_variance()))

# ---- helpers -------------------------------------------------------------------------------------------------

_ZN = [f"nz AS (SELECT {S4}, (value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END AS z FROM x WINDOW w AS (PARTITION BY {_SER}))"]
_ACT = {"sigm": "1 / (1 + exp(-z))", "tanh": "tanh(z)", "relu": "greatest(0e0, z)", "lin": "z", "softplus": "ln(1 + exp(z))", "leaky": "CASE WHEN z > 0 THEN z ELSE 0.1e0 * z END", "elu": "CASE WHEN z > 0 THEN z ELSE 0.1e0 * (exp(z) - 1) END"}
add("activations", x_(lambda x: prep.Normal().fit(x).transform(x).where("value IS NOT NULL").select("lat", "lon", "sample", "feature", *(f(F.col("value")).alias(n) for n, f in expr.ACTIVATIONS.items()), expr.logit(expr.ACTIVATIONS["sigm"](F.col("value"))).alias("logit"))), X + _ZN, f"SELECT {S4}, {', '.join(f'round({e}, 6) + 0e0 AS {n}' for n, e in _ACT.items())}, round(z, 6) + 0e0 AS logit FROM nz WHERE z IS NOT NULL")


def _stored_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters written as text lines and read again."""
    at = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp()}/parameters-{uuid.uuid4().hex}"
    cells = observed_cube(spark, sf_dir).select("lat", "lon").distinct()
    parameters.save_parameters_text(cells.select("lat", "lon", F.create_map(F.lit("hidden"), (F.abs("lat") / 5 + 1).cast("int").cast("string"), F.lit("activation"), F.when(F.col("lon") > 180, "tanh").otherwise("relu")).alias("params")), at)
    found = parameters.load_parameters(spark, at)
    return found.select("lat", "lon", F.col("params")["hidden"].cast("int").alias("hidden"), F.col("params")["activation"].alias("activation"))


add("parameters_roundtrip", _stored_parameters, Y, "SELECT DISTINCT lat, lon, CAST(floor(abs(lat) / 5 + 1) AS INT) AS hidden, CASE WHEN lon > 180 THEN 'tanh' ELSE 'relu' END AS activation FROM y")
add("lifted_metric", xy_(lambda x, y: verify.lift(lambda p, o: abs(p - o).mean())(continuous(x, y))), XY + _CP, "SELECT lat, lon, round(avg(abs(p - o)), 6) + 0e0 AS value FROM c GROUP BY ALL")


def _aligned(x: DataFrame, y: DataFrame) -> DataFrame:
    core.check(x)
    core.check(y)
    core.check_compatible(x, y)
    a, b = core.align_blocks(x, y)
    return a.join(b.select("block", "lat", "lon", "sample", F.col("value").alias("o")), ["block", "lat", "lon", "sample"]).groupBy("block", "lat", "lon").agg(F.avg(F.col("value") - F.col("o")).alias("value")).drop("block")


add("checked_and_aligned", xy_(_aligned), XY, "SELECT x.lat, x.lon, round(avg(x.value - y.value), 6) + 0e0 AS value FROM x JOIN y USING (lat, lon, sample) GROUP BY ALL")
_KP = _CP + ["k AS (SELECT a.lat, a.lon, sign(b.p - a.p) AS dx, sign(b.o - a.o) AS dy FROM c a JOIN c b ON a.lat = b.lat AND a.lon = b.lon AND a.sample < b.sample)", "ks AS (SELECT lat, lon, sum(dx * dy) AS s, count(*) AS al, sum(abs(dx)) AS ux, sum(abs(dy)) AS uy, (1 + sqrt(1 + 8 * count(*))) / 2 AS n FROM k GROUP BY ALL)", "ma AS (WITH RECURSIVE m(n, c) AS (SELECT 1, [1e0] UNION ALL SELECT n + 1, list_transform(range(0, n * (n + 1) // 2 + 1), lambda k: list_sum(c[greatest(1, k - n + 1) : k + 1])) FROM m WHERE n < 33) SELECT * FROM m)", "kp AS (SELECT lat, lon, s / sqrt(nullif(ux * uy, 0)) AS tau, 2 * list_sum(c[1 : CAST((al - abs(s)) / 2 AS BIGINT) + 1]) / list_sum(c) AS p FROM ks JOIN ma ON ma.n = CAST(ks.n AS INT) WHERE ux = al AND uy = al)"]
add("kendall_p", xy_(lambda x, y: verify.kendall_tau(continuous(x, y), p_value=True)), XY + _KP, "SELECT lat, lon, round(tau, 6) + 0e0 AS kendall_tau, round(least(1, p), 6) + 0e0 AS kendall_p FROM kp")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
