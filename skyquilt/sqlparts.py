"""DuckDB SQL for what has no built-in there: distribution functions, least squares by orthogonalisation, iterated
reweighting, eigenvectors by repeated squaring. Second computations for the catalogue's queries; nothing here runs on Spark."""

from __future__ import annotations

# ---- distributions -------------------------------------------------------------------------------------------


def norm_cdf(x: str, terms: int = 140) -> str:
    """Standard normal distribution function by its odd series; `x` is a column or a lambda's parameter."""
    series = f"list_sum(list_transform(range(0, {terms}), lambda k: exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))"
    return f"(0.5e0 + sign({x}) * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {series})"


def norm_ppf(p: str) -> str:
    """By Newton steps from 0, which approach monotonically."""
    return f"(CASE WHEN {p} IS NOT NULL THEN list_reduce(list_transform(range(0, 40), lambda i: 0e0 * i), lambda z, i: z - ({norm_cdf('z')} - {p}) * sqrt(2 * pi()) * exp(z * z / 2), 0e0) END)"


def gamma_cdf(x: str, alpha: str, beta: str, terms: int = 1200) -> str:
    """Regularised lower incomplete gamma function by its series of positive terms."""
    return f"list_sum(list_transform(range(0, {terms}), lambda k: exp(-{x} / {beta} + ({alpha} + k) * ln({x} / {beta}) - lgamma({alpha} + k + 1))))"


def gamma_ppf(p: str, alpha: str, beta: str) -> str:
    """By bisection between 0 and eight deviations and 20 scales above the mean, where the series still converges."""
    middle = "((s.lo + s.hi) / 2)"
    step = f"CASE WHEN {gamma_cdf(middle, alpha, beta)} < {p} THEN {{'lo': {middle}, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': {middle}}} END"
    found = f"list_reduce(list_transform(range(0, 70), lambda i: {{'lo': 0e0, 'hi': 0e0 * i}}), lambda s, i: {step}, {{'lo': 0e0, 'hi': {beta} * ({alpha} + 8 * sqrt({alpha}) + 20)}})"
    return f"(({found}).lo + ({found}).hi) / 2"


# ---- least squares -------------------------------------------------------------------------------------------


def least_squares(name: str, source: str, keys: str, columns: list[str], target: str, *, train: str = "true", weight: str = "1e0", keep: str) -> list[str]:
    """CTEs ending in `name`: `keep` and `fit`, the regression of `target` on a constant and `columns` over the rows of each
    `keys` that `train` marks, for all rows. Columns are made orthogonal one after the other (modified Gram-Schmidt)."""
    q = [f"q{k}" for k in range(len(columns) + 1)]
    ctes = [f"{name}_0 AS (SELECT {keep}, {train} AS tr, {weight} AS wt, 1e0 AS q0, " + ", ".join(f"CAST({c} AS DOUBLE) AS {n}" for c, n in zip(columns, q[1:])) + f", CAST({target} AS DOUBLE) AS res, 0e0 AS fit FROM {source})"]
    for k, own in enumerate(q):
        share = lambda v: f"coalesce(sum(wt * {v} * {own}) FILTER (WHERE tr) OVER w / nullif(sum(wt * {own} * {own}) FILTER (WHERE tr) OVER w, 0), 0)"  # noqa: E731, B023
        later = "".join(f", {v} - {share(v)} * {own} AS {v}" for v in q[k + 1 :])
        end = k == len(q) - 1
        ctes.append(f"{name if end else f'{name}_{k + 1}'} AS (SELECT {keep}" + ("" if end else f", tr, wt{later}, res - {share('res')} * {own} AS res") + f", fit + {share('res')} * {own} AS fit FROM {name}_{k} WINDOW w AS (PARTITION BY {keys}))")
    return ctes


def reweighted(name: str, source: str, keys: str, columns: list[str], family: str, *, train: str = "true", keep: str, rounds: int) -> list[str]:
    """CTEs ending in `name`: `keep` and `eta`, the linear predictor of a model of y (a column of `source` and of `keep`) with logit link
    for 'binomial', else log link, after so many rounds of reweighted least squares."""
    start = "ln(least(0.99e0, greatest(0.01e0, y)) / (1 - least(0.99e0, greatest(0.01e0, y))))" if family == "binomial" else "ln(y)"
    ctes = [f"{name}_r0 AS (SELECT {keep}, {', '.join(columns)}, {train} AS tr0, {start} AS eta FROM {source})"]
    rest = f"{keep}, {', '.join(columns)}, tr0"
    for k in range(rounds):
        if family == "binomial":
            mu = "(1 / (1 + exp(-eta)))"
            weight, z = f"({mu} * (1 - {mu}))", f"eta + (y - {mu}) / ({mu} * (1 - {mu}))"
        else:
            mu = "exp(eta)"
            weight, z = ("1e0" if family == "gamma" else mu), f"eta + (y - {mu}) / {mu}"
        ctes.append(f"{name}_w{k} AS (SELECT {rest}, CASE WHEN tr0 THEN {weight} ELSE 0 END AS wk, CASE WHEN tr0 THEN {z} ELSE 0 END AS zk FROM {name}_r{k})")
        ctes += least_squares(f"{name}_l{k}", f"{name}_w{k}", keys, columns, "zk", train="tr0", weight="wk", keep=rest)
        ctes.append(f"{name}_r{k + 1} AS (SELECT {rest}, fit AS eta FROM {name}_l{k})")
    return ctes + [f"{name} AS (SELECT {keep}, eta FROM {name}_r{rounds})"]


# ---- eigenvectors --------------------------------------------------------------------------------------------


def eigenvectors(name: str, gram: str, key: str, modes: int, squarings: int = 14) -> list[str]:
    """CTEs ending in `name`: `key, mode, i, u, ew` of the leading modes of symmetric matrices `key, i, j, x`: each matrix is
    squared again and again until its leading projector is left, then what belongs to that is taken away."""
    ctes, current = [], gram
    for m in range(modes):
        at = current
        for s in range(squarings):
            scaled = f"(SELECT {key}, i, j, x / sum(x) FILTER (WHERE i = j) OVER (PARTITION BY {key}) AS x FROM {at})"
            ctes += [f"{name}_n{m}_{s} AS MATERIALIZED {scaled}", f"{name}_p{m}_{s} AS MATERIALIZED (SELECT {key}, a.i, b.j, sum(a.x * b.x) AS x FROM {name}_n{m}_{s} a JOIN {name}_n{m}_{s} b USING ({key}) WHERE a.j = b.i GROUP BY ALL)"]
            at = f"{name}_p{m}_{s}"
        # the column of the projector with the largest diagonal, scaled to length one
        ctes.append(f"{name}_c{m} AS (SELECT {key}, arg_max(i, x) AS c FROM {at} WHERE i = j GROUP BY {key})")
        ctes.append(f"{name}_u{m} AS MATERIALIZED (SELECT {key}, i, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS u FROM {at} JOIN {name}_c{m} USING ({key}) WHERE j = c)")
        ctes.append(f"{name}_v{m} AS MATERIALIZED (SELECT {key}, sum(g.x * a.u * b.u) AS ew FROM {current} g JOIN {name}_u{m} a USING ({key}) JOIN {name}_u{m} b USING ({key}) WHERE g.i = a.i AND g.j = b.i GROUP BY ALL)")
        ctes.append(f"{name}_g{m} AS MATERIALIZED (SELECT {key}, g.i, g.j, g.x - ew * a.u * b.u AS x FROM {current} g JOIN {name}_v{m} USING ({key}) JOIN {name}_u{m} a USING ({key}) JOIN {name}_u{m} b USING ({key}) WHERE g.i = a.i AND g.j = b.i)")
        current = f"{name}_g{m}"
    return ctes + [f"{name} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {key}, {m} AS mode, i, u, ew FROM {name}_u{m} JOIN {name}_v{m} USING ({key})" for m in range(modes)) + ")"]


def root_trace(name: str, gram: str, key: str, rounds: int = 40) -> list[str]:
    """CTEs ending in `name`: `key, total`, the sum of the square roots of the eigenvalues of symmetric matrices, by the coupled Newton
    iteration Y (3 - Z Y) / 2, (3 - Z Y) Z / 2, whose Y tends to the root."""
    ctes = [f"{name}_t AS MATERIALIZED (SELECT {key}, sum(x) FILTER (WHERE i = j) AS t FROM {gram} GROUP BY {key})", f"{name}_y0 AS MATERIALIZED (SELECT {key}, i, j, x / t AS x FROM {gram} JOIN {name}_t USING ({key}))", f"{name}_z0 AS MATERIALIZED (SELECT {key}, i, j, CASE WHEN i = j THEN 1e0 ELSE 0e0 END AS x FROM {gram})"]
    product = lambda a, b: f"SELECT {key}, a.i, b.j, sum(a.x * b.x) AS x FROM {a} a JOIN {b} b USING ({key}) WHERE a.j = b.i GROUP BY ALL"
    for k in range(rounds):
        y, z, t = f"{name}_y{k}", f"{name}_z{k}", f"{name}_h{k}"
        ctes.append(f"{t} AS MATERIALIZED (SELECT {key}, i, j, (CASE WHEN i = j THEN 3 ELSE 0 END - x) / 2 AS x FROM ({product(z, y)}))")
        ctes += [f"{name}_y{k + 1} AS MATERIALIZED ({product(y, t)})", f"{name}_z{k + 1} AS MATERIALIZED ({product(t, z)})"]
    return ctes + [f"{name} AS (SELECT {key}, sqrt(max(t)) * sum(x) FILTER (WHERE i = j) AS total FROM {name}_y{rounds} JOIN {name}_t USING ({key}) GROUP BY {key})"]
