"""Column builders: quantiles, ranks, strict aggregates, Student's t, activations. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

CELL = ("lat", "lon")
SERIES = ("lat", "lon", "feature")


def nan_to_null(value: Column) -> Column:
    """Missing is NULL inside the engine; NaN would sort above every number and enter averages."""
    return F.nanvl(value, F.lit(None).cast("double"))


def midpoint_of(ordered: Column, q: float) -> Column:
    """Midpoint quantile of an ascending array without nulls: the mean of the two neighbours of q (n - 1)."""
    place = (F.size(ordered) - 1) * F.lit(float(q))
    low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
    return F.when(F.size(ordered) > 0, (F.get(ordered, low) + F.get(ordered, high)) / 2)


def q_mid(value: str | Column, q: float) -> Column:
    """Aggregate: midpoint quantile of the values that aren't missing."""
    value = F.col(value) if isinstance(value, str) else value
    return midpoint_of(F.sort_array(F.collect_list(value)), q)


def q_lin(value: str | Column, q: float) -> Column:
    """Aggregate: linearly interpolated quantile."""
    return F.percentile(value, F.lit(float(q)))


def strict(aggregate: Column, value: str | Column) -> Column:
    """The aggregate, or NULL if any value is missing."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(F.lit(1)) == F.count(value), aggregate)


def avg_rank(order: str | Column, *keys: str | Column) -> Column:
    """Average rank, from 1, of `order` within `keys`; ties share the mean of their ranks."""
    order = F.col(order) if isinstance(order, str) else order
    own = Window.partitionBy(*keys)
    return F.rank().over(own.orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, order)) - 1) / 2


def first_max(pairs: Column) -> Column:
    """Aggregate over struct(-value, index): the index of the largest value, the first of ties."""
    return F.min(pairs)


def t_cdf(t: Column, dof: Column) -> Column:
    """Student's t distribution for whole degrees of freedom, by its finite series in cos^2 of atan(t / sqrt(dof)).

    NULL where dof < 1.
    """
    theta = F.atan(t / F.sqrt(dof))
    c2 = F.cos(theta) * F.cos(theta)
    # odd dof: (theta + sin cos (1 + 2/3 c2 + 2/3 4/5 c2^2 ...)) * 2 / pi; even: sin (1 + 1/2 c2 + 1/2 3/4 c2^2 ...)
    odd = (dof % 2) == 1
    terms = F.when(odd, F.floor((dof - 1) / 2)).otherwise(F.floor(dof / 2)).cast("int")
    state = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def step(s, k):
        total = s["sum"] + s["term"]
        factor = F.when(odd, (2 * k) / (2 * k + 1.0)).otherwise((2 * k - 1) / (2.0 * k))
        return F.struct((s["term"] * c2 * factor).alias("term"), total.alias("sum"))

    series = F.aggregate(F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), state, step, lambda s: s["sum"])
    sin_, cos_ = F.sin(theta), F.cos(theta)
    area = F.when(odd, (theta + sin_ * cos_ * series) * 2 / F.pi()).otherwise(sin_ * series)
    return F.when(dof >= 1, 0.5 + area / 2)


def two_sided_p(r: Column, n: Column) -> Column:
    """p-value of a correlation r of n pairs; NULL for fewer than 3, 0 for |r| = 1."""
    dof = n - 2
    t = F.abs(r) * F.sqrt(dof / F.nullif(1 - r * r, F.lit(0.0)))
    return F.when(dof < 1, None).when(F.abs(r) >= 1, 0.0).otherwise(2 * (1 - t_cdf(t, dof)))


#: Activations by name, as Column functions; kernels.ACTIVATIONS have the same on arrays.
ACTIVATIONS = {
    "sigm": lambda x: 1 / (1 + F.exp(-x)),
    "tanh": F.tanh,
    "relu": lambda x: F.greatest(F.lit(0.0), x),
    "lin": lambda x: x,
    "softplus": lambda x: F.log1p(F.exp(x)),
    "leaky": lambda x: F.when(x > 0, x).otherwise(0.1 * x),
    "elu": lambda x: F.when(x > 0, x).otherwise(0.1 * (F.exp(x) - 1)),
}


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))
