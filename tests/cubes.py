"""Small cubes, and the same as arrays."""

import datetime as dt

import numpy as np

SCHEMA = "lat double, lon double, sample date, feature string, value double"


def days(n, start="1999-01-01", step=31):
    first = dt.date.fromisoformat(start)
    return [first + dt.timedelta(days=step * i) for i in range(n)]


def cube(spark, values, lats=None, lons=None, samples=None, features=None):
    """values: lat x lon x sample x feature; NaN is missing."""
    v = np.asarray(values, float)
    lats = lats or [float(i) for i in range(v.shape[0])]
    lons = lons or [float(i) for i in range(v.shape[1])]
    samples, features = samples or days(v.shape[2]), features or [f"f{i}" for i in range(v.shape[3])]
    rows = [(a, o, s, f, None if np.isnan(v[i, j, k, m]) else float(v[i, j, k, m])) for i, a in enumerate(lats) for j, o in enumerate(lons) for k, s in enumerate(samples) for m, f in enumerate(features)]
    return spark.createDataFrame(rows, SCHEMA)


def series(spark, *columns):
    """One cell; a feature per column."""
    return cube(spark, np.array(columns, float).T[None, None])


def array(df, features=None):
    """lat x lon x sample x feature in ascending order of labels."""
    rows = df.collect()
    axes = [sorted({r[a] for r in rows}) for a in ("lat", "lon", "sample")] + [features or sorted({r["feature"] for r in rows})]
    out = np.full([len(a) for a in axes], np.nan)
    for r in rows:
        at = tuple(a.index(r[n]) for a, n in zip(axes, ("lat", "lon", "sample", "feature")))
        out[at] = np.nan if r["value"] is None else r["value"]
    return out


def counted(spark, df):
    """The same rows, and an accumulator of how many were made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(len(b))
            yield b

    return df.mapInPandas(run, df.schema), made
