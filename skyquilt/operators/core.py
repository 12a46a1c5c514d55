"""Cubes as long tables: roles of columns, checks, density."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyquilt.functions.expr import nan_to_null

AXES = ("lat", "lon", "sample", "feature")
#: Upper-case names by which a column's role is guessed.
SYNONYMS = {
    "lon": ("LONGITUDE", "LONG", "X", "LON"),
    "lat": ("LATITUDE", "LAT", "LATI", "Y"),
    "sample": ("T", "S", "TIME", "SAMPLES", "SAMPLE", "INITIALIZATION", "INIT", "D", "DATE", "TARGET", "YEAR", "I", "N"),
    "feature": ("M", "MODE", "FEATURES", "F", "REALIZATION", "MEMBER", "Z", "C", "CAT", "NUMBER", "V", "VARIABLE", "VAR", "P", "LEVEL"),
}


@dataclass(frozen=True)
class CubeSpec:
    """Names of a table's axis columns and of its value."""

    lat: str = "lat"
    lon: str = "lon"
    sample: str = "sample"
    feature: str = "feature"
    value: str = "value"


def guess_columns(labels: list[str], lat: str | None = None, lon: str | None = None, sample: str | None = None, feature: str | None = None) -> dict[str, str | None]:
    """The column of each role. Given names must exist; the first label with a synonym takes its role; one label and
    one role left over are paired; a role that stays open is None."""
    out = {"lat": lat, "lon": lon, "sample": sample, "feature": feature}
    for role, name in out.items():
        if name is not None and name not in labels:
            raise ValueError(f"{name!r}, named for {role}, is no column")
    rest = [x for x in labels if x not in out.values()]
    for label in list(rest):
        for role, names in SYNONYMS.items():
            if out[role] is None and label.upper() in names:
                out[role] = label
                rest.remove(label)
                break
    missing = [role for role in out if out[role] is None]
    if len(missing) == 1 and len(rest) == 1:
        out[missing[0]] = rest[0]
    return out


def canonical(df: DataFrame, spec: CubeSpec = CubeSpec()) -> DataFrame:
    """The cube under its canonical names, missing values NULL; other columns are left out."""
    have = [(getattr(spec, a), a) for a in AXES if getattr(spec, a) in df.columns]
    return df.select(*(F.col(f"`{c}`").alias(a) for c, a in have), nan_to_null(F.col(f"`{spec.value}`").cast("double")).alias("value"))


def guessed(df: DataFrame, value: str = "value", **names: str) -> DataFrame:
    """`canonical` with roles guessed from the column names."""
    found = guess_columns([c for c in df.columns if c != value], **names)
    if missing := [r for r, c in found.items() if c is None]:
        raise ValueError(f"no column for {', '.join(missing)}")
    return canonical(df, CubeSpec(**found, value=value))


def shape(cube: DataFrame) -> DataFrame:
    """One row: numbers of distinct coordinates in the order lat, lon, sample, feature."""
    return cube.agg(*(F.countDistinct(a).cast("long").alias(f"n_{a}") for a in AXES))


def coords(cube: DataFrame, *axes: str) -> DataFrame:
    return cube.select(*axes).distinct()


def _shared_dir(spark: SparkSession) -> str | None:
    """The folder that all executors share (`spark.checkpoint.dir`); where it is unset a temporary one on a local master, else None."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        at = tempfile.mkdtemp(prefix="skyquilt-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return at if not at or "://" in at or at.startswith("file:") else f"file://{at}"


def settled(cube: DataFrame) -> DataFrame:
    """The cube written as a table in the shared folder and read back, so that what it is made of is computed once, now. Without such a
    folder it stays a plan."""
    spark = cube.sparkSession
    if not (shared := _shared_dir(spark)):
        return cube
    at = f"{shared.rstrip('/')}/skyquilt/cube-{uuid.uuid4().hex}"
    cube.write.parquet(at)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in cube.schema])).parquet(at)


def dense(cube: DataFrame, *, cells: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """Every combination of cell, sample and feature, absent ones with NULL. Coordinate lists are small beside the cube.

    The cube is settled first: three lists of coordinates and the join read it, and whoever uses the result does so again.
    """
    cube = settled(cube)
    grid = coords(cube, *cells).crossJoin(coords(cube, "sample")).crossJoin(coords(cube, "feature"))
    return grid.join(cube, [*cells, "sample", "feature"], "left").select("lat", "lon", "sample", "feature", "value")


def check(cube: DataFrame) -> DataFrame:
    """Raises ValueError unless the canonical columns exist, `value` is numeric and no coordinate combination repeats."""
    if missing := [c for c in (*AXES, "value") if c not in cube.columns]:
        raise ValueError(f"the cube has no {', '.join(missing)}")
    if dict(cube.dtypes)["value"] not in ("double", "float", "int", "bigint") and not dict(cube.dtypes)["value"].startswith("decimal"):
        raise ValueError("value isn't numeric")
    if cube.groupBy(*AXES).count().where("count > 1").limit(1).count():
        raise ValueError("coordinates repeat")
    return cube


def check_compatible(x: DataFrame, y: DataFrame) -> None:
    """Raises ValueError unless both have the same cells and samples. Reads either cube once."""
    both = (("lat", "lon"), ("sample",))

    def seen(cube: DataFrame, side: int) -> DataFrame:
        named = lambda axes: (F.when(F.lit(a in axes), F.col(a)).alias(a) for own in both for a in own)
        places = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *named(axes)) for k, axes in enumerate(both))))
        return cube.select(places.alias("p")).select("p.*", F.lit(side).alias("side"))

    sides = seen(x, 0).unionByName(seen(y, 1)).groupBy("k", "lat", "lon", "sample").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    if (k := sides.where("lo = hi").agg(F.min("k")).first()[0]) is not None:
        raise ValueError(f"the cubes differ in {', '.join(both[k])}")


def align_blocks(x: DataFrame, y: DataFrame, lat_blocks: int = 5, lon_blocks: int = 5) -> tuple[DataFrame, DataFrame]:
    """Both cubes hash-partitioned alike by block of cells; a later join or grouped fit per cell needs no other shuffle."""
    block = F.pmod(F.hash("lat", "lon"), F.lit(lat_blocks * lon_blocks))
    return tuple(c.withColumn("block", block).repartition(lat_blocks * lon_blocks, "block") for c in (x, y))
