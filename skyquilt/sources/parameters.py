"""Hyper-parameters per cell, as JSON lines or as text lines `lat lon {dict}`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_parameters(params: DataFrame, path: str) -> None:
    """`lat, lon, params map<string,string>` as JSON lines."""
    params.select("lat", "lon", "params").write.mode("overwrite").json(path)


def save_parameters_text(params: DataFrame, path: str) -> None:
    """One text line per cell."""
    params.select(F.concat_ws(" ", F.col("lat").cast("string"), F.col("lon").cast("string"), F.to_json("params"))).write.mode("overwrite").text(path)


def load_parameters(spark: SparkSession, path: str) -> DataFrame:
    """Cells sorted by place; text lines may use single quotes, None, True, False and nan. `nan` alone is an empty map."""
    line = F.trim(F.col("value"))
    parts = F.split(line, r"\s+", 3)
    body = F.element_at(parts, 3)
    for old, new in ((r"'", '"'), (r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"^nan$", "{}"), (r":\s*nan\b", ": null")):
        body = F.regexp_replace(body, old, new)
    lines = spark.read.text(path).where(F.length(line) > 0)
    return lines.select(F.element_at(parts, 1).cast("double").alias("lat"), F.element_at(parts, 2).cast("double").alias("lon"), F.from_json(body, "map<string,string>").alias("params")).orderBy("lat", "lon")
