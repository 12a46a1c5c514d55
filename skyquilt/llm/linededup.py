"""Boilerplate lines by site-relative frequency, in DataFrame operations only.

Rows are grouped by host. A line's ratio is the number of the host's pages that contain it over all pages of
the host; lines above `ratio` that at least `min_pages` pages contain are dropped from that host's pages. A host with p pages of
l distinct lines on average has at most l / ratio such lines, so the lists that are joined back hold few keys a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.llm.common import SPACE, WORD, col, written


def _key(line: Column) -> Column:
    return F.md5(line)


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, rf"^{SPACE}+|{SPACE}+$", "")


def _host_key(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit("n"))


def boilerplate(pages: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 3) -> DataFrame:
    """`host, key, pages, total` of the lines to drop; `host` is null-safe text, `key` the MD5 of the trimmed line."""
    rows = pages.select(_host_key(col(host_col)).alias("host"), col(text_col).cast("string").alias("text"))
    lines = rows.select("host", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _trimmed))).alias("line")).where("line <> ''")
    counts = lines.groupBy("host", _key(F.col("line")).alias("key")).agg(F.count("*").alias("pages")).where(f"pages >= {int(min_pages)}")
    totals = rows.groupBy("host").agg(F.count("*").alias("total"))
    return counts.join(totals, "host").where(F.col("pages") > F.lit(float(ratio)) * F.col("total"))


def drop_boilerplate(pages: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 3, lines_col: str | None = None, dropped_col: str | None = None) -> DataFrame:
    """`pages` with the boilerplate lines cut out of the text; on request with the numbers of lines and of dropped lines.

    Lines are what line feeds part; they are compared without ASCII white space at both ends, and blank lines are
    neither counted nor dropped. A text that loses all lines is empty; null texts stay null (0 lines) but
    count as pages; null hosts are one host; repeated rows are pages of their own; other columns, whatever their names, stay.
    """
    lists = boilerplate(pages, host_col=host_col, text_col=text_col, ratio=ratio, min_pages=min_pages).groupBy("host").agg(F.collect_set("key").alias("keys"))
    # as a table of its own, its size is known: Spark broadcasts it while it is small, else the adaptive skew join splits hot hosts
    lists = written(lists.select(F.col("host").alias("__sq_host"), F.col("keys").alias("__sq_keys")), "boilerplate-lists")
    packed = pages.select(F.struct(*(col(c) for c in pages.columns)).alias("__sq_row"), _host_key(col(host_col)).alias("__sq_key"))
    joined = packed.join(lists, F.col("__sq_key") == F.col("__sq_host"), "left")
    field = F.col("__sq_row").getField(text_col).cast("string")
    whole = F.split(field, "\n")
    stays = lambda line: ~F.array_contains(F.col("__sq_keys"), _key(_trimmed(line)))
    joined = joined.withColumn("__sq_lines", F.when(F.col("__sq_keys").isNotNull(), F.filter(whole, stays)))
    blank = lambda line: ~line.rlike(WORD)
    text = F.when(F.col("__sq_lines").isNull(), field).otherwise(F.array_join("__sq_lines", "\n"))
    out = [text.alias(c) if c == text_col else F.col("__sq_row").getField(c).alias(c) for c in pages.columns]
    counted = lambda lines: F.coalesce(F.size(F.filter(lines, lambda x: ~blank(x))), F.lit(0)).cast("long")
    if lines_col:
        out.append(F.when(field.isNull(), F.lit(0).cast("long")).otherwise(counted(whole)).alias(lines_col))
    if dropped_col:
        out.append(F.when(F.col("__sq_lines").isNull(), F.lit(0).cast("long")).otherwise((F.size(whole) - F.size("__sq_lines")).cast("long")).alias(dropped_col))
    return joined.select(*out)
