"""Shared plumbing of the training-data operators: quoting, work folders, written tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the only separators of words: `[^\x20\x09-\x0D]+` are the words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def col(name: str) -> Column:
    """The top-level column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def base_dir(spark: SparkSession) -> str:
    """The folder shared by all executors (`spark.checkpoint.dir`); where it is unset a temporary one, on a local master alone."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="skyquilt-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return at if "://" in at or at.startswith("file:") else f"file://{at}"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh URI below the shared folder."""
    return f"{base_dir(spark).rstrip('/')}/skyquilt/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *, partitions: int | None = None) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read back: lineage ends here, and no lost executor loses it."""
    spark = df.sparkSession
    at = work_dir(spark, name)
    (df.coalesce(partitions) if partitions else df).write.mode("overwrite").parquet(at)
    out = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(at)
    out._written_at = at
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once a row, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def filesystem(uri: str):
    """pyarrow's file system of a URI, and the path in it; used by tasks that write or read archive files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:///", "/", 1) if uri.startswith("file:///") else uri)


def parent_made(filesystem_, path: str) -> None:
    filesystem_.create_dir(path.rpartition("/")[0], recursive=True)
