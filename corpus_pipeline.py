"""A training corpus from `documents`: toxic texts and site boilerplate go, near copies go, sources are mixed, sequences are packed.

STAGES are (name, function) in order. A function takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame
that is written as Parquet and reread as the next one's docs. All but the last return the columns of documents.
Null texts count as empty texts; null ids are carried along. No stage shortens its input to be cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.llm import linededup, mixing, packing, simhash, toxicity
from skyquilt.llm.common import WORD, written
from skyquilt.llm.queries import may_learn

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7; as in op2, a third of the labels isn't learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.Toxicity().fit(docs, labels, train=may_learn())
    return model.score(docs.select(*COLUMNS), score_col="__score").where("__score < 0.7").select(*COLUMNS)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on over 5% of a source's documents are cut; documents that lose all their words go. n_chars follows the text."""
    out = linededup.drop_boilerplate(docs.select(*COLUMNS), ratio=0.05, min_pages=3, dropped_col="__dropped")
    out = out.where((F.col("__dropped") == 0) | F.col("text").rlike(WORD))
    return out.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by SimHash, of five-word shingles within five bits, the one with the smallest id stays."""
    return simhash.deduplicate(docs.select(*COLUMNS), width=5, distance=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words; n_chars follows a text of which a part is taken."""
    docs = docs.select(*COLUMNS)
    out = mixing.repeat_taken(docs, mixing.mix(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens, as op3 returns them."""
    return packing.pack(docs, window=2048, end_id=1)


STAGES = [("toxicity", without_toxic), ("line dedup", without_boilerplate), ("simhash", without_copies), ("mixing", mixed), ("packing", packed)]

#: Trained models and hashed fingerprints aren't SQL; tests/llm/test_pipeline.py holds run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
