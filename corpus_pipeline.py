"""Corpus preparation: the training-data operators run one after the other.

Rows are told apart by id, language, source and a hash of their text, so repeated
ids with other texts are judged each on its own; equal rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from effectloom.llm.common import read, staged, text_or_empty
from effectloom.llm.mixing import mix
from effectloom.llm.packing import pack
from effectloom.llm.quality import quality
from effectloom.llm.secrets import redact
from effectloom.llm.simhash import near_duplicates


def row_key() -> Column:
    return F.struct("doc_id", F.xxhash64(text_or_empty()).alias("hash"), "lang", "source")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("doc_id"), "text", "lang", "source")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the perplexity band of their language reject go."""
    kept = quality(keyed(docs)).filter("kept").select(F.col("doc_id").alias("key")).distinct()
    return docs.withColumn("key", row_key()).join(kept, "key", "left_semi").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least row of each group of fingerprints (four-word shingles) linked at four or fewer bits stays, once."""
    first = near_duplicates(keyed(docs), 4, 4).select(F.col("component_id").alias("key")).distinct()
    whole = docs.select(row_key().alias("key"), F.struct(*docs.columns).alias("doc"))
    # of rows with one key the least whole row stays, whatever order they arrive in
    least = whole.join(first, "key", "left_semi").groupBy("key").agg(F.min("doc").alias("doc"))
    return least.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span is replaced by a mark."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's cut is taken whole if more than half of it is."""
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    wanted = mix(keyed(docs)).select(F.col("doc_id").alias("key"), times.alias("times")).groupBy("key").agg(F.max("times").alias("times")).filter("times > 0")
    return docs.withColumn("key", row_key()).join(wanted, "key").select(*docs.columns, F.explode(F.sequence(F.lit(1), "times"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return pack(docs, 1024, "byte_bpe_50k.json", 2)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None  # language-model scores and fingerprints are not expressible in SQL; tests/llm/test_pipeline.py compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what its predecessor kept, through a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
