"""Sinks, catalogue and the parameter-table cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import _hadoop_path, read_table


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    df.write.mode(mode).csv(path, header=True)
    return path


def write_documents(df: DataFrame, path: str, partition_by: list[str], mode: str = "errorifexists") -> str:
    """JSON documents laid out by partition columns (for example the as-of date).

    Partition by columns with few values; one folder per user would not
    survive a large population, so the user id stays inside the document.
    """
    df.write.mode(mode).partitionBy(*partition_by).json(path)
    return path


def catalogue(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Rows, columns, bytes and field names per table, one row each."""
    parts = []
    for name, path in files.items():
        df = read_table(spark, path)
        fs, p = _hadoop_path(spark, path)
        size = fs.getContentSummary(p).getLength()
        parts.append(df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows",
            F.lit(len(df.columns)).cast("long").alias("n_columns"),
            F.lit(size).cast("long").alias("size_bytes"),
            F.lit(", ".join(df.columns)).alias("fields")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_through(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                 asof: str, max_age_months: int = 3) -> DataFrame:
    """Return the cached table when fresh at ``asof``, else build and write it.

    Each refresh lands in its own ``built_on=`` folder, so a reader of an older
    copy is never disturbed.
    """
    fs, p = _hadoop_path(spark, path)
    if fs.exists(p):
        cached = spark.read.parquet(path)
        fresh = (cached.select(F.to_date(F.col("built_on").cast("string")).alias("d")).agg(F.max("d").alias("d"))
                 .filter(F.col("d") >= F.add_months(F.to_date(F.lit(asof)), -max_age_months)).first())
        if fresh is not None:
            return cached.filter(F.to_date(F.col("built_on").cast("string")) == F.lit(fresh["d"])).drop("built_on")
    (build().withColumn("built_on", F.lit(asof))
     .write.mode("append").partitionBy("built_on").parquet(path))
    return spark.read.parquet(path).filter(
        F.to_date(F.col("built_on").cast("string")) == F.to_date(F.lit(asof))).drop("built_on")
