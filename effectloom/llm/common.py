"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from effectloom.sources.workspace import new_path

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the cluster's shared folder: computed once, columnar and
    compressed, and readable after any executor is lost."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def cut_spans(text: Column, places: Column, mark: str) -> Column:
    """text with its spans (begin, end), sorted, replaced by a mark; overlapping spans leave one."""
    state = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))

    def upto(s: Column, end: Column) -> Column:
        return F.concat(s["text"], F.substring(text, (s["at"] + 1).cast("int"), (end - s["at"]).cast("int")))

    return F.aggregate(places, state, lambda s, x: F.struct(
        F.when(x["begin"] >= s["at"], F.concat(upto(s, x["begin"]), F.lit(mark))).otherwise(s["text"]).alias("text"),
        F.greatest(s["at"], x["end"].cast("long")).alias("at")), lambda s: upto(s, F.length(text)))


def n_words(text: Column) -> Column:
    """Words of a text: each word is cut down to one mark, then the marks are counted."""
    space = WORD.replace("^", "")[:-1]
    marks = F.regexp_replace(text, f"{space}*{WORD}{space}*", "x")
    return F.when(text.rlike(WORD), F.length(marks)).otherwise(0).cast("long")


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """df with running totals over one global order, each without the row itself.

    Rows are cut into ranges of the order; each range is summed, the few range
    sums are added up, and rows only look back within their range.  No task sees
    more than a range, and the ranges are written down, so a retry repeats them.
    """
    parts = staged(df.repartitionByRange(*order).withColumns({f"add_{n}": c for n, c in totals.items()} | {"range": F.spark_partition_id()}), "ranges")
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = parts.groupBy("range").agg(*[F.sum(f"add_{n}").alias(f"sum_{n}") for n in totals]).select(
        "range", *[F.coalesce(F.sum(f"sum_{n}").over(ahead), F.lit(0)).alias(f"before_{n}") for n in totals])
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(before, "range").select(*df.columns, *[
        (F.coalesce(F.sum(f"add_{n}").over(within), F.lit(0)) + F.col(f"before_{n}")).alias(n) for n in totals])


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """Column lists of each Arrow batch."""
    for b in batches:
        if b.num_rows:
            yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)


@lru_cache(maxsize=8)
def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine; a path stays as it is."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)
