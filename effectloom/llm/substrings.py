"""Substring dedup by hashing the units of all documents.

Units are lines, cut further at sentence ends: a passage that stands inside
another line still keeps its own sentences.  Every unit with a word is normalised
(white space, case) and hashed to 128 bits.  Digests are grouped over the corpus:
the earliest occurrence, by document id and place, stays, and all others count as
repeats.  Consecutive repeats of a document form a stretch, and a stretch of
min_words words or more is removed unit by unit, with the offsets in the original
text; shorter ones, such as a sentence that happens to recur, are left alone.

The groups are pre-aggregated to (earliest, count) and joined back to the units;
a digest found in very many documents is a skewed key of that join, which Spark
splits, and no task collects a group.  Stretches are found within a document.

null text: no units.  Null ids rank last; rows with one id are told apart by a
row number that is written down with the units.  An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut_spans, rows, staged, text_or_empty

ENDS = (". ", "! ", "? ")


def units_of(text: str):
    """(place, begin, end, words, digest) of the units that hold a word; places are consecutive."""
    for end in ENDS:
        text = text.replace(end, end[0] + "\n")
    at = place = 0
    for unit in text.split("\n"):
        words = unit.split()
        if words:
            yield place, at, at + len(unit), len(words), xxhash.xxh3_128_digest(" ".join(words).lower().encode("utf-8", "surrogatepass"))
            place += 1
        at += len(unit) + 1


def units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, place, begin, end, words, high, low) of every unit."""
    kind = docs.select(id_col).schema[0].dataType
    arrow = to_arrow_type(kind)
    names = ["row", "id", "place", "begin", "end", "words", "high", "low"]

    def cut(batches):
        for numbers, ids, texts in rows(batches, "row", "id", "text"):
            found = [(n, i, *u[:4], int.from_bytes(u[4][:8], "big", signed=True), int.from_bytes(u[4][8:], "big", signed=True))
                     for n, i, t in zip(numbers, ids, texts) for u in units_of(t)]
            for k in range(0, len(found), 100_000):
                cols = list(zip(*found[k:k + 100_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow if n == "id" else pa.int64()) for n, c in zip(names, cols)], names=names)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return numbered.mapInArrow(cut, f"row long, id {kind.simpleString()}, place long, begin long, end long, words long, high long, low long")


def repeated_units(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per removed unit: id, place, begin, end, kept_id, kept_begin, digest, n_found, stretch_words."""
    table = staged(units(docs, id_col, text_col), "units")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "place", "row", "begin")
    # written down, so that the join below reads both sides from shuffles of their own and splits a digest that very many units share
    groups = staged(table.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n_found")).filter("n_found > 1"), "repeated-digests")
    later = (F.col("row") != F.col("first.row")) | (F.col("place") != F.col("first.place"))
    repeats = table.join(groups, ["high", "low"]).filter(later)
    # places of a stretch minus their number in the document are one value
    stretch = repeats.withColumn("stretch", F.col("place") - F.row_number().over(Window.partitionBy("row").orderBy("place")))
    long = stretch.withColumn("stretch_words", F.sum("words").over(Window.partitionBy("row", "stretch"))).filter(F.col("stretch_words") >= min_words)
    digest = F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in ("high", "low")])
    return long.select(F.col("id").alias(id_col), "place", "begin", "end", F.col("first.id").alias(f"kept_{id_col}"), F.col("first.begin").alias("kept_begin"),
                       digest.alias("digest"), "n_found", "stretch_words")


def without_repeats(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with removed units cut out of their texts, and `removed`, their (begin, end) in the
    original text (empty: none); equal (id, text) rows keep what one of them keeps."""
    key = F.struct(F.col(id_col), F.xxhash64(text_or_empty(text_col)))
    gone = repeated_units(docs.withColumn(id_col, key), min_words, id_col, text_col)
    places = gone.groupBy(F.col(id_col).alias("key")).agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("places"))
    out = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("key")).join(places, "key", "left")
    text = F.col("doc")[text_col]
    removed = F.coalesce("places", F.array().cast("array<struct<begin:bigint,end:bigint>>"))
    return out.select(*[F.when(F.col("places").isNotNull(), cut_spans(text, F.col("places"), "")).otherwise(text).alias(c) if c == text_col else F.col("doc")[c].alias(c)
                        for c in docs.columns], removed.alias("removed"))
