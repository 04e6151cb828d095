"""Mixing sources to target weights with exact budgets.

Each source gets a target: the mix's size shared by weight, never above cap
times the source's own size, the excess going to the others by weight.  Each
document gets a hash-random key.  Within a source documents are ordered by that
key, running totals of their sizes are computed, and the order is cut where the
source's budget ends; budgets above the source's size repeat it for whole epochs
first.  The document at the cut is taken in part, so budgets are met exactly.

The leading digits of the key are uniform, so they range-partition every source:
a hot source is spread over 4096 ranges, only the range sums of a source meet in
one task, and the result doesn't depend on the partitioning.

null text counts 0 words; null sources form one source, last in order; rows with
a null or repeated id are kept (ties of the key are ordered by id and size).
Documents without words take 0.  An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, running_totals, staged, text_or_empty


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """sizes (source, source_size) with weight and target; the water level is found in order of cap / weight."""
    ranked = running_totals(sizes, [F.col("source").isNull(), F.col("source")], {"nth": F.lit(1)})
    nth = F.col("nth") % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    capped = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most"))
    order = [F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    filled = running_totals(capped, order, {"most_before": F.col("most"), "weight_before": F.col("weight")})
    total, all_weights = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return capped.withColumn("target", F.lit(0.0)).drop("most")
    level = (F.lit(share * total) - F.col("most_before")) / (F.lit(all_weights) - F.col("weight_before"))
    filled = filled.withColumn("level", level)
    # the first source in that order whose cap is above the level: it and all later ones share by weight
    water = filled.filter(F.col("most") / F.col("weight") > F.col("level")).agg(F.min_by("level", "most_before")).first()[0]
    target = F.col("most") if water is None else F.least("most", F.col("weight") * F.lit(water))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words of the mix from it).

    weights: given to the sources by code point, in turns; share: words of the mix
    over all words; cap: most words taken of a source or document over its own.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = staged(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text_or_empty(text_col)).alias("size"), key.alias("key")), "sizes").select(
        "*", F.substring("key", 1, 3).alias("bucket"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("group"))
    ranges = staged(sized.groupBy("group", "source", "bucket").agg(F.sum("size").alias("range_size")), "range-sums")
    sources = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = staged(source_targets(sources, weights, share, cap), "targets").select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("group"), "source_size", "target")
    ahead = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(ahead), F.lit(0))).join(targets, "group").select(
        "group", "bucket", "before", "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"))
    within = Window.partitionBy("group", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("before")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return sized.join(ranges, ["group", "bucket"]).select(
        F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


MIX_SQL = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
 md5('mix:' || coalesce(CAST(doc_id AS VARCHAR),'')) AS k FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE nth % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w, source_size * 2.0::DOUBLE AS most FROM s),
f AS (SELECT *, coalesce(sum(most) OVER o, 0.0) AS mb, coalesce(sum(w) OVER o, 0.0) AS wb FROM w
 WINDOW o AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, ((SELECT sum(source_size) FROM w)::DOUBLE * 1.5 - mb) / ((SELECT sum(w) FROM w) - wb) AS level FROM f),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(most, coalesce(w * (SELECT min_by(level, mb) FROM l WHERE most / w > level), most)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
 coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
 CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken FROM e"""
