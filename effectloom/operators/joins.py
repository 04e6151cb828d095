"""Membership, interval, as-of, lookup and nearest-score joins."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import SLICE_ROWS, carry, seconds

BROADCAST_ROWS = 100_000  # rule tables above this size are left to the optimizer
BROADCAST_CHARS = 64_000_000  # and so are those whose rows are longer than this in all, as text


def flag_members(df: DataFrame, members: DataFrame, key: str, out: str) -> DataFrame:
    """0/1 membership of key in another table (keys made unique first)."""
    keys = members.select(key).distinct().withColumn(out, F.lit(1))
    return df.join(keys, key, "left").na.fill(0, [out])


def without(df: DataFrame, other: DataFrame, key: str | list[str]) -> DataFrame:
    return df.join(other, key, "left_anti")


def small(table: DataFrame) -> DataFrame:
    """Broadcast only after counting rows and characters; a larger table joins by shuffle.

    Materialize a derived table first: counting computes it once more.
    """
    size = table.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(table) if size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_CHARS else table


def lookup(df: DataFrame, dim: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join to a small dimension; unmatched rows take the default row."""
    return df.join(small(dim), key, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def tier_lookup(df: DataFrame, amount: Column, steps: list[tuple[float, float | None, float]], out: str) -> DataFrame:
    """Rate of the bracket [lower, upper) that holds the amount.

    The brackets are a short rule list, so they become one CASE expression
    instead of a theta join.
    """
    rate = F.lit(None).cast("double")
    for lower, upper, value in reversed(steps):
        inside = amount >= F.lit(float(lower))
        if upper is not None:
            inside = inside & (amount < F.lit(float(upper)))
        rate = F.when(inside, F.lit(float(value))).otherwise(rate)
    return df.withColumn(out, rate)


def bracket_sum(amount: Column, steps: list[tuple[float, float | None, float]]) -> Column:
    """Marginal total: each slice of the amount times its bracket's rate."""
    total = F.lit(0.0)
    for lower, upper, rate in steps:
        part = amount - F.lit(float(lower))
        if upper is not None:
            part = F.least(part, F.lit(float(upper) - float(lower)))
        total = total + F.greatest(part, F.lit(0.0)) * F.lit(float(rate))
    return total


def _tagged(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
            payload: list[str], left_first: bool) -> DataFrame:
    side = F.lit(0 if left_first else 1)
    l = left.select(F.struct(*left.columns).alias("__left"), F.col(key).alias("__key"), seconds(left_ts).alias("__pos"),
                    F.lit(None).cast(right.select(F.struct(right_ts, *payload)).schema[0].dataType).alias("__right"),
                    side.alias("__side"))
    r = right.select(F.lit(None).cast(l.schema["__left"].dataType).alias("__left"), F.col(key).alias("__key"),
                     seconds(right_ts).alias("__pos"), F.struct(right_ts, *payload).alias("__right"),
                     F.lit(1 if left_first else 0).alias("__side"))
    return l.unionByName(r)


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, payload: list[str],
              direction: str = "back", strict: bool = False, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Latest right row at or before (back) / first at or after (ahead) each left row.

    Union plus a carried value: linear in both sides, no pair expansion.
    ``strict`` excludes equal times.  At equal right times any one of the tied
    rows is acceptable to the caller, so keep right keys unique per time.
    """
    # At equal position the right row must sort before the left row when it may
    # match backwards, and after it when it may match ahead.
    left_first = (direction == "back") == strict
    tagged = _tagged(left, right, key, left_ts, right_ts, payload, left_first)
    got = carry(tagged, ["__key"], ["__pos", "__side"], {"__match": F.col("__right")},
                direction=direction, slice_rows=slice_rows).filter(F.col("__left").isNotNull())
    return got.select("__left.*", F.col(f"__match.{right_ts}").alias(right_ts),
                      *[F.col(f"__match.{c}").alias(c) for c in payload])


def within_interval(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, days: int,
                    payload: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """First right event strictly after the left time and within ``days`` of it.

    A range join would pair every row of a hot key; the next-event carry does not.
    """
    nxt = asof_join(left, right, key, left_ts, right_ts, payload, "ahead", True, slice_rows)
    hit = F.datediff(F.col(right_ts), F.col(left_ts)) <= days
    return nxt.withColumns({c: F.when(hit, F.col(c)) for c in [right_ts, *payload]}).withColumn(
        "matched", F.coalesce(hit, F.lit(False)))


def common_neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, via) for node pairs joined through a third node, a < b.

    For the variable graph of a causal search (at most a few dozen nodes).
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    left = both.select(F.col("a").alias("a"), F.col("b").alias("via"))
    right = both.select(F.col("b").alias("b"), F.col("a").alias("via"))
    return left.join(right, "via").filter(F.col("a") < F.col("b")).select("a", "b", "via")


def score_slices(scores: DataFrame, score: str, slices: int) -> DataFrame:
    """Range slices of near-equal size from a mergeable quantile sketch."""
    probs = [i / slices for i in range(1, slices)]
    cuts = scores.agg(F.approx_percentile(score, [float(p) for p in probs], 10_000).alias("q")).first()["q"] if probs else []
    if not cuts:
        return scores.withColumn("__slice", F.lit(0.0))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    return Bucketizer(splits=splits, inputCol=score, outputCol="__slice").transform(scores)


def nearest_match(df: DataFrame, key: str, treated: str, score: str, slices: int | None = None,
                  slice_rows: int = SLICE_ROWS) -> DataFrame:
    """1-NN of every treated row among controls on a scalar score, with replacement.

    Scores are reduced to distinct values first (many units may share one
    score), ordered inside range slices, and the nearest control below/above is
    carried across slices.  Equal distances go to the lower control key.
    """
    base = df.select(F.col(key).alias("__key"), F.col(treated).cast("int").alias("__t"),
                     F.col(score).cast("double").alias("__s")).na.drop()
    points = base.groupBy("__s").agg(F.min(F.when(F.col("__t") == 0, F.col("__key"))).alias("__c"),
                                     F.max("__t").alias("__has_t"))
    if slices is None:
        slices = max(1, base.count() // slice_rows)
    points = score_slices(points, "__s", slices)
    control = F.when(F.col("__c").isNotNull(), F.struct(F.col("__s").alias("s"), F.col("__c").alias("k")))
    points = points.withColumn("__ctl", control)
    inside = Window.partitionBy("__slice").orderBy("__s")
    # a growing frame over the reversed order: frames that end in unboundedFollowing are quadratic
    upward = Window.partitionBy("__slice").orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0)
    edges = points.groupBy("__slice").agg(F.max("__ctl").alias("__last"), F.min("__ctl").alias("__first"))
    lower = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    higher = Window.orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        "__slice",
        F.last("__last", ignorenulls=True).over(lower).alias("__low_in"),
        F.last("__first", ignorenulls=True).over(higher).alias("__high_in"))
    near = (points
            .withColumn("__low", F.last("__ctl", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("__high", F.last("__ctl", ignorenulls=True).over(upward))
            .filter(F.col("__has_t") == 1)
            .join(edges, "__slice", "left")
            .withColumn("__low", F.coalesce("__low", "__low_in"))
            .withColumn("__high", F.coalesce("__high", "__high_in")))
    gap_low, gap_high = F.col("__s") - F.col("__low.s"), F.col("__high.s") - F.col("__s")
    take_low = F.col("__high").isNull() | (F.col("__low").isNotNull() & (
        (gap_low < gap_high) | ((gap_low == gap_high) & (F.col("__low.k") <= F.col("__high.k")))))
    best = (near.filter(F.col("__low").isNotNull() | F.col("__high").isNotNull())
            .select("__s", F.when(take_low, F.col("__low")).otherwise(F.col("__high")).alias("__best"))
            .select("__s", F.col("__best.k").alias("control_key"), F.col("__best.s").alias("control_score"),
                    F.abs(F.col("__s") - F.col("__best.s")).alias("distance")))
    return (base.filter(F.col("__t") == 1).join(best, "__s")
            .select(F.col("__key").alias("treated_key"), F.col("__s").alias("treated_score"),
                    "control_key", "control_score", "distance"))


def caliper(matches: DataFrame, width: float) -> DataFrame:
    return matches.filter(F.col("distance") <= F.lit(width))
