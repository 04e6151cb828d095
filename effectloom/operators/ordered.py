"""Ordered per-key operators that do not put a hot key into one task.

A window over ``partitionBy(key)`` sorts each key in a single task.  Here the rows
of keys with more than ``slice_rows`` rows are range-partitioned by key and full
sort order and cut into slices, so equal times spread over slices as well; windows run inside
(key, slice) and a small table of slice summaries carries the boundary value into
the next slice.  A count decides first; without hot keys the operator is one plain
window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import materialize

SLICE_ROWS = 2_000_000


AUTO = object()


def hot_keys(df: DataFrame, keys: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame | None:
    """Keys above the limit with their row count, or None when there are none.

    One map-side-combined count decides: without hot keys the operators below
    stay single plain windows.  At most rows/slice_rows keys are listed.
    """
    hot = materialize(df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > slice_rows))
    return None if hot.isEmpty() else hot


def with_slices(df: DataFrame, keys: list[str], order: list[str], hot: DataFrame, slice_rows: int) -> DataFrame:
    """Add ``__slice``: 0 for ordinary keys, runs of ``slice_rows`` rows of the full order (key, order) for hot ones.

    Tasks and slices are counted apart: rows are sorted in ranges, no more of them than
    the shuffle has partitions or `SLICE_ROWS` rows each ask for, and each range is cut
    by row number, so short slices cost no tasks.  The ranges come from a sample of the
    rows and are written down: a later read of the same plan would be free to draw other ones.
    """
    rows = hot.agg(F.sum("__n")).first()[0]
    marked = df.join(hot.select(*keys, F.lit(True).alias("__hot")), keys, "left")
    ranges = min(math.ceil(rows / slice_rows) + 1, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / SLICE_ROWS) + 1))
    row = F.monotonically_increasing_id()  # the range's number above its row numbers, which have 33 bits
    sliced = materialize(marked.filter("__hot").repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("__row", row)
                         .withColumn("__slice", F.col("__row") - F.pmod(F.col("__row"), F.lit(1 << 33)) + F.floor(F.pmod(F.col("__row"), F.lit(1 << 33)) / slice_rows))
                         .drop("__row"))
    return marked.filter("__hot IS NULL").withColumn("__slice", F.lit(0).cast("long")).unionByName(sliced).drop("__hot")


def seconds(col: str | Column) -> Column:
    """Timestamp or date as a number that orders the same way."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp")).cast("double") / 1e6


def carry(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column],
          direction: str = "back", include_current: bool = False, slice_rows: int = SLICE_ROWS, hot=AUTO) -> DataFrame:
    """Nearest earlier (back) or later (ahead) non-null value per key.

    ``order`` is the full sort.  Each entry of ``values`` is an expression that is null on rows that
    must not be picked; its picked value lands in the named column.
    """
    if hot is AUTO:
        hot = hot_keys(df, keys, slice_rows)
    picked = {f"__v{i}": e for i, e in enumerate(values.values())}
    # Looking ahead is looking back over the reversed order: a frame that starts at
    # the first row grows by one row at a time, one that ends at the last row is
    # re-evaluated for every row.
    back = direction == "back"
    sort = [F.col(c).asc() if back else F.col(c).desc() for c in order]
    cell = keys if hot is None else [*keys, "__slice"]
    frame = Window.partitionBy(*cell).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    if hot is None:
        return (df.withColumns(picked).withColumns({name: F.last(f"__v{i}", ignorenulls=True).over(frame) for i, name in enumerate(values)})
                .drop(*picked))
    work = with_slices(df.withColumns(picked), keys, order, hot, slice_rows)
    step = F.col("__slice").asc() if back else F.col("__slice").desc()
    across = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    edge = F.max_by if back else F.min_by
    place = F.struct(*[F.col(c) for c in order])
    summary = work.groupBy(*keys, "__slice").agg(*[
        edge(F.col(v), F.when(F.col(v).isNotNull(), place)).alias(f"__e{i}") for i, v in enumerate(picked)])
    summary = summary.select(*keys, "__slice", *[
        F.last(f"__e{i}", ignorenulls=True).over(across).alias(f"__c{i}") for i in range(len(picked))])
    local = work.withColumns({f"__l{i}": F.last(v, ignorenulls=True).over(frame) for i, v in enumerate(picked)})
    joined = local.join(summary, [*keys, "__slice"], "left")
    out = joined.withColumns({name: F.coalesce(f"__l{i}", f"__c{i}") for i, name in enumerate(values)})
    return out.drop("__slice", *picked, *[f"__l{i}" for i in range(len(picked))], *[f"__c{i}" for i in range(len(picked))])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
                slice_rows: int = SLICE_ROWS, hot=AUTO) -> DataFrame:
    """Cumulative sum per key in order, slice totals carried forward."""
    if hot is AUTO:
        hot = hot_keys(df, keys, slice_rows)
    cell = keys if hot is None else [*keys, "__slice"]
    so_far = Window.partitionBy(*cell).orderBy(*[F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    if hot is None:
        return df.withColumn(out, F.sum(value).over(so_far))
    work = with_slices(df.withColumn("__v", value), keys, order, hot, slice_rows)
    across = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = (work.groupBy(*keys, "__slice").agg(F.sum("__v").alias("__t"))
              .select(*keys, "__slice", F.coalesce(F.sum("__t").over(across), F.lit(0)).alias("__before")))
    return (work.withColumn("__local", F.sum("__v").over(so_far)).join(totals, [*keys, "__slice"], "left")
            .withColumn(out, F.col("__local") + F.col("__before")).drop("__v", "__local", "__before", "__slice"))


def keep_latest(df: DataFrame, key: str, order: list[str], k: int = 4) -> DataFrame:
    """Last k rows per key; Spark prunes to k rows per task before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def version_diff(df: DataFrame, key: str, version: str, fields: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(key, version, field, old, new) for fields that changed since the previous snapshot."""
    snap = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
    prev = carry(df.withColumn("__pos", F.col(version).cast("double")), [key], ["__pos"],
                 {"__prev": snap}, slice_rows=slice_rows)
    changes = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"__prev.{f}").alias("old_value"),
                 F.col(f).cast("string").alias("new_value")) for f in fields]))
    return (prev.filter(F.col("__prev").isNotNull()).select(key, version, changes.alias("c")).select(key, version, "c.*")
            .filter(~F.col("old_value").eqNullSafe(F.col("new_value"))))


def trailing_count(events: DataFrame, key: str, ts: str, days: list[int]) -> DataFrame:
    """Per key and active day: events in the trailing windows of that day.

    Counts are collapsed to (key, day) first, so a window holds days, not events.
    """
    daily = events.groupBy(key, F.to_date(ts).alias("day")).agg(F.count("*").alias("n_day"))
    d = daily.withColumn("__d", F.unix_date("day"))
    w = Window.partitionBy(key).orderBy("__d")
    return d.withColumns({f"n_{k}d": F.sum("n_day").over(w.rangeBetween(-(k - 1), 0)) for k in days}).drop("__d")


def recency(events: DataFrame, key: str, ts: str, asof: str) -> DataFrame:
    """Days since the last event and the 7/30/90-day activity tier."""
    days = F.datediff(F.lit(asof).cast("date"), F.to_date(F.max(ts)))
    return (events.groupBy(key).agg(F.max(ts).alias("last_ts"), days.alias("days_since"))
            .withColumn("activity_tier", activity_tier(F.col("days_since"))))


def activity_tier(days: Column) -> Column:
    return (F.when(days <= 7, "active").when(days <= 30, "regular").when(days <= 90, "infrequent").otherwise("dormant"))


def transitions(states: DataFrame, key: str, ts: str, state: str, tiebreak: str, allowed: list[tuple[str, str]],
                slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Previous state per row and whether the step is an allowed one."""
    prev = carry(states.withColumn("__pos", seconds(ts)), [key], ["__pos", tiebreak],
                 {"prev_state": F.col(state)}, slice_rows=slice_rows).drop("__pos")
    pairs = states.sparkSession.createDataFrame(allowed, "prev_state string, `__to` string").withColumn("legal", F.lit(True))
    return (prev.withColumn("__to", F.col(state)).join(F.broadcast(pairs), ["prev_state", "__to"], "left")
            .withColumn("legal", F.col("prev_state").isNull() | F.coalesce("legal", F.lit(False))).drop("__to"))


def argmax_by(scores: DataFrame, key: str | list[str], name: str, score: str) -> DataFrame:
    """Name with the highest score per key; ties go to the smallest name."""
    keys = [key] if isinstance(key, str) else key
    return scores.groupBy(*keys).agg(
        F.min_by(name, F.struct((-F.col(score)).alias("s"), F.col(name).alias("n"))).alias(name), F.max(score).alias(score))


def priority_order(df: DataFrame, key: str, tier: str, rank: str) -> DataFrame:
    """Recommendation order within a key by tier, then rank (few rows per key)."""
    return df.withColumn("priority", F.row_number().over(Window.partitionBy(key).orderBy(tier, rank)))


def top_k(df: DataFrame, by: str, k: int, tiebreak: str) -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(tiebreak).asc()).limit(k)


def head_by(df: DataFrame, ts: str, n: int, tiebreak: str) -> DataFrame:
    return df.orderBy(F.col(ts).asc(), F.col(tiebreak).asc()).limit(n)


def turn_trend(conv: DataFrame, key: str, turn: str, value: str) -> DataFrame:
    """First, last, change and slope of a value across ordered turns."""
    return (conv.groupBy(key).agg(
        F.count("*").alias("n_turns"), F.min_by(value, turn).alias("first_value"),
        F.max_by(value, turn).alias("last_value"),
        F.regr_slope(F.col(value).cast("double"), F.col(turn).cast("double")).alias("slope"))
        .withColumn("change", F.col("last_value") - F.col("first_value")))


def median_period(df: DataFrame, time: str):
    """Element len//2 of the sorted distinct periods."""
    from ..functions.quantiles import order_statistics
    periods = df.select(time).where(F.col(time).isNotNull()).distinct()
    n = periods.count()
    as_number = periods.select(seconds(time).alias("p")) if not _numeric(df, time) else periods.select(
        F.col(time).cast("double").alias("p"))
    return order_statistics(as_number, "p", [n // 2])[0]


def _numeric(df: DataFrame, col: str) -> bool:
    from .typing import NUMERIC
    return isinstance(df.schema[col].dataType, NUMERIC)


def sessionize(events: DataFrame, key: str, ts: str, tiebreak: str, gap_seconds: int,
               slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Sessions per key: start, end, events; a gap of ``gap_seconds`` or more starts a new one."""
    work = events.select(key, ts, tiebreak).withColumn("__pos", seconds(ts))
    hot = hot_keys(work, [key], slice_rows)
    prev = carry(work, [key], ["__pos", tiebreak], {"__prev": F.col("__pos")}, slice_rows=slice_rows, hot=hot)
    new = F.when(F.col("__prev").isNull() | (F.col("__pos") - F.col("__prev") >= gap_seconds), 1).otherwise(0)
    numbered = running_sum(prev, [key], ["__pos", tiebreak], new, "session", slice_rows, hot)
    return numbered.groupBy(key, "session").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("last_event"), F.count("*").alias("n_events"))
