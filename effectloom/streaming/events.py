"""Structured Streaming operators over an event table.

Event time must be TIMESTAMP; tables that carry TIMESTAMP_NTZ are cast by
``read_events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, ts: str = "ts", name: str = "events.parquet",
                max_files: int = 100) -> DataFrame:
    """File stream of one table in a folder, event time cast to TIMESTAMP."""
    schema = spark.read.parquet(f"{path}/{name}").schema
    raw = (spark.readStream.schema(schema).option("pathGlobFilter", name)
           .option("maxFilesPerTrigger", max_files).parquet(path))
    return raw.withColumn(ts, F.col(ts).cast("timestamp"))


def with_lateness(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay)


def dedup_events(stream: DataFrame, event_id: str, ts: str, delay: str = "1 day") -> DataFrame:
    """Idempotent by event id; state is dropped once the watermark passes."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([event_id])


def daily_counts(stream: DataFrame, ts: str, level: str, delay: str = "1 day") -> DataFrame:
    w = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    return (w.groupBy(F.window(ts, "1 day"), level).agg(F.count("*").alias("n"))
            .select(F.col("window.start").alias("day_start"), level, "n"))


def sliding_activity(stream: DataFrame, ts: str, key: str, delay: str = "1 day", length: str = "30 days", step: str = "1 day") -> DataFrame:
    """Events per key in windows of ``length`` that start every ``step``; ``length`` is a multiple of ``step``.

    Rows are counted per step first, so a count, not every event, enters all the
    windows over it.
    """
    w = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    steps = w.groupBy(F.window(ts, step), key).agg(F.count("*").alias("n_step")).select(F.window_time("window").alias("__at"), key, "n_step")
    return (steps.groupBy(F.window("__at", length, step), key).agg(F.sum("n_step").alias("n"))
            .select(F.col("window.end").alias("window_end"), key, "n"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    w = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    return (w.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n_events"))
            .select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events"))


def enrich(stream: DataFrame, params: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Stream-static left join; the static side is reread per batch by Spark."""
    return stream.join(params, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def churn_stream(expiries: DataFrame, renewals: DataFrame, days: int = 30, delay: str = "1 day") -> DataFrame:
    """Expiries without a renewal in (expiry, expiry + days]: stream-stream left outer interval join."""
    e = expiries.select(F.col("user_id").alias("e_user"), F.col("policy_id"), F.col("expiry_ts")).withWatermark("expiry_ts", delay)
    r = renewals.select(F.col("user_id").alias("r_user"), F.col("renewal_ts")).withWatermark("renewal_ts", delay)
    cond = ((F.col("e_user") == F.col("r_user")) & (F.col("renewal_ts") > F.col("expiry_ts"))
            & (F.col("renewal_ts") <= F.col("expiry_ts") + F.expr(f"INTERVAL {days} DAYS")))
    return e.join(r, cond, "leftOuter").filter(F.col("r_user").isNull()).select(F.col("e_user").alias("user_id"), "policy_id", "expiry_ts")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain the available input into Parquet (append) and read it back."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_measured(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> tuple[DataFrame, DataFrame]:
    """As run_to_table, with what each stateful operator did in each trigger:
    (batch_id, operator, rows_updated, state_rows, rows_late), late rows being those the watermark dropped."""
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    seen: dict[tuple[int, int], tuple] = {}
    ended = False
    while not ended:  # read while it runs: a query remembers only its last triggers
        ended = q.awaitTermination(1)
        for p in q.recentProgress:
            for at, op in enumerate(p.stateOperators):
                seen[p.batchId, at] = (p.batchId, op.operatorName, op.numRowsUpdated, op.numRowsTotal, op.numRowsDroppedByWatermark)
    spark = stream.sparkSession
    metrics = spark.createDataFrame(list(seen.values()), "batch_id long, operator string, rows_updated long, state_rows long, rows_late long")
    return spark.read.schema(stream.schema).parquet(path), metrics
