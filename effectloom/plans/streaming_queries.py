"""Streaming queries drained with availableNow, plus their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordered import sessionize
from ..sources.workspace import new_path
from ..streaming import events as st
from ..streaming import keyed
from ..streaming.upsert import UpsertTable, upsert_sink
from .inputs import r, table
from .registry import query

# Append mode emits a window once the watermark (latest event - 1 day) passes its end.
_CLOSED = "(SELECT max(ts)-INTERVAL 1 DAY FROM events)"


def drain(df, mode="append"):
    spark = df.sparkSession
    return st.run_to_table(df, new_path(spark, "out"), new_path(spark, "ckpt"), mode)


def stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("I1_dedup_by_event_id", "SELECT event_id, user_id, event_type FROM events")
def dedup_by_event_id(spark, sf):
    raw = st.read_events(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return drain(st.dedup_events(raw, "event_id", "ts").select("event_id", "user_id", "event_type"))


@query("I2_daily_counts", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day',ts)+INTERVAL 1 DAY<={_CLOSED} GROUP BY 1,2")
def daily_counts(spark, sf):
    return drain(st.daily_counts(st.read_events(spark, sf), "ts", "event_type")).select(F.date_format("day_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("I3_sliding_activity", f"""SELECT CAST(CAST(w AS DATE) AS VARCHAR) AS day, user_id, count(*) AS n FROM (SELECT user_id, date_trunc('day',ts)+to_days(CAST(k AS INTEGER)) AS w FROM events, range(1,31) t(k))
 WHERE w<={_CLOSED} GROUP BY 1,2""")
def sliding_activity(spark, sf):
    return drain(st.sliding_activity(st.read_events(spark, sf), "ts", "user_id", length="30 days")).select(F.date_format("window_end", "yyyy-MM-dd").alias("day"), "user_id", "n")


_SESS = """s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts-p>=INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid
 FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)),
 g AS (SELECT user_id, min(ts) AS a, max(ts) AS z, count(*) AS n_events FROM s GROUP BY user_id, sid)"""


@query("I4_sessions", f"WITH {_SESS} SELECT user_id, strftime(a,'%Y-%m-%d %H:%M:%S.%f') AS session_start, n_events FROM g WHERE z+INTERVAL 30 MINUTE<={_CLOSED}")
def sessions(spark, sf):
    return drain(st.sessions(st.read_events(spark, sf), "ts", "user_id")).select("user_id", stamp("session_start").alias("session_start"), "n_events")


@query("I4_sessions_batch", f"WITH {_SESS} SELECT user_id, strftime(a,'%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(z,'%Y-%m-%d %H:%M:%S.%f') AS last_event, n_events FROM g")
def sessions_batch(spark, sf):
    return sessionize(table(spark, sf, "events"), "user_id", "ts", "event_id", 1800).select(
        "user_id", stamp("session_start").alias("session_start"), stamp("last_event").alias("last_event"), "n_events")


def policy_moves(spark, sf):
    """Event stream per policy: activation, then a path chosen by the key."""
    k = F.col("o_orderkey") % 4
    def at(name, days): return F.struct(F.lit(name).alias("event"), F.lit(days).alias("after"))
    path = (F.when(k == 0, F.array(at("activate", 0), at("renew", 365))).when(k == 1, F.array(at("activate", 0), at("miss_payment", 100), at("pay", 130)))
            .when(k == 2, F.array(at("activate", 0), at("miss_payment", 100))).otherwise(F.array(at("activate", 0), at("reinstate", 50), at("surrender", 80))))
    o = st.read_events(spark, sf, "o_orderdate", "orders.parquet")
    m = o.select(F.col("o_orderkey").alias("policy_id"), "o_orderdate", F.posexplode(path).alias("pos", "m"))
    return m.select("policy_id", (F.col("policy_id") * 10 + F.col("pos")).alias("event_id"), F.col("m.event").alias("event"),
                    (F.col("o_orderdate") + F.make_dt_interval(F.col("m.after"))).alias("ts"))


_LATEST = "(SELECT max(o_orderdate+to_days(CASE o_orderkey%4 WHEN 0 THEN 365 WHEN 1 THEN 130 WHEN 2 THEN 100 ELSE 80 END)) FROM orders)"


@query("I5_policy_states", f"""SELECT policy_id, state, event FROM (
 SELECT o_orderkey AS policy_id, 'active' AS state, 'activate' AS event FROM orders
 UNION ALL SELECT o_orderkey, 'active', 'renew' FROM orders WHERE o_orderkey%4=0
 UNION ALL SELECT o_orderkey, 'grace', 'miss_payment' FROM orders WHERE o_orderkey%4 IN (1,2)
 UNION ALL SELECT o_orderkey, 'active', 'pay' FROM orders WHERE o_orderkey%4=1
 UNION ALL SELECT o_orderkey, 'lapsed', 'grace_expired' FROM orders WHERE o_orderkey%4=2 AND o_orderdate+INTERVAL 160 DAY<{_LATEST}-INTERVAL 1 DAY
 UNION ALL SELECT o_orderkey, 'active', 'rejected:reinstate' FROM orders WHERE o_orderkey%4=3
 UNION ALL SELECT o_orderkey, 'terminated', 'surrender' FROM orders WHERE o_orderkey%4=3)""")
def policy_states(spark, sf):
    return drain(keyed.policy_state_stream(policy_moves(spark, sf), "ts")).select("policy_id", "state", "event")


@query("I6_churn_stream", """WITH e AS (SELECT o_custkey AS user_id, o_orderkey AS policy_id, o_orderdate+INTERVAL 365 DAY AS x FROM orders)
SELECT user_id, policy_id FROM e WHERE x+INTERVAL 30 DAY<(SELECT max(o_orderdate)-INTERVAL 1 DAY FROM orders)
 AND NOT EXISTS (SELECT 1 FROM orders r WHERE r.o_custkey=e.user_id AND r.o_orderdate>x AND r.o_orderdate<=x+INTERVAL 30 DAY)""")
def churn_stream(spark, sf):
    def o(): return st.read_events(spark, sf, "o_orderdate", "orders.parquet")
    exp = o().select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("policy_id"), (F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")).alias("expiry_ts"))
    ren = o().select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("renewal_ts"))
    return drain(st.churn_stream(exp, ren)).select("user_id", "policy_id")


@query("I7_contact_cap", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def contact_cap(spark, sf):
    return drain(keyed.contact_cap(st.read_events(spark, sf), "ts", 30)).select("user_id", "event_id")


@query("I8_enrich", "SELECT event_id, round(coalesce(m,1.0)*value,4) AS adjusted FROM events LEFT JOIN (SELECT event_type, CAST(max(user_id)%5 AS DOUBLE)/10+1 AS m FROM events WHERE event_type<>'error' GROUP BY 1) USING (event_type)")
def enrich(spark, sf):
    params = table(spark, sf, "events").filter("event_type <> 'error'").groupBy("event_type").agg(((F.max("user_id") % 5).cast("double") / 10 + 1).alias("m"))
    out = st.enrich(st.read_events(spark, sf), params, "event_type", {"m": 1.0})
    return drain(out.select("event_id", F.round(F.col("m") * F.col("value"), 4).alias("adjusted")))


@query("I9_late_rows_dropped", """SELECT 'kept' AS measure, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 2
 UNION ALL SELECT 'dropped', NULL, count(*) FILTER (ts < TIMESTAMP '2024-01-10') FROM events""")
def late_rows_dropped(spark, sf):
    """Two runs on one checkpoint; the second brings rows older than the watermark, which the operator's own metric counts."""
    src, out, ckpt = (new_path(spark, x) for x in ("late-src", "late-out", "late-ckpt"))
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id")
    e.write.parquet(src)

    def stream():
        return st.dedup_events(spark.readStream.schema(e.schema).parquet(src), "event_id", "ts", "1 day")
    st.run_to_table(stream(), out, ckpt)
    early = e.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp")).withColumn("event_id", F.col("event_id") + 10_000_000_000)
    early.write.mode("append").parquet(src)
    got, metrics = st.run_measured(stream(), out, ckpt)
    kept = got.groupBy(F.lit("kept").alias("measure"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return kept.unionByName(metrics.select(F.lit("dropped").alias("measure"), F.lit(None).cast("string").alias("day"), "rows_late")
                            .groupBy("measure", "day").agg(F.coalesce(F.sum("rows_late"), F.lit(0)).alias("n")))


@query("I10_upsert_sink", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id),4) AS value FROM events GROUP BY 1")
def upsert(spark, sf):
    """Three batches: all events up to a day, those after it, and all of them again."""
    path, src, ckpt = (new_path(spark, x) for x in ("profiles", "upsert-src", "ckpt"))
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_id", "event_type", "value", "ts")
    mid = F.lit("2024-01-20").cast("timestamp")
    for part in (e.filter(F.col("ts") < mid), e.filter((F.col("ts") >= mid) | F.col("ts").isNull()), e):
        part.write.mode("append").parquet(src)
        s = spark.readStream.schema(e.schema).parquet(src).select("user_id", "event_id", "event_type", "value")
        upsert_sink(s, path, ckpt, "user_id", "event_id", "append", 16).awaitTermination()
    return UpsertTable(spark, path, "user_id", "event_id").read().select("user_id", "event_id", "event_type", r("value").alias("value"))
