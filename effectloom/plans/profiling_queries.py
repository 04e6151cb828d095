"""Profiling, aggregation, join and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..operators import joins as jn
from ..operators import ordered as od
from ..operators import profiling as pf
from ..operators import typing as ty
from ..sources.assemble import shared_columns
from .cleaning_queries import _TYPED, DIRTY, dirty
from .inputs import ASOF, CUSTOMERS, EVENTS_ASOF, POLICIES, PRODUCTS, customers, policies, r, table
from .registry import query


def _stat_sql(t, c):
    return (f"SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS n_unique, round(avg({c}),4) AS mean, round(stddev_samp({c}),4) AS std, "
            f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont({c},0.5),4) AS median FROM {t}")


@query("D1_column_statistics", " UNION ALL ".join(_stat_sql("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def column_statistics(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return ty.column_meta(df).select("column", (F.col("n") - F.col("n_missing")).alias("n"), "n_unique", r("mean").alias("mean"), r("std").alias("std"),
                                     "min", "max", r("median").alias("median"))


@query("D2_dataset_statistics", f"""WITH {_TYPED} SELECT max(n) AS sample_size, count(*) AS feature_count, count(*) FILTER (semantic_type='continuous') AS n_continuous,
 count(*) FILTER (semantic_type='binary') AS n_binary, count(*) FILTER (semantic_type='categorical') AS n_categorical,
 'time_series' AS data_type, true AS is_panel, true AS has_binary_treatment FROM meta""")
def dataset_statistics(spark, sf):
    df = dirty(spark, sf)
    return pf.dataset_stats(df, ty.column_meta(df, with_median=False), "flag", time="day_text").select(
        "sample_size", "feature_count", "n_continuous", "n_binary", "n_categorical", "data_type", "is_panel", "has_binary_treatment")


@query("D3_shape_label", """SELECT 'orders' AS t, 'panel' AS data_type WHERE (SELECT count(DISTINCT o_orderpriority)>0 FROM orders)
 UNION ALL SELECT 'events', 'time_series' WHERE (SELECT count(*)>0 FROM events) UNION ALL SELECT 'customer','cross_section' WHERE (SELECT count(*)>0 FROM customer)""")
def shape_label(spark, sf):
    frames = {"orders": table(spark, sf, "orders").select("o_orderdate", "o_totalprice", (F.col("o_custkey") % 15).alias("agent")),
              "events": table(spark, sf, "events").select("ts", "value", "event_type"),
              "customer": table(spark, sf, "customer").select("c_acctbal", "c_mktsegment")}
    out = None
    for name, df in frames.items():
        one = pf.shape_label(ty.column_meta(df, with_median=False)).select(F.lit(name).alias("t"), "data_type")
        out = one if out is None else out.union(one)
    return out


@query("D4_panel_balance", """WITH p AS (SELECT user_id, CAST(ts AS DATE) d, count(*) n FROM events GROUP BY 1,2), e AS (SELECT user_id, count(*) t, sum(n) n FROM p GROUP BY 1)
SELECT count(*) AS n_entities, CAST(sum(n) AS BIGINT) AS n_rows, min(t) AS min_periods, max(t) AS max_periods, (SELECT count(DISTINCT d) FROM p) AS n_periods,
 min(t)=max(t) AND min(t)=(SELECT count(DISTINCT d) FROM p) AS balanced FROM e""")
def panel_balance(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("date"))
    entity, time = pf.panel_columns(e)
    return pf.panel_balance(e, entity, time)


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("D5_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),6) AS r FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1:]))
def correlations(spark, sf):
    return pf.correlations(table(spark, sf, "lineitem"), _NUM).withColumn("r", r("r", 6))


@query("D6_missing_matrix", f"WITH {DIRTY} " + " UNION ALL ".join(
    f"SELECT CAST(id%10 AS INTEGER) AS bucket, '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END),6) AS missing_rate FROM dirty GROUP BY 1"
    for c in ("balance", "segment", "nation", "sparse")))
def missing_matrix(spark, sf):
    return pf.missing_by_bucket(dirty(spark, sf), (F.col("id") % 10).cast("int"), ["balance", "segment", "nation", "sparse"]).withColumn(
        "missing_rate", r("missing_rate", 6))


@query("D7_histogram", """WITH b AS (SELECT min(value) lo, (max(value)-min(value))/30 w FROM events)
SELECT event_type, CAST(least(floor((value-lo)/w),29) AS INTEGER) AS bin, count(*) AS n FROM events, b GROUP BY 1,2""")
def histogram(spark, sf):
    return pf.histogram(table(spark, sf, "events"), "value", 30, "event_type").select("event_type", "bin", "n")


@query("D8_key_rollup", """SELECT c_custkey, coalesce(n,0) AS n_orders, round(coalesce(t,0.0),2) AS total FROM customer LEFT JOIN
 (SELECT o_custkey, count(*) n, sum(o_totalprice) t FROM orders WHERE o_orderstatus='F' GROUP BY 1) ON c_custkey=o_custkey""")
def key_rollup(spark, sf):
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    return pf.with_rollup(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", "o_custkey",
                          {"n_orders": F.count("*"), "total": F.sum("o_totalprice")}).withColumn("total", r("total", 2))


@query("D9_value_tiers", f"""WITH {CUSTOMERS}, p AS (SELECT o_custkey, sum(o_totalprice)*0.02 prem FROM orders GROUP BY 1),
s AS (SELECT user_id, ln(greatest(coalesce(prem,0.0),1.0))*0.5+ln(greatest(income,1.0))*0.5 v FROM customers LEFT JOIN p ON user_id=o_custkey),
q AS (SELECT quantile_cont(v,0.8) p80, quantile_cont(v,0.5) p50, quantile_cont(v,0.2) p20 FROM s)
SELECT CASE WHEN v>=p80 THEN 'high_net_worth' WHEN v>=p50 THEN 'core' WHEN v>=p20 THEN 'mass' ELSE 'low' END AS value_tier, count(*) AS n, round(sum(v),4) AS score FROM s, q GROUP BY 1""")
def value_tiers(spark, sf):
    prem = pf.with_rollup(customers(spark, sf), table(spark, sf, "orders"), "user_id", "o_custkey", {"premium": F.sum("o_totalprice") * 0.02})
    return pf.value_tiers(prem, "premium", "income").groupBy("value_tier").agg(F.count("*").alias("n"), F.round(F.sum("value_score"), 4).alias("score"))


@query("D10_share_table", "SELECT lang, source, count(*) AS n, round(count(*)/(SELECT count(*) FROM documents),6) AS share FROM documents GROUP BY 1,2")
def share_table(spark, sf):
    return pf.share_table(table(spark, sf, "documents"), "lang", "source").withColumn("share", r("share", 6))


@query("D11_count_histogram", "SELECT n AS rows_per_key, count(*) AS n_keys FROM (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) GROUP BY 1")
def count_histogram(spark, sf):
    return pf.count_histogram(table(spark, sf, "orders"), "o_custkey")


@query("D12_status_map_top_k", """WITH c AS (SELECT user_id, event_type, count(*) n FROM events GROUP BY 1,2), m AS (SELECT user_id, string_agg(event_type||'='||n, ',' ORDER BY event_type) AS counts FROM c GROUP BY 1),
t AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) rk FROM c)
SELECT user_id, counts, string_agg(event_type, ',' ORDER BY rk) AS top3 FROM m JOIN t USING (user_id) WHERE rk<=3 GROUP BY 1,2""")
def status_map_top_k(spark, sf):
    e = table(spark, sf, "events")
    m = pf.count_map(e, "user_id", "event_type", "counts").select("user_id", F.array_join(F.transform(
        F.array_sort(F.map_entries("counts")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("counts"))
    top = pf.top_k_values(e, "user_id", "event_type", 3).groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_type"))), lambda x: x["event_type"]), ",").alias("top3"))
    return m.join(top, "user_id")


@query("D13_coverage_matrix", f"WITH {POLICIES} SELECT user_id, " + ", ".join(
    f"round(coalesce(sum(sum_insured) FILTER (product='{p}'),0),2) AS {p}_sum, count(*) FILTER (product='{p}') AS {p}_count, "
    f"count(*) FILTER (product='{p}' AND effective_date<=DATE '{ASOF}' AND expiry_date>=DATE '{ASOF}') AS {p}_active, count(*) FILTER (product='{p}')>0 AS {p}_has"
    for p in PRODUCTS) + " FROM policies GROUP BY 1")
def coverage_matrix(spark, sf):
    day = F.lit(ASOF).cast("date")
    m = pf.coverage_matrix(policies(spark, sf), "user_id", "product", "sum_insured",
                           (F.col("effective_date") <= day) & (F.col("expiry_date") >= day), PRODUCTS)
    return m.withColumns({f"{p}_sum": r(f"{p}_sum", 2) for p in PRODUCTS})


@query("D14_level_totals", f"""WITH {POLICIES} SELECT coalesce(user_id,-1) AS user_id, coalesce(person,'all') AS person, CAST(GROUPING(user_id)*2+GROUPING(person) AS INTEGER) AS level, count(*) AS n,
 round(sum(premium),4) AS premium FROM policies GROUP BY ROLLUP(user_id, person)""")
def level_totals(spark, sf):
    return pf.level_totals(policies(spark, sf), ["user_id", "person"], {"n": F.count("*"), "premium": F.round(F.sum("premium"), 4)}).select(
        F.coalesce("user_id", F.lit(-1)).alias("user_id"), F.coalesce("person", F.lit("all")).alias("person"), "level", "n", "premium")


@query("D15_effectiveness", "SELECT l_linestatus||l_returnflag AS strategy, count(*) AS n, round(avg(CASE WHEN l_discount>=0.05 THEN 1.0 ELSE 0.0 END),6) AS rate, "
       "round(avg(CASE WHEN l_discount>=0.05 THEN l_quantity END),6) AS avg_days FROM lineitem GROUP BY 1")
def effectiveness(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("strategy", F.concat("l_linestatus", "l_returnflag"))
    return pf.effectiveness(li, "strategy", F.col("l_discount") >= 0.05, F.col("l_quantity")).withColumns({"rate": r("rate", 6), "avg_days": r("avg_days", 6)})


@query("D16_conversation_metrics", """SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role='user') AS user_turns, count(*) FILTER (role='assistant') AS assistant_turns,
 arg_min(role,turn) AS first_sender, arg_max(role,turn) AS last_sender, max(turn)-min(turn) AS span, round(avg(length(text)),4) AS mean_length,
 arg_max(role,turn)='assistant' AS resolved FROM conversations GROUP BY 1""")
def conversation_metrics(spark, sf):
    return pf.conversation_metrics(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text").select(
        "conv_id", "n_turns", "user_turns", "assistant_turns", "first_sender", "last_sender", "span", r("mean_length").alias("mean_length"), "resolved")


@query("D17_nps", "SELECT event_type, count(*) AS n, count(*) FILTER (s>=9) AS promoters, count(*) FILTER (s<=6) AS detractors, "
       "round((count(*) FILTER (s>=9)-count(*) FILTER (s<=6))*100.0/count(*),6) AS nps FROM (SELECT event_type, CAST(props->>'k' AS INTEGER)%11 AS s FROM events) GROUP BY 1")
def nps(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.get_json_object("props", "$.k").cast("int") % 11).alias("score"))
    return pf.nps(e, "score", "event_type").withColumn("nps", r("nps", 6))


@query("D18_diagnosis_confidence", """SELECT v AS version, count(*) AS n, round(avg(c),6) AS mean_confidence, round(avg((c>=0.7)::INT),6) AS pass_rate, round(avg((c<0.7)::INT),6) AS manual_rate
 FROM (SELECT user_id%4 AS v, (a+b+d+e)/4 AS c FROM (SELECT user_id, (event_id%100)/100 a, (event_id*3%100)/100 b, (event_id*7%50+50)/100 d, (event_id%20+80)/100 e FROM events)) GROUP BY 1""")
def diagnosis_confidence(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").select((F.col("user_id") % 4).alias("version"), (k % 100 / 100).alias("a"), (k * 3 % 100 / 100).alias("b"),
                                          ((k * 7 % 50 + 50) / 100).alias("d"), ((k % 20 + 80) / 100).alias("e"))
    out = pf.diagnosis_confidence(e, ["a", "b", "d", "e"], "version")
    return out.withColumns({c: r(c, 6) for c in ("mean_confidence", "pass_rate", "manual_rate")})


@query("E1_full_outer", """WITH c AS (SELECT c_nationkey AS nationID, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS nationID, count(*) AS n FROM supplier GROUP BY 1),
 k AS (SELECT n_nationkey AS nationID, n_name FROM nation WHERE n_nationkey<20)
SELECT coalesce(c.nationID,s.nationID,k.nationID) AS nationID, coalesce(c.n,0) AS n, coalesce(s.n,0) AS n_1, coalesce(k.n_name,'-') AS n_name
 FROM c FULL JOIN s ON c.nationID=s.nationID FULL JOIN k ON coalesce(c.nationID,s.nationID)=k.nationID""")
def full_outer(spark, sf):
    from ..sources.assemble import merge_tables
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nationID")).agg(F.count("*").alias("n"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nationID")).agg(F.count("*").alias("n"))
    k = table(spark, sf, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("nationID"), "n_name")
    return merge_tables([c, s, k], ["nationID"]).na.fill(0, ["n", "n_1"]).na.fill("-", ["n_name"])


@query("E2_left_zero_fill", """SELECT p_partkey, coalesce(n,0) AS n_lines, round(coalesce(q,0),2) AS qty FROM part LEFT JOIN
 (SELECT l_partkey, count(*) n, sum(l_quantity) q FROM lineitem WHERE l_returnflag='R' AND l_quantity>45 GROUP BY 1) ON p_partkey=l_partkey""")
def left_zero_fill(spark, sf):
    li = table(spark, sf, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
    return pf.with_rollup(table(spark, sf, "part").select("p_partkey"), li, "p_partkey", "l_partkey",
                          {"n_lines": F.count("*"), "qty": F.sum("l_quantity")}).withColumn("qty", r("qty", 2))


@query("E3_flag_members", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice>490000) THEN 1 ELSE 0 END AS big_spender FROM customer")
def flag_members(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey"))
    return jn.flag_members(table(spark, sf, "customer").select("c_custkey"), big, "c_custkey", "big_spender")


@query("E4_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderpriority='1-URGENT')")
def anti(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return jn.without(table(spark, sf, "customer").select("c_custkey", "c_name"), o, "c_custkey")


_NN = """WITH u AS (SELECT c_custkey k, CASE WHEN c_mktsegment='BUILDING' THEN 1 ELSE 0 END t, c_acctbal s FROM customer),
c AS (SELECT s, min(k) k FROM u WHERE t=0 GROUP BY 1),
lo AS (SELECT t.k tk, t.s ts, c.k ck, c.s cs FROM u t ASOF LEFT JOIN c ON t.s>=c.s WHERE t.t=1),
hi AS (SELECT t.k tk, t.s ts, c.k ck, c.s cs FROM u t ASOF LEFT JOIN c ON t.s<=c.s WHERE t.t=1),
b AS (SELECT *, row_number() OVER (PARTITION BY tk ORDER BY abs(ts-cs), ck) rn FROM (SELECT * FROM lo UNION ALL SELECT * FROM hi) WHERE ck IS NOT NULL),
m AS (SELECT tk AS treated_key, ts AS treated_score, ck AS control_key, cs AS control_score, abs(ts-cs) AS d FROM b WHERE rn=1)"""


def _scored(spark, sf):
    return table(spark, sf, "customer").withColumn("t", (F.col("c_mktsegment") == "BUILDING").cast("int"))


@query("E5_nearest_match", _NN + " SELECT treated_key, treated_score, control_key, control_score, round(d,6) AS distance FROM m")
def nearest_match(spark, sf):
    return jn.nearest_match(_scored(spark, sf), "c_custkey", "t", "c_acctbal", slices=8).withColumn("distance", r("distance", 6))


@query("E6_caliper", _NN + " SELECT treated_key, control_key, round(d,6) AS distance FROM m WHERE d<=2.0")
def caliper(spark, sf):
    m = jn.nearest_match(_scored(spark, sf), "c_custkey", "t", "c_acctbal", slices=8)
    return jn.caliper(m, 2.0).select("treated_key", "control_key", r("distance", 6).alias("distance"))


@query("E7_interval_join", f"""WITH {POLICIES}, s AS (SELECT DISTINCT user_id, effective_date FROM policies)
SELECT p.policy_id, coalesce(CAST(min(s.effective_date) AS VARCHAR),'-') AS renewed_on, min(s.effective_date) IS NOT NULL AS matched
 FROM policies p LEFT JOIN s ON p.user_id=s.user_id AND s.effective_date>p.expiry_date AND s.effective_date<=p.expiry_date+30 GROUP BY 1""")
def interval_join(spark, sf):
    p = policies(spark, sf)
    starts = p.groupBy("user_id", F.col("effective_date").alias("renewed_on")).agg(F.count("*").alias("n"))
    out = jn.within_interval(p.select("policy_id", "user_id", "expiry_date"), starts, "user_id", "expiry_date", "renewed_on", 30, ["n"])
    return out.select("policy_id", F.coalesce(F.date_format("renewed_on", "yyyy-MM-dd"), F.lit("-")).alias("renewed_on"), "matched")


@query("E8_asof_join", """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS total FROM events WHERE event_type='purchase' GROUP BY 1,2)
SELECT e.event_id, e.user_id, coalesce(CAST(s.day AS VARCHAR),'-') AS day, round(coalesce(s.total,-1),4) AS total
 FROM (SELECT event_id, user_id, CAST(ts AS DATE) AS d FROM events) e ASOF LEFT JOIN s ON e.user_id=s.user_id AND e.d>=s.day""")
def asof_join(spark, sf):
    e = table(spark, sf, "events")
    snaps = e.filter("event_type = 'purchase'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    left = e.select("event_id", "user_id", F.to_date("ts").alias("d"))
    out = jn.asof_join(left, snaps, "user_id", "d", "day", ["total"], slice_rows=200)
    return out.select("event_id", "user_id", F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("-")).alias("day"),
                      F.round(F.coalesce("total", F.lit(-1.0)), 4).alias("total"))


@query("E9_lookup_default", "SELECT c_custkey, coalesce(n_name,'OTHER') AS n_name, coalesce(CAST(n_regionkey AS INTEGER),-1) AS n_regionkey FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey<15) ON c_nationkey=n_nationkey")
def lookup_default(spark, sf):
    dim = table(spark, sf, "nation").filter("n_nationkey < 15").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    return jn.lookup(table(spark, sf, "customer"), dim, "c_nationkey", {"n_name": "OTHER", "n_regionkey": -1}).select("c_custkey", "n_name", "n_regionkey")


@query("E10_common_neighbours", f"""WITH p AS ({" UNION ALL ".join(f"SELECT '{a}' a, '{b}' b, corr({a},{b}) r FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1:])}),
 e AS (SELECT a,b FROM p WHERE abs(r)>0.0005 UNION SELECT b,a FROM p WHERE abs(r)>0.0005)
SELECT x.a AS a, y.a AS b, x.b AS via FROM e x JOIN e y ON x.b=y.b AND x.a<y.a""")
def common_neighbours(spark, sf):
    return jn.common_neighbours(pf.correlations(table(spark, sf, "lineitem"), _NUM).filter(F.abs("r") > 0.0005))


@query("E11_tier_lookup", """SELECT o_orderkey, CAST(CASE WHEN o_totalprice<50000 THEN 0.6 WHEN o_totalprice<100000 THEN 0.65 WHEN o_totalprice<150000 THEN 0.7 WHEN o_totalprice<200000 THEN 0.75 ELSE 0.8 END AS DOUBLE) AS rate,
 round(least(o_totalprice,50000)*0.6+least(greatest(o_totalprice-50000,0),50000)*0.65+least(greatest(o_totalprice-100000,0),50000)*0.7+least(greatest(o_totalprice-150000,0),50000)*0.75+greatest(o_totalprice-200000,0)*0.8,4) AS paid FROM orders""")
def tier_lookup(spark, sf):
    from ..operators.gaps import CATASTROPHIC_STEPS
    o = jn.tier_lookup(table(spark, sf, "orders"), F.col("o_totalprice"), CATASTROPHIC_STEPS, "rate")
    return o.select("o_orderkey", "rate", r(jn.bracket_sum(F.col("o_totalprice"), CATASTROPHIC_STEPS)).alias("paid"))


def snapshots(spark, sf):
    """Customer-day snapshots: version = order date, fields from the day's last order."""
    o = table(spark, sf, "orders").withColumn("version", F.date_format("o_orderdate", "yyyyMMdd").cast("long"))
    return o.groupBy(F.col("o_custkey").alias("user_id"), "version").agg(
        F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.max_by("o_orderpriority", "o_orderkey").alias("priority"), F.count("*").alias("n"))


_SNAP = """snap AS (SELECT o_custkey AS user_id, CAST(strftime(o_orderdate,'%Y%m%d') AS BIGINT) AS version, arg_max(o_orderstatus,o_orderkey) AS status,
 arg_max(o_orderpriority,o_orderkey) AS priority, count(*) AS n FROM orders GROUP BY 1,2)"""


@query("F2_keep_latest", f"WITH {_SNAP} SELECT user_id, version, status, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY version DESC) rk FROM snap) WHERE rk<=4")
def keep_latest(spark, sf):
    return od.keep_latest(snapshots(spark, sf), "user_id", ["version"], 4).select("user_id", "version", "status", "rank")


@query("F3_version_diff", f"""WITH {_SNAP}, l AS (SELECT *, lag(status) OVER w ps, lag(priority) OVER w pp, lag(n) OVER w pn FROM snap WINDOW w AS (PARTITION BY user_id ORDER BY version))
SELECT user_id, version, 'status' AS field, ps AS old_value, status AS new_value FROM l WHERE ps<>status UNION ALL
SELECT user_id, version, 'priority', pp, priority FROM l WHERE pp<>priority UNION ALL SELECT user_id, version, 'n', CAST(pn AS VARCHAR), CAST(n AS VARCHAR) FROM l WHERE pn<>n""")
def version_diff(spark, sf):
    return od.version_diff(snapshots(spark, sf), "user_id", "version", ["status", "priority", "n"])


@query("F4_trailing_count", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_day FROM events GROUP BY 1,2)
SELECT user_id, CAST(day AS VARCHAR) AS day, n_day, CAST(sum(n_day) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS n_7d,
 CAST(sum(n_day) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS n_30d FROM d""")
def trailing_count(spark, sf):
    return od.trailing_count(table(spark, sf, "events"), "user_id", "ts", [7, 30]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("F5_recency", f"""SELECT user_id, DATE '{EVENTS_ASOF}'-CAST(max(ts) AS DATE) AS days_since,
 CASE WHEN DATE '{EVENTS_ASOF}'-CAST(max(ts) AS DATE)<=7 THEN 'active' WHEN DATE '{EVENTS_ASOF}'-CAST(max(ts) AS DATE)<=30 THEN 'regular' ELSE 'infrequent' END AS activity_tier
 FROM events GROUP BY 1""")
def recency(spark, sf):
    return od.recency(table(spark, sf, "events"), "user_id", "ts", EVENTS_ASOF).select("user_id", F.col("days_since").cast("long").alias("days_since"), "activity_tier")


_ALLOWED = [("view", "click"), ("click", "purchase"), ("signup", "view"), ("view", "view"), ("purchase", "view")]


@query("F6_transitions", """WITH l AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, event_type, coalesce(p,'-') AS prev_state, p IS NULL OR (p||'>'||event_type IN ('view>click','click>purchase','signup>view','view>view','purchase>view')) AS legal FROM l""")
def transitions(spark, sf):
    t = od.transitions(table(spark, sf, "events"), "user_id", "ts", "event_type", "event_id", _ALLOWED, slice_rows=20)
    return t.select("event_id", "event_type", F.coalesce("prev_state", F.lit("-")).alias("prev_state"), "legal")


@query("F7_argmax", "SELECT user_id, arg_min(event_type, (-t, event_type)) AS event_type, round(max(t),4) AS score FROM (SELECT user_id, event_type, sum(value) t FROM events GROUP BY 1,2) GROUP BY 1")
def argmax(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("score"))
    return od.argmax_by(s, "user_id", "event_type", "score").withColumn("score", r("score"))


_ORDER = """SELECT user_id, product, CAST(row_number() OVER (PARTITION BY user_id ORDER BY tier, rk) AS INTEGER) AS priority FROM (SELECT DISTINCT user_id, product,
 CASE product WHEN 'medical' THEN 1 WHEN 'accident' THEN 1 WHEN 'critical_illness' THEN 2 WHEN 'life' THEN 2 ELSE 3 END tier,
 CASE product WHEN 'medical' THEN 1 WHEN 'accident' THEN 2 WHEN 'critical_illness' THEN 1 WHEN 'life' THEN 2 ELSE 1 END rk FROM policies)"""


@query("F8_priority_order", f"WITH {POLICIES} {_ORDER}")
def priority_order(spark, sf):
    p = policies(spark, sf).select("user_id", "product").distinct()
    tier = bands.code_map(F.col("product"), {"medical": 1, "accident": 1, "critical_illness": 2, "life": 2}, 3)
    rank = bands.code_map(F.col("product"), {"medical": 1, "accident": 2, "critical_illness": 1, "life": 2}, 1)
    return od.priority_order(p.withColumns({"tier": tier, "rk": rank}), "user_id", "tier", "rk").select("user_id", "product", "priority")


@query("F9_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_k(spark, sf):
    return od.top_k(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 10, "p_partkey")


@query("F10_turn_trend", """SELECT conv_id, count(*) AS n_turns, CAST(arg_min(length(text),turn) AS INTEGER) AS first_value, CAST(arg_max(length(text),turn) AS INTEGER) AS last_value,
 round(coalesce(regr_slope(length(text),turn),0),6) AS slope FROM conversations GROUP BY 1""")
def turn_trend(spark, sf):
    c = table(spark, sf, "conversations").withColumn("len", F.length("text"))
    return od.turn_trend(c, "conv_id", "turn", "len").select("conv_id", "n_turns", "first_value", "last_value", F.round(F.coalesce("slope", F.lit(0.0)), 6).alias("slope"))


@query("F11_chronological_head", "SELECT event_id, user_id, event_type FROM events ORDER BY ts, event_id LIMIT 500")
def chronological_head(spark, sf):
    return od.head_by(table(spark, sf, "events"), "ts", 500, "event_id").select("event_id", "user_id", "event_type")


@query("F12_median_period", "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) d FROM orders), o AS (SELECT d, row_number() OVER (ORDER BY d)-1 rn, count(*) OVER () n FROM d) "
       "SELECT CAST(o.d AS VARCHAR) AS median_day, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE)>=o.d) AS n_post FROM o WHERE rn=n//2")
def median_period(spark, sf):
    o = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    cut = od.median_period(o, "d")
    day = F.to_date(F.timestamp_seconds(F.lit(cut)))
    return o.filter(F.col("d") >= day).agg(F.count("*").alias("n_post")).select(F.date_format(day, "yyyy-MM-dd").alias("median_day"), "n_post")


@query("F13_union_by_name", "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def union_by_name(spark, sf):
    from ..sources.assemble import concat_tables
    c = table(spark, sf, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    return concat_tables([c.select("nation", "balance"), table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))])


@query("F14_intersection", "SELECT n AS nation FROM (SELECT c_nationkey n FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def intersection(spark, sf):
    c = table(spark, sf, "customer").withColumnsRenamed({"c_nationkey": "nation", "c_acctbal": "balance"})
    s = table(spark, sf, "supplier").withColumnsRenamed({"s_nationkey": "nation", "s_acctbal": "balance"})
    key = [x for x in shared_columns([c, s]) if x == "nation"]
    return c.select(*key).intersect(s.select(*key))
