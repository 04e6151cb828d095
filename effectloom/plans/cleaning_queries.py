"""Typing, encoding, imputation and outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..functions.quantiles import exact_quantiles, median
from ..operators import clean as cl
from ..operators import typing as ty
from ..operators.selection import effect_notes
from .inputs import COVERAGE, CUSTOMERS, coverage, customers, r, table
from .registry import query


def dirty(spark, sf):
    """customer with derived holes, text numbers, text dates and a sparse column."""
    k = F.col("c_custkey")
    hole = lambda m, c: F.when(k % m == 0, F.lit(None)).otherwise(c)
    return table(spark, sf, "customer").select(
        k.alias("id"), hole(10, F.col("c_acctbal")).alias("balance"), hole(11, F.col("c_mktsegment")).alias("segment"),
        hole(7, F.col("c_nationkey")).alias("nation"), F.when(k % 3 == 0, F.col("c_acctbal")).alias("sparse"),
        F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("day_text"),
        (k % 100).cast("string").alias("num_text"), F.when(k % 2 == 0, "yes").otherwise("no").alias("flag"))


DIRTY = """dirty AS (SELECT c_custkey AS id, CASE WHEN c_custkey%10<>0 THEN c_acctbal END AS balance,
 CASE WHEN c_custkey%11<>0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey%7<>0 THEN c_nationkey END AS nation,
 CASE WHEN c_custkey%3=0 THEN c_acctbal END AS sparse, '2024-01-'||lpad(CAST(c_custkey%28+1 AS VARCHAR),2,'0') AS day_text,
 CAST(c_custkey%100 AS VARCHAR) AS num_text, CASE WHEN c_custkey%2=0 THEN 'yes' ELSE 'no' END AS flag FROM customer)"""


@query("B1_full_row_dedup", "SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem")
def full_row_dedup(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity").dropDuplicates()


_TYPED = DIRTY + """, u AS (SELECT 'id' c, 'num' k, count(DISTINCT id) u, count(id) p, 0 d, 0 x FROM dirty
 UNION ALL SELECT 'balance','num',count(DISTINCT balance),count(balance),0,0 FROM dirty
 UNION ALL SELECT 'segment','text',count(DISTINCT segment),count(segment),count(TRY_CAST(segment AS TIMESTAMP)),count(TRY_CAST(segment AS DOUBLE)) FROM dirty
 UNION ALL SELECT 'nation','num',count(DISTINCT nation),count(nation),0,0 FROM dirty
 UNION ALL SELECT 'sparse','num',count(DISTINCT sparse),count(sparse),0,0 FROM dirty
 UNION ALL SELECT 'day_text','text',count(DISTINCT day_text),count(day_text),count(TRY_CAST(day_text AS TIMESTAMP)),count(TRY_CAST(day_text AS DOUBLE)) FROM dirty
 UNION ALL SELECT 'num_text','text',count(DISTINCT num_text),count(num_text),0,count(TRY_CAST(num_text AS DOUBLE)) FROM dirty
 UNION ALL SELECT 'flag','text',count(DISTINCT flag),count(flag),0,count(TRY_CAST(flag AS DOUBLE)) FROM dirty),
n AS (SELECT count(*) n FROM dirty),
meta AS (SELECT c AS "column", n.n AS n, n.n-p AS n_missing, u AS n_unique, CASE WHEN u<=2 THEN 'binary'
  WHEN k='text' AND d/n.n>0.8 THEN 'datetime' WHEN k='text' AND x=p THEN 'continuous' WHEN k='text' THEN 'categorical'
  WHEN u<=20 AND u/n.n<0.3 THEN 'categorical' ELSE 'continuous' END AS semantic_type FROM u, n)"""


@query("B2_semantic_types", f"WITH {_TYPED} SELECT \"column\", semantic_type, n, n_missing, n_unique FROM meta")
def semantic_types(spark, sf):
    return ty.column_meta(dirty(spark, sf), with_median=False).select("column", "semantic_type", "n", "n_missing", "n_unique")


@query("B3_datetime_coercion", "SELECT user_id, count(*) AS n, count(TRY_CAST(t AS TIMESTAMP)) AS n_valid FROM (SELECT user_id, "
       "CASE WHEN event_id%9=0 THEN 'n/a' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS t FROM events) GROUP BY 1")
def datetime_coercion(spark, sf):
    raw = table(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 9 == 0, "n/a").otherwise(
        F.date_format("ts", "yyyy-MM-dd")).alias("t"))
    return ty.coerce_datetime(raw, ["t"]).groupBy("user_id").agg(F.count("*").alias("n"), F.count("t").alias("n_valid"))


@query("B4_numeric_coercion", "SELECT event_type, count(TRY_CAST(t AS DOUBLE)) AS n_numbers, count(*) AS n, round(sum(TRY_CAST(t AS DOUBLE)),2) AS total "
       "FROM (SELECT event_type, CASE WHEN event_id%8=0 THEN 'abc' ELSE CAST(value AS VARCHAR) END AS t FROM events) GROUP BY 1")
def numeric_coercion(spark, sf):
    raw = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 8 == 0, "abc").otherwise(F.col("value").cast("string")).alias("t"))
    return ty.coerce_numeric(raw, ["t"]).groupBy("event_type").agg(
        F.count("t").alias("n_numbers"), F.count("*").alias("n"), F.round(F.sum("t"), 2).alias("total"))


@query("B5_select_by_type", f"WITH {DIRTY} SELECT id, balance, nation, sparse, num_text FROM dirty")
def select_by_type(spark, sf):
    df = dirty(spark, sf)
    return ty.select_by_type(df, ty.column_meta(df, with_median=False, exact_unique=False), "continuous")


@query("B6_drop_sparse_columns", f"WITH {DIRTY} SELECT id, balance, segment, CAST(nation AS DOUBLE) AS nation, day_text, num_text, flag FROM dirty")
def drop_sparse_columns(spark, sf):
    return ty.drop_sparse_columns(dirty(spark, sf)).withColumn("nation", F.col("nation").cast("double"))


@query("B7_drop_empty_rows", f"WITH {DIRTY} SELECT balance, segment FROM dirty WHERE balance IS NOT NULL OR segment IS NOT NULL")
def drop_empty_rows(spark, sf):
    return ty.drop_empty_rows(dirty(spark, sf).select("balance", "segment"))


@query("B8_complete_cases", f"WITH {DIRTY} SELECT id, balance, segment, CAST(nation AS INTEGER) AS nation FROM dirty WHERE balance IS NOT NULL AND segment IS NOT NULL AND nation IS NOT NULL")
def complete_cases(spark, sf):
    return ty.complete_cases(dirty(spark, sf), ["balance", "segment", "nation"]).select("id", "balance", "segment", "nation")


@query("B9_banding", f"""WITH {CUSTOMERS} SELECT user_id, CASE WHEN age<=17 THEN '少儿' WHEN age<=25 THEN '青年' WHEN age<=35 THEN '青壮'
 WHEN age<=45 THEN '中青' WHEN age<=55 THEN '中年' WHEN age<=65 THEN '中老' ELSE '老年' END AS age_band,
 CASE WHEN income<50000 THEN '<5万' WHEN income<100000 THEN '5-10万' WHEN income<200000 THEN '10-20万' WHEN income<500000 THEN '20-50万'
  WHEN income<1000000 THEN '50-100万' ELSE '>100万' END AS income_band,
 CASE WHEN engagement>=80 THEN '高度活跃' WHEN engagement>=55 THEN '活跃' WHEN engagement>=30 THEN '一般' WHEN engagement>=10 THEN '沉睡' ELSE '流失' END AS engagement_tier
 FROM customers""")
def banding(spark, sf):
    return customers(spark, sf).select("user_id", bands.age_band(F.col("age")).alias("age_band"),
                                       bands.income_band(F.col("income")).alias("income_band"),
                                       bands.engagement_tier(F.col("engagement")).alias("engagement_tier"))


@query("B10_median_binarize", "SELECT o_orderkey, CASE WHEN o_totalprice > (SELECT quantile_cont(o_totalprice,0.5) FROM orders) THEN 1 ELSE 0 END AS treated FROM orders")
def median_binarize(spark, sf):
    return ty.binarize(table(spark, sf, "orders"), "o_totalprice").select("o_orderkey", "treated")


@query("B11_standardize", "SELECT o_orderkey, round((o_totalprice-(SELECT avg(o_totalprice) FROM orders))/(SELECT stddev_samp(o_totalprice) FROM orders),6) AS z FROM orders")
def standardize(spark, sf):
    return ty.standardize(table(spark, sf, "orders"), ["o_totalprice"]).select("o_orderkey", r("o_totalprice_z", 6).alias("z"))


@query("B12_interactions", """WITH m AS (SELECT quantile_cont(o_totalprice,0.5) m FROM orders)
SELECT o_orderkey, t AS treated, p AS post, t*p AS treat_post, round(rc,4) AS rc, above, round(rc*above,4) AS inter FROM (
 SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END t, CASE WHEN o_orderdate>=TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END p,
 o_totalprice-m.m AS rc, CASE WHEN o_totalprice>=m.m THEN 1 ELSE 0 END AS above FROM orders, m)""")
def interactions(spark, sf):
    o = table(spark, sf, "orders")
    o = ty.treatment_post(o, F.col("o_orderstatus") == "F", F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return ty.cutoff_features(o, "o_totalprice", median(o, "o_totalprice")).select(
        "o_orderkey", "treated", "post", "treat_post", r("rc").alias("rc"), "above", r("inter").alias("inter"))


@query("B13_derived_sums", f"""WITH {COVERAGE} SELECT user_id, CAST(n_medical+n_critical_illness+n_accident+n_life+n_annuity AS BIGINT) AS policy_count,
 round(have_medical+have_ci+have_life,4) AS cover_total FROM coverage""")
def derived_sums(spark, sf):
    df = ty.row_sum(coverage(spark, sf), ["n_medical", "n_critical_illness", "n_accident", "n_life", "n_annuity"], "policy_count")
    return ty.row_sum(df, ["have_medical", "have_ci", "have_life"], "cover_total").select("user_id", "policy_count", r("cover_total").alias("cover_total"))


@query("B14_code_mapping", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'HOUSEHOLD' THEN 2 WHEN 'AUTOMOBILE' THEN 1 ELSE 0 END AS burden_code,
 CAST(CASE c_nationkey%4 WHEN 0 THEN 1.8 WHEN 1 THEN 1.3 WHEN 2 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS tier_factor FROM customer""")
def code_mapping(spark, sf):
    tier = F.element_at(F.array(F.lit("一线"), F.lit("新一线"), F.lit("二线"), F.lit("?")), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select(
        "c_custkey", bands.code_map(F.col("c_mktsegment"), {"BUILDING": 3, "HOUSEHOLD": 2, "AUTOMOBILE": 1}, 0).alias("burden_code"),
        bands.code_map(tier, {"一线": 1.8, "新一线": 1.3, "二线": 1.0, "三线": 0.7}, 0.5).alias("tier_factor"))


@query("B15_missing_marker", f"""WITH {DIRTY} SELECT id, CASE WHEN balance IS NULL THEN 'missing' ELSE 'present' END AS balance_status,
 CASE WHEN segment IS NULL THEN 'missing' ELSE 'present' END AS segment_status,
 round(((balance IS NOT NULL)::INT+(segment IS NOT NULL)::INT+(nation IS NOT NULL)::INT)/3.0,6) AS data_completeness FROM dirty""")
def missing_marker(spark, sf):
    return ty.mark_missing(dirty(spark, sf), ["balance", "segment", "nation"]).select(
        "id", "balance_status", "segment_status", r("data_completeness", 6).alias("data_completeness"))


@query("B16_significance_notes", """SELECT event_id, CASE WHEN p<0.001 THEN '***' WHEN p<0.01 THEN '**' WHEN p<0.05 THEN '*' WHEN p<0.1 THEN '.' ELSE '' END AS stars,
 CASE WHEN abs(a)>0.5 THEN 'large' WHEN abs(a)>0.1 THEN 'medium' ELSE 'small' END AS magnitude
 FROM (SELECT event_id, value/500 AS p, value/100-0.5 AS a FROM events)""")
def significance_notes(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") / 500).alias("p_value"), (F.col("value") / 100 - 0.5).alias("ate"))
    return effect_notes(e).select("event_id", "stars", "magnitude")


@query("C1_median_impute", f"WITH {DIRTY} SELECT id, round(coalesce(balance,(SELECT quantile_cont(balance,0.5) FROM dirty)),4) AS balance FROM dirty")
def median_impute(spark, sf):
    return cl.impute_median(dirty(spark, sf), ["balance"]).select("id", r("balance").alias("balance"))


@query("C2_mode_impute", f"""WITH {DIRTY} SELECT id, coalesce(segment,(SELECT segment FROM dirty WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1)) AS segment,
 coalesce(nation,(SELECT nation FROM dirty WHERE nation IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, nation LIMIT 1)) AS nation FROM dirty""")
def mode_impute(spark, sf):
    return cl.impute_mode(dirty(spark, sf), ["segment", "nation"]).select("id", "segment", "nation")


def _holes(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"),
                                                                F.avg("l_discount").alias("disc"))
    return li.withColumns({"qty": F.when(F.col("l_orderkey") % 9 != 0, F.col("qty")), "price": F.when(F.col("l_orderkey") % 13 != 0, F.col("price"))})


@query("C3_iterative_impute")
def iterative_impute(spark, sf):
    return cl.iterative_impute(_holes(spark, sf), ["qty", "price", "disc"]).select("l_orderkey", r("qty").alias("qty"), r("price", 2).alias("price"))


def _evidence_sql(name, source, x1, x2, y, where):
    """Moments, precisions turn by turn, and the last turn's slopes and intercept of y on two columns."""
    def fit(ratio, state):
        det = f"((s11+{ratio})*(s22+{ratio})-s12*s12)"
        return (f"SELECT *, yy-2*(w1*r1+w2*r2)+w1*w1*s11+2*w1*w2*s12+w2*w2*s22 AS sse, 2-ratio*(s11+s22+2*ratio)/det AS free FROM "
                f"(SELECT *, ((s22+ratio)*r1-s12*r2)/det AS w1, ((s11+ratio)*r2-s12*r1)/det AS w2 FROM (SELECT {state}, {ratio} AS ratio, {det} AS det, {name}_m.* FROM ")
    noise, slopes = "((n-free+2e-6)/(sse+2e-6))", "((free+2e-6)/(w1*w1+w2*w2+2e-6))"
    return f"""{name}_m AS (SELECT count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my, var_pop({x1})*count(*) AS s11, covar_pop({x1},{x2})*count(*) AS s12, var_pop({x2})*count(*) AS s22,
 covar_pop({x1},{y})*count(*) AS r1, covar_pop({x2},{y})*count(*) AS r2, var_pop({y})*count(*) AS yy FROM {source} WHERE {where}),
{name}_e AS (SELECT turn, w1, w2, sse, free, 1e9 AS moved FROM ({fit("(yy/n)", "-1 AS turn")} {name}_m))) UNION ALL
 SELECT turn, w1, w2, sse, free, abs(w1-o1)+abs(w2-o2) AS moved FROM ({fit(f"({slopes}/{noise})", "turn+1 AS turn, o1, o2")}
 (SELECT turn, w1, w2, sse, free, w1 AS o1, w2 AS o2 FROM {name}_e WHERE turn<299 AND NOT (turn>=1 AND moved<1e-3)) _s, {name}_m)))),
{name} AS (SELECT w1, w2, my-m1*w1-m2*w2 AS w0 FROM {name}_e, {name}_m ORDER BY turn DESC LIMIT 1)"""


@query("C3_imputation_round", f"""WITH RECURSIVE h AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey%9<>0 THEN sum(l_quantity) END AS qty, CASE WHEN l_orderkey%13<>0 THEN sum(l_extendedprice) END AS price, avg(l_discount) AS d FROM lineitem GROUP BY 1),
a AS (SELECT k, qty, price, d, coalesce(qty, (SELECT avg(qty) FROM h)) AS q FROM h),
{_evidence_sql("p1", "a", "q", "d", "price", "price IS NOT NULL")},
b AS (SELECT k, qty, d, q, coalesce(price, w0+w1*q+w2*d) AS p FROM a, p1),
{_evidence_sql("q1", "b", "p", "d", "qty", "qty IS NOT NULL")}
SELECT k AS l_orderkey, round(coalesce(qty, w0+w1*p+w2*d),3) AS qty, round(p,0) AS price FROM b, q1""")
def imputation_round(spark, sf):
    """One round: price has fewer holes and is filled first, quantity then from the filled price."""
    out = cl.iterative_impute(_holes(spark, sf), ["qty", "price", "disc"], rounds=1)
    return out.select("l_orderkey", r("qty", 3).alias("qty"), r("price", 0).alias("price"))


_IQR = "q AS (SELECT quantile_cont(l_extendedprice,0.25) a, quantile_cont(l_extendedprice,0.75) b FROM lineitem), lim AS (SELECT a-0.4*(b-a) lo, b+0.4*(b-a) hi FROM q)"


@query("C4_iqr_winsorize", f"WITH {_IQR} SELECT l_returnflag, round(sum(least(greatest(l_extendedprice,lo),hi)),2) AS total, "
       "count(*) FILTER (l_extendedprice<lo OR l_extendedprice>hi) AS n_clipped FROM lineitem, lim GROUP BY 1")
def iqr_winsorize(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", F.col("l_extendedprice").alias("raw"))
    # 0.4 rather than 1.5 so that the flat supplied prices have values beyond the fences
    out = cl.winsorize(li, ["l_extendedprice"], "iqr", 0.4)
    return out.groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"),
                                           F.count_if(F.col("raw") != F.col("l_extendedprice")).alias("n_clipped"))


@query("C5_zscore_winsorize", """WITH m AS (SELECT avg(value) m, stddev_samp(value) s, stddev_pop(value) p FROM events)
SELECT event_type, round(sum(least(greatest(value,m.m-2*m.s),m.m+2*m.s)),4) AS total,
 count(*) FILTER (abs(value-m.m)/m.p>2) AS n_flagged FROM events, m GROUP BY 1""")
def zscore_winsorize(spark, sf):
    e = table(spark, sf, "events").select("event_type", "value")
    bounds, flag = cl.zscore_bounds(e, ["value"], 2.0)
    lo, hi = flag["value"]
    out = cl.clip(e.withColumn("flagged", (F.col("value") < lo) | (F.col("value") > hi)), bounds)
    return out.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count_if("flagged").alias("n_flagged"))


@query("C6_cleaning_report", f"""WITH {_TYPED}, lim AS (SELECT quantile_cont(v,0.25)-1.5*(quantile_cont(v,0.75)-quantile_cont(v,0.25)) lo,
 quantile_cont(v,0.75)+1.5*(quantile_cont(v,0.75)-quantile_cont(v,0.25)) hi FROM (SELECT coalesce(balance,(SELECT quantile_cont(balance,0.5) FROM dirty)) v FROM dirty))
SELECT "column", semantic_type, n_missing, n_missing/n>0.5 AS dropped,
 CASE WHEN n_missing=0 OR n_missing/n>0.5 THEN 'none' WHEN semantic_type='continuous' THEN 'median' ELSE 'mode' END AS imputed_by,
 CASE WHEN n_missing/n>0.5 THEN 0 ELSE n_missing END AS n_imputed FROM meta""")
def cleaning_report(spark, sf):
    return cl.clean(dirty(spark, sf)).report.select("column", "semantic_type", "n_missing", "dropped",
                                                    F.coalesce("imputed_by", F.lit("none")).alias("imputed_by"), "n_imputed")


@query("C7_clean_end_to_end", f"""WITH {DIRTY}, imp AS (SELECT id, coalesce(balance,(SELECT quantile_cont(balance,0.5) FROM dirty)) b,
 coalesce(segment,(SELECT segment FROM dirty WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1)) AS segment, day_text, num_text, flag FROM dirty),
lim AS (SELECT quantile_cont(b,0.25) a, quantile_cont(b,0.75) c FROM imp)
SELECT id, round(least(greatest(b,a-1.5*(c-a)),c+1.5*(c-a)),4) AS balance, segment, day_text, CAST(num_text AS DOUBLE) AS num_text, flag FROM imp, lim""")
def clean_end_to_end(spark, sf):
    return cl.clean(dirty(spark, sf)).data.select("id", r("balance").alias("balance"), "segment",
                                                  F.date_format("day_text", "yyyy-MM-dd").alias("day_text"), "num_text", "flag")


@query("C7_quartiles", "SELECT round(quantile_cont(l_extendedprice,0.25),4) AS q1, round(quantile_cont(l_extendedprice,0.5),4) AS q2, round(quantile_cont(l_extendedprice,0.75),4) AS q3 FROM lineitem")
def quartiles(spark, sf):
    # narrow by histogram passes regardless of size, the path a large column takes
    q = exact_quantiles(table(spark, sf, "lineitem").select("l_extendedprice"), {"l_extendedprice": [0.25, 0.5, 0.75]})["l_extendedprice"]
    return spark.createDataFrame([tuple(round(v, 4) for v in q)], "q1 double, q2 double, q3 double")
