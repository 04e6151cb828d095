"""Estimator queries; baskets (one row per order) carry real structure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import dag, did as dd, dml, gram, iv, panel, psm, rdd as rd, selection as sel
from ..operators import joins as jn
from ..operators import ordered as od
from ..operators import profiling as pf
from ..operators import typing as ty
from ..operators.assignment import one_to_one_match
from ..operators.histtrees import honest_forest
from .inputs import r, table
from .profiling_queries import _NN
from .registry import query
from .sqlgen import ols_sql, ols_term


def baskets(spark, sf):
    """Order-level lines, quantity, price and discount."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").cast("double").alias("n_lines"), F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"),
        F.avg("l_discount").alias("disc"), F.max("l_tax").alias("tax"), F.min("l_suppkey").alias("supp"))


BASKETS = """b AS (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS qty, sum(l_extendedprice) AS price,
 avg(l_discount) AS disc, max(l_tax) AS tax, min(l_suppkey) AS supp FROM lineitem GROUP BY 1)"""


def tidy(df, digits=4):
    return df.select("method", "term", r("coef", digits).alias("coef"), r("se", digits).alias("se"), r("t_stat", digits).alias("t_stat"))


def did_orders(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    o = table(spark, sf, "orders").join(c, "o_custkey").withColumn("day", F.to_date("o_orderdate"))
    return o.withColumn("is_building", (F.col("c_mktsegment") == "BUILDING").cast("int"))


DID = """m AS (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d)-1 rn, count(*) OVER () n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) d FROM orders)) WHERE rn=n//2),
f AS (SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day, CAST(c_mktsegment='BUILDING' AS INTEGER) AS treated,
 CAST(CAST(o_orderdate AS DATE)>=(SELECT d FROM m) AS INTEGER) AS post, CAST(c_mktsegment='BUILDING' AND CAST(o_orderdate AS DATE)>=(SELECT d FROM m) AS INTEGER) AS treat_post
 FROM orders JOIN customer ON o_custkey=c_custkey)"""

_SCORES = """SELECT 'dag_discovery' AS method, 1.0+(n>=200)::INT+0.5 AS score, 0 AS o FROM s UNION ALL SELECT 'diff_in_diff', 0.5, 1 FROM s
 UNION ALL SELECT 'instrumental_variable', 0.5+0.5*(n>=100)::INT, 2 FROM s UNION ALL SELECT 'panel_regression', 0.5, 3 FROM s
 UNION ALL SELECT 'propensity_score', 1.5-0.5+1.0+0.5, 4 FROM s UNION ALL SELECT 'double_ml', 1.0+CASE WHEN n>=500 THEN 1.0 ELSE -0.5 END+1.0, 5 FROM s
 UNION ALL SELECT 'rdd', 0.3+0.5*(n>=200)::INT, 6 FROM s"""


def _stats(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    # l_discount has eleven values, so it is neither binary nor continuous
    return pf.dataset_stats(df, ty.column_meta(df, with_median=False), "l_discount")


@query("G1_method_scores", f"WITH s AS (SELECT count(*) n FROM lineitem), x AS ({_SCORES}) SELECT method, CAST(score AS DOUBLE) AS score FROM x")
def method_scores(spark, sf):
    return sel.score_methods(_stats(spark, sf)).select("method", r("score", 6).alias("score"))


@query("G2_method_selection", f"WITH s AS (SELECT count(*) n FROM lineitem), x AS ({_SCORES}) SELECT method, CAST(score AS DOUBLE) AS score, "
       "CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, o) rk, max(score) OVER () b FROM x) WHERE score>=b*0.3 AND rk<=3")
def method_selection(spark, sf):
    return sel.select_methods(sel.score_methods(_stats(spark, sf))).select("method", r("score", 6).alias("score"), "rank")


@query("G3_alias_resolution", """WITH a AS (SELECT event_id, event_type, CASE event_type WHEN 'view' THEN 'diff_in_diff' WHEN 'click' THEN 'propensity_score' WHEN 'error' THEN '-'
 WHEN 'signup' THEN 'panel_regression' ELSE 'double_ml' END AS m FROM events) SELECT event_id, 0 AS position, m AS method FROM a
 UNION ALL SELECT event_id, CASE event_type WHEN 'view' THEN 2 ELSE 1 END, 'instrumental_variable' FROM a""")
def alias_resolution(spark, sf):
    raw = (F.when(F.col("event_type") == "view", "did,双重差分, 2SLS").when(F.col("event_type") == "click", " PSM,iv")
           .when(F.col("event_type") == "error", "bogus,工具变量").when(F.col("event_type") == "signup", "FE,2sls").otherwise("DML,iv"))
    req = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return sel.resolve_methods(req, "event_id", "raw").select("event_id", "position", F.coalesce("method", F.lit("-")).alias("method"))


_RM = BASKETS + """, d AS (SELECT b.*, CAST(o_orderdate AS DATE) AS day, CAST(qty>100 AS INTEGER) AS big FROM b JOIN orders ON o_orderkey=l_orderkey),
 md AS (SELECT dd FROM (SELECT dd, row_number() OVER (ORDER BY dd)-1 rn, count(*) OVER () n FROM (SELECT DISTINCT day AS dd FROM d)) WHERE rn=n//2),
 cells AS (SELECT big, CAST(day>=dd AS INTEGER) AS post, avg(price) AS mu FROM d, md GROUP BY 1,2),
 iv0 AS (SELECT price-avg(price) OVER () y, big-avg(big) OVER () t, n_lines-avg(n_lines) OVER () z, disc-avg(disc) OVER () x FROM d),
 iv1 AS (SELECT y-x*(sum(x*y) OVER ()/sum(x*x) OVER ()) y, t-x*(sum(x*t) OVER ()/sum(x*x) OVER ()) t, z-x*(sum(x*z) OVER ()/sum(x*x) OVER ()) z FROM iv0),
 mo AS (SELECT f, avg(price) my, avg(big) mt, avg(n_lines) mx, avg(disc) md, covar_pop(price,n_lines) yx, covar_pop(price,disc) yd, covar_pop(big,n_lines) tx, covar_pop(big,disc) td,
  var_pop(n_lines) xx, var_pop(disc) dd, covar_pop(n_lines,disc) xd FROM d, (VALUES (0),(1),(2)) v(f) WHERE l_orderkey%3<>f GROUP BY 1),
 co AS (SELECT f, my, mt, mx, md, (yx*dd-yd*xd)/(xx*dd-xd*xd) y1, (yd*xx-yx*xd)/(xx*dd-xd*xd) y2, (tx*dd-td*xd)/(xx*dd-xd*xd) t1, (td*xx-tx*xd)/(xx*dd-xd*xd) t2 FROM mo),
 rs AS (SELECT price-my-y1*(n_lines-mx)-y2*(disc-md) AS ry, big-mt-t1*(n_lines-mx)-t2*(disc-md) AS rt FROM d JOIN co ON l_orderkey%3=f),
 bw AS (SELECT 1.06*stddev_samp(qty)*pow(count(*),-0.2)*2 AS h FROM d),
 side AS (SELECT qty>=100 AS a, regr_intercept(price, qty-100) AS c FROM d, bw WHERE abs(qty-100)<=h GROUP BY 1)"""


@query("G4_run_methods", f"""WITH {_RM} SELECT 'diff_in_diff' AS method, round(sum(CASE WHEN big=post THEN mu ELSE -mu END),2) AS ate, 2 AS n_failed FROM cells
 UNION ALL SELECT 'instrumental_variable', round(sum(z*y)/sum(z*t),2), 2 FROM iv1 UNION ALL SELECT 'double_ml', round(sum(ry*rt)/sum(rt*rt),2), 2 FROM rs
 UNION ALL SELECT 'rdd', round(sum(CASE WHEN a THEN c ELSE -c END),2), 2 FROM side""")
def run_methods(spark, sf):
    """Four estimators of one request; the panel one (no entity variation asked for) and an unknown name fail alone."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("day"))
    df = baskets(spark, sf).join(o, "l_orderkey").withColumn("big", (F.col("qty") > 100).cast("int")).withColumn("word", F.lit("text cause"))
    req = sel.CausalRequest("price", "big", ["n_lines", "disc", "word"], key="l_orderkey", entity="l_orderkey", time="day", running="qty", cutoff=100.0)
    out, errors = sel.run_methods(df, req, ["DID", "iv", "dml", " rdd", "fe", "dag", "unknown"])
    return out.select("method", r("ate", 2).alias("ate")).withColumn("n_failed", F.lit(len(errors)))


@query("G5_ols", ols_sql(BASKETS, "b", "price", ["n_lines", "qty", "disc"], "ols", 3))
def ols(spark, sf):
    return tidy(gram.ols(baskets(spark, sf), "price", ["n_lines", "qty", "disc"]).coef_table(spark), 3)


@query("G6_coef_table", ols_sql("l AS (SELECT l_extendedprice, l_quantity, l_tax FROM lineitem)", "l", "l_extendedprice", ["l_quantity", "l_tax"], "ols", 4))
def coef_table(spark, sf):
    return tidy(gram.ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"]).coef_table(spark), 4)


_FE = """w AS (SELECT supp, price-avg(price) OVER (PARTITION BY supp) AS y, qty-avg(qty) OVER (PARTITION BY supp) AS x FROM b),
 s AS (SELECT sum(x*y)/sum(x*x) AS beta, sum(x*x) AS xx, sum(y*y)-pow(sum(x*y),2)/sum(x*x) AS ssr, count(*) AS n, count(DISTINCT supp) AS g FROM w)"""


@query("G7_panel_fixed_effects", f"WITH {BASKETS}, {_FE} SELECT 'panel_fe' AS method, 'qty' AS term, round(beta,4) AS coef, round(sqrt(ssr/(n-g-1)/xx),4) AS se, "
       "round(beta/sqrt(ssr/(n-g-1)/xx),3) AS t_stat FROM s")
def panel_fixed_effects(spark, sf):
    return tidy(panel.panel_regression(baskets(spark, sf), "supp", "price", ["qty"], clustered=False, with_re=False).fe.coef_table(spark)).withColumn("t_stat", r("t_stat", 3))


@query("G8_clustered_errors", f"WITH {BASKETS}, {_FE}, h AS (SELECT supp, sum(x*(y-beta*x)) AS q FROM w, s GROUP BY 1) "
       "SELECT 'panel_fe' AS method, 'qty' AS term, round(any_value(beta),4) AS coef, round(sqrt(sum(q*q)*any_value(n)/any_value(n-1))/any_value(xx),4) AS se FROM h, s")
def clustered_errors(spark, sf):
    return tidy(panel.panel_regression(baskets(spark, sf), "supp", "price", ["qty"], with_re=False).fe.coef_table(spark)).drop("t_stat")


_RE = _FE + """, e AS (SELECT supp, count(*) AS t, avg(qty) AS mx, avg(price) AS my FROM b GROUP BY 1),
 bt AS (SELECT regr_syy(my,mx)-pow(regr_sxy(my,mx),2)/regr_sxx(my,mx) AS ssr, count(*) AS g, count(*)/sum(1.0/t) AS tbar FROM e),
 v AS (SELECT s.ssr/(s.n-s.g-1) AS s2e, greatest(0, bt.ssr/(bt.g-2)-s.ssr/(s.n-s.g-1)/bt.tbar) AS s2u FROM s, bt),
 th AS (SELECT e.*, sqrt(s2e/(s2e+t*s2u)) AS k FROM e, v),
 z AS (SELECT th.k AS c, b.qty-(1-k)*mx AS x, b.price-(1-k)*my AS y FROM b JOIN th USING (supp)),
 p AS (SELECT x-c*(sum(x*c) OVER ()/sum(c*c) OVER ()) AS x, y-c*(sum(y*c) OVER ()/sum(c*c) OVER ()) AS y FROM z),
 re AS (SELECT sum(x*y)/sum(x*x) AS beta, (sum(y*y)-pow(sum(x*y),2)/sum(x*x))/(count(*)-2)/sum(x*x) AS var, sum(x*x) AS xx FROM p)"""


@query("G9_random_effects", f"WITH {BASKETS}, {_RE} SELECT 'panel_re' AS method, 'qty' AS term, round(beta,4) AS coef, round(sqrt(var),4) AS se FROM re")
def random_effects(spark, sf):
    return tidy(panel.panel_regression(baskets(spark, sf), "supp", "price", ["qty"]).re.coef_table(spark)).drop("t_stat")


@query("G10_hausman", f"WITH {BASKETS}, {_RE} SELECT round(pow(s.beta-re.beta,2)/(v.s2e/s.xx-v.s2e/re.xx),3) AS hausman, 1 AS df FROM s, re, v")
def hausman(spark, sf):
    res = panel.panel_regression(baskets(spark, sf), "supp", "price", ["qty"])
    return spark.createDataFrame([(round(res.hausman, 3), res.hausman_df)], "hausman double, df int")


@query("G11_pooled_ols", ols_sql(BASKETS, "b", "price", ["qty", "tax"], "pooled_ols", 3))
def pooled(spark, sf):
    return tidy(panel.pooled_ols(baskets(spark, sf), "price", ["qty", "tax"]).coef_table(spark), 3)


@query("G12_propensity_score")
def propensity_score(spark, sf):
    c = table(spark, sf, "customer").withColumn("t", (F.col("c_mktsegment") == "BUILDING").cast("int"))
    spend = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spend"), F.count("*").alias("n_orders"))
    return psm.propensity(c.join(spend, "c_custkey"), "t", ["c_acctbal", "spend", "n_orders"]).select("c_custkey", "t", r("score", 3).alias("score"))


@query("G12_score_equation", """WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (c_mktsegment='BUILDING') AS n_treated, 0.0::DOUBLE AS residual, true AS inside FROM customer JOIN s ON o_custkey=c_custkey WHERE c_acctbal IS NOT NULL""")
def score_equation(spark, sf):
    """The unpenalised intercept makes treated rows and scores sum to the same; scores are probabilities."""
    s = propensity_score(spark, sf)
    return s.agg(F.count("*").alias("n"), F.count_if(F.col("t") == 1).alias("n_treated"), (F.round(F.avg(F.col("t") - F.col("score")), 3) + F.lit(0.0)).alias("residual"),
                 F.bool_and(F.col("score").between(0, 1)).alias("inside"))


# rounded logistic of the balance: many customers share a score
_SCORE_SQL = _NN.replace("c_acctbal s FROM customer", "round(1/(1+exp(-(c_acctbal-4500)/3000)),3) s FROM customer")


def scored(spark, sf):
    s = F.round(1 / (1 + F.exp(-(F.col("c_acctbal") - 4500) / 3000)), 3)
    spend = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spend"))
    return (table(spark, sf, "customer").withColumns({"t": (F.col("c_mktsegment") == "BUILDING").cast("int"), "score": s})
            .join(spend, "c_custkey", "left").na.fill(0.0, ["spend"]))


def pairs(spark, sf):
    df = scored(spark, sf)
    return psm.matched_rows(df, jn.nearest_match(df, "c_custkey", "t", "score", slices=4), "c_custkey", ["spend", "c_acctbal", "c_nationkey"])


_PAIRS = _SCORE_SQL + """, sp AS (SELECT c_custkey AS k, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS n, CAST(c_mktsegment='BUILDING' AS INTEGER) AS t, coalesce(s,0) AS s FROM customer LEFT JOIN
 (SELECT o_custkey, sum(o_totalprice) s FROM orders GROUP BY 1) ON o_custkey=c_custkey),
 pr AS (SELECT t.s AS ts, c.s AS cs, t.a AS ta, c.a AS ca, t.n AS tn, c.n AS cn FROM m JOIN sp t ON t.k=treated_key JOIN sp c ON c.k=control_key)"""


@query("G13_one_nn_matching", _SCORE_SQL + " SELECT treated_key, treated_score, control_key, control_score FROM m")
def one_nn_matching(spark, sf):
    return jn.nearest_match(scored(spark, sf), "c_custkey", "t", "score", slices=4).select("treated_key", "treated_score", "control_key", "control_score")


# levels of the running balance of the sorted scores; in each, neighbours pair around the one left out
_ONE_TO_ONE = """WITH u AS (SELECT c_custkey k, CAST(c_mktsegment='BUILDING' AS INTEGER) t, round(1/(1+exp(-(c_acctbal-4500)/3000)),3) s FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL),
l AS (SELECT *, sum(2*t-1) OVER (ORDER BY s,t,k ROWS UNBOUNDED PRECEDING)-t lev, CAST(round(s*1000000000) AS BIGINT) w FROM u),
p AS (SELECT *, row_number() OVER o i, sum((2*t-1)*w) OVER o z, count(*) OVER (PARTITION BY lev) n FROM l WINDOW o AS (PARTITION BY lev ORDER BY s,t,k)),
x AS (SELECT lev, CASE WHEN max(n)%2=1 THEN arg_min(i, (2*z+w)*10000000+i) FILTER (t=0) END d FROM p GROUP BY 1),
q AS (SELECT p.*, (i+CASE WHEN d IS NOT NULL AND i>d THEN 0 ELSE 1 END)//2 pr FROM p JOIN x USING (lev) WHERE d IS NULL OR i<>d),
m AS (SELECT max(k) FILTER (t=1) treated_key, max(s) FILTER (t=1) treated_score, max(k) FILTER (t=0) control_key, max(s) FILTER (t=0) control_score FROM q GROUP BY lev, pr)"""


@query("G13_without_replacement", _ONE_TO_ONE + " SELECT * FROM m")
def without_replacement(spark, sf):
    return one_to_one_match(scored(spark, sf), "c_custkey", "t", "score").drop("distance")


@query("G14_att_without_replacement", _ONE_TO_ONE + """, sp AS (SELECT c_custkey k, coalesce(s,0) y FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) s FROM orders GROUP BY 1) ON o_custkey=c_custkey)
 SELECT count(*) AS n, round(avg(a.y-b.y),3) AS ate, round(stddev_samp(a.y-b.y)/sqrt(count(*)),3) AS se, round(sum(abs(treated_score-control_score)),4) AS total_distance
 FROM m JOIN sp a ON a.k=treated_key JOIN sp b ON b.k=control_key""")
def att_without_replacement(spark, sf):
    df = scored(spark, sf)
    pr = psm.matched_rows(df, one_to_one_match(df, "c_custkey", "t", "score"), "c_custkey", ["spend"])
    total = pr.agg(F.round(F.sum("distance"), 4).alias("total_distance"))
    return psm.att_table(pr, "spend").select("n", r("ate", 3).alias("ate"), r("se", 3).alias("se")).crossJoin(total)  # one row on each side


@query("G14_att", _PAIRS + " SELECT round(avg(ts-cs),3) AS ate, round(stddev_samp(ts-cs)/sqrt(count(*)),3) AS se, count(*) AS n, "
       "round(avg(ts-cs)-1.96*stddev_samp(ts-cs)/sqrt(count(*)),3) AS ci_lower FROM pr")
def att(spark, sf):
    return psm.att_table(pairs(spark, sf), "spend").select(r("ate", 3).alias("ate"), r("se", 3).alias("se"), "n", r("ci_lower", 3).alias("ci_lower"))


def _balance_sql(x, c):
    return (f"SELECT '{c}' AS covariate, round(mt,4) AS mean_treated, round(mc,4) AS mean_control, round(abs(mt-mc)/sqrt((vt+vc)/2),6) AS smd_before, "
            f"round(abs(mat-mac)/sqrt((vat+vac)/2),6) AS smd_after FROM (SELECT avg({x}) FILTER (t=1) mt, avg({x}) FILTER (t=0) mc, var_samp({x}) FILTER (t=1) vt, "
            f"var_samp({x}) FILTER (t=0) vc FROM sp), (SELECT avg(t{x}) mat, avg(c{x}) mac, var_samp(t{x}) vat, var_samp(c{x}) vac FROM pr)")


_BAL = " UNION ALL ".join(_balance_sql(x, c) for x, c in (("a", "c_acctbal"), ("n", "c_nationkey"), ("s", "spend")))


@query("G15_balance", f"{_PAIRS}, bal AS ({_BAL}) SELECT *, smd_after<smd_before AS improved, smd_after<0.1 AS balanced FROM bal")
def balance(spark, sf):
    b = psm.balance(scored(spark, sf), pairs(spark, sf), "t", ["c_acctbal", "c_nationkey", "spend"])
    return b.withColumns({"mean_treated": r("mean_treated"), "mean_control": r("mean_control"), "smd_before": r("smd_before", 6), "smd_after": r("smd_after", 6)})


@query("G16_common_support", """WITH u AS (SELECT *, CAST(c_mktsegment='BUILDING' AS INTEGER) t FROM customer), l AS (SELECT greatest(min(c_acctbal) FILTER (t=1),min(c_acctbal) FILTER (t=0)) lo,
 least(max(c_acctbal) FILTER (t=1),max(c_acctbal) FILTER (t=0)) hi FROM u) SELECT c_custkey, t FROM u, l WHERE c_acctbal BETWEEN lo AND hi""")
def common_support(spark, sf):
    return psm.common_support(scored(spark, sf), "t", "c_acctbal").select("c_custkey", "t")


@query("G17_love_table", f"{_PAIRS}, bal AS ({_BAL}) SELECT covariate, smd_before, smd_after FROM bal WHERE covariate<>'spend'")
def love_table(spark, sf):
    b = psm.balance(scored(spark, sf), pairs(spark, sf), "t", ["c_acctbal", "c_nationkey", "spend"])
    before, after = b.select("covariate", r("smd_before", 6).alias("smd_before")), b.select("covariate", r("smd_after", 6).alias("smd_after"))
    return psm.love_table(before, after.filter("covariate <> 'spend'"))


@query("G18_diff_in_diff", f"""WITH {DID}, c AS (SELECT treated, post, avg(o_totalprice) mu, count(*) n, sum(o_totalprice*o_totalprice)-count(*)*avg(o_totalprice)*avg(o_totalprice) ss FROM f GROUP BY 1,2),
 s AS (SELECT sum(ss)/(sum(n)-4) AS s2, sum(1.0/n) AS inv FROM c)
SELECT 'diff_in_diff' AS method, round(sum(CASE WHEN treated=post THEN mu ELSE -mu END),2) AS ate, round(any_value(sqrt(s2*inv)),2) AS se, CAST(sum(n) AS BIGINT) AS n FROM c, s""")
def diff_in_diff(spark, sf):
    fit = dd.did(did_orders(spark, sf), "o_totalprice", "is_building", "day")
    return fit.estimate(spark, "o_totalprice", "is_building", "treat_post").select("method", r("ate", 2).alias("ate"), r("se", 2).alias("se"), "n")


_PRE_CTE, _PRE_SEL = ols_term("pre", "o_totalprice", ["treated", "t", "treated*t"], "treated*t", "z")


@query("G19_parallel_trends", f"WITH {DID}, pre AS (SELECT *, CAST(day-DATE '1995-01-01' AS DOUBLE) AS t FROM f WHERE post=0), {_PRE_CTE}, q AS ({_PRE_SEL}) "
       "SELECT 'pre_trend_slope' AS name, round(coef,5) AS value FROM q UNION ALL SELECT 'pre_trend_se', round(se,5) FROM q")
def parallel_trends(spark, sf):
    frame = dd.did_frame(did_orders(spark, sf), "is_building", "day").withColumn("t", F.datediff("day", F.lit("1995-01-01").cast("date")).cast("double"))
    fit = gram.ols(frame, "o_totalprice", ["treated", "post", "treat_post"], "diff_in_diff")
    return dd.did_diagnostics(frame, fit, "o_totalprice", "t").filter(F.col("name").isin("pre_trend_slope", "pre_trend_se")).select("name", r("value", 5).alias("value"))


@query("G20_event_study", f"""WITH {DID}, c AS (SELECT CAST(year(day)-1998 AS INTEGER) AS period, avg(o_totalprice) FILTER (treated=1)-avg(o_totalprice) FILTER (treated=0) AS gap,
 var_samp(o_totalprice) FILTER (treated=1)/count(*) FILTER (treated=1)+var_samp(o_totalprice) FILTER (treated=0)/count(*) FILTER (treated=0) AS v FROM f GROUP BY 1)
SELECT c.period, round(c.gap-b.gap,3) AS coef, round(CASE WHEN c.period=-1 THEN 0 ELSE sqrt(c.v+b.v) END,3) AS se FROM c, (SELECT * FROM c WHERE period=-1) b""")
def event_study(spark, sf):
    df = did_orders(spark, sf).withColumn("period", F.year("day") - 1998)
    return dd.event_study(df, "period", "is_building", "o_totalprice", -1).select("period", r("coef", 3).alias("coef"), r("se", 3).alias("se"))


@query("G21_instrument_selection", f"WITH {BASKETS}, c AS (SELECT 'n_lines' AS instrument, abs(corr(qty,n_lines)) AS a FROM b UNION ALL SELECT 'disc', abs(corr(qty,disc)) FROM b UNION ALL SELECT 'tax', abs(corr(qty,tax)) FROM b) "
       "SELECT instrument, round(a,6) AS abs_corr, a=(SELECT max(a) FROM c) AS chosen FROM c")
def instrument_selection(spark, sf):
    b = baskets(spark, sf)
    best = iv.select_instrument(b, "qty", ["n_lines", "disc", "tax"])
    return iv.instrument_candidates(b, "qty", ["n_lines", "disc", "tax"]).select("instrument", r("abs_corr", 6).alias("abs_corr"), (F.col("instrument") == best).alias("chosen"))


_FS_CTE, _FS_SEL = ols_term("b", "qty", ["n_lines", "disc"], "n_lines", "z")


@query("G22_first_stage", f"WITH {BASKETS}, {_FS_CTE}, q AS ({_FS_SEL}) SELECT 'n_lines' AS term, round(coef,6) AS coef, round(se,6) AS se, round(pow(coef/se,2),2) AS partial_f, pow(coef/se,2)<10 AS weak FROM q")
def first_stage(spark, sf):
    fit, pf_ = iv.first_stage(baskets(spark, sf), "qty", "n_lines", ["disc"])
    return fit.coef_table(spark).filter("term = 'n_lines'").select("term", r("coef", 6).alias("coef"), r("se", 6).alias("se"), F.round(F.lit(pf_), 2).alias("partial_f"), F.lit(pf_ < 10).alias("weak"))


@query("G23_two_stage", f"""WITH {BASKETS}, c AS (SELECT price-avg(price) OVER () y, qty-avg(qty) OVER () t, n_lines-avg(n_lines) OVER () z, disc-avg(disc) OVER () x FROM b),
 o AS (SELECT y-x*(sum(x*y) OVER ()/sum(x*x) OVER ()) y, t-x*(sum(x*t) OVER ()/sum(x*x) OVER ()) t, z-x*(sum(x*z) OVER ()/sum(x*x) OVER ()) z FROM c),
 k AS (SELECT sum(z*y)/sum(z*t) AS beta, sum(z*t) AS zt FROM o)
SELECT 'qty' AS term, round(any_value(beta),4) AS coef, round(sqrt(sum(z*z*pow(y-beta*t,2)))/abs(any_value(zt)),4) AS se FROM o, k""")
def two_stage(spark, sf):
    fit = iv.two_stage(baskets(spark, sf), "price", "qty", "n_lines", ["disc"])[0]
    return fit.coef_table(spark).filter("term = 'qty'").select("term", r("coef").alias("coef"), r("se").alias("se"))


@query("G24_running_variable", "SELECT 'l_extendedprice' AS running, round(quantile_cont(l_extendedprice,0.5),4) AS cutoff FROM lineitem")
def running_variable(spark, sf):
    running, cutoff = rd.default_running(table(spark, sf, "lineitem"), ["l_returnflag", "l_extendedprice", "l_tax"], "l_quantity")
    return spark.createDataFrame([(running, round(cutoff, 4))], "running string, cutoff double")


_BW = "bw AS (SELECT 1.06*stddev_samp(l_extendedprice)*pow(count(*),-0.2)*2 AS h, quantile_cont(l_extendedprice,0.5) AS c FROM lineitem)"


@query("G25_bandwidth", f"WITH {_BW} SELECT round(h,4) AS bandwidth, count(*) FILTER (abs(l_extendedprice-c)<=h) AS n_inside FROM lineitem, bw GROUP BY h")
def bandwidth(spark, sf):
    li = table(spark, sf, "lineitem")
    h = rd.rot_bandwidth(li, "l_extendedprice", "l_quantity")
    c = rd.default_running(li, ["l_extendedprice"], "l_quantity")[1]
    return li.agg(F.count_if(F.abs(F.col("l_extendedprice") - c) <= h).alias("n_inside")).withColumn("bandwidth", F.round(F.lit(h), 4))


@query("G26_sharp_rdd", ols_sql(f"{_BW}, i AS (SELECT l_quantity AS y, l_extendedprice-c AS rc, CAST(l_extendedprice>=c AS INTEGER) AS above, (l_extendedprice-c)*CAST(l_extendedprice>=c AS INTEGER) AS inter "
                                "FROM lineitem, bw WHERE abs(l_extendedprice-c)<=h)", "i", "y", ["rc", "above", "inter"], "rdd", 6))
def sharp_rdd(spark, sf):
    li = table(spark, sf, "lineitem")
    running, cutoff = rd.default_running(li, ["l_extendedprice"], "l_quantity")
    return tidy(rd.rdd(li, "l_quantity", running, cutoff).fit.coef_table(spark), 6)


@query("G27_density", "WITH a AS (SELECT count(*) FILTER (l_extendedprice<40000) b, count(*) FILTER (l_extendedprice>=40000) a FROM lineitem) SELECT b AS below, a AS above, "
       "round((pow(b-(a+b)/2,2)+pow(a-(a+b)/2,2))/((a+b)/2),4) AS chi2, (pow(b-(a+b)/2,2)+pow(a-(a+b)/2,2))/((a+b)/2)>3.84 AS concern FROM a")
def density(spark, sf):
    return rd.density_chi2(table(spark, sf, "lineitem"), "l_extendedprice", 40000.0).withColumn("chi2", r("chi2"))


@query("G28_binned_scatter", "SELECT CAST(floor((l_extendedprice-40000)/2500) AS BIGINT) AS bin, count(*) AS n, round(avg(l_extendedprice),4) AS mean_running, round(avg(l_quantity),6) AS mean_outcome, "
       "floor((l_extendedprice-40000)/2500)>=0 AS above FROM lineitem GROUP BY 1,5")
def binned_scatter(spark, sf):
    b = rd.binned_scatter(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", 40000.0, 2500.0)
    return b.withColumns({"mean_running": r("mean_running"), "mean_outcome": r("mean_outcome", 6)})


@query("G29_folds", "SELECT CAST(o_orderkey%3 AS INTEGER) AS fold, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY 1")
def folds(spark, sf):
    return dml.with_folds(table(spark, sf, "orders"), "o_orderkey").groupBy("fold").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


def residuals(spark, sf):
    return dml.linear_residuals(dml.with_folds(baskets(spark, sf), "l_orderkey"), "price", "qty", ["n_lines"])


_RES = BASKETS + """, fit AS (SELECT f, regr_slope(price,n_lines) sy, regr_intercept(price,n_lines) iy, regr_slope(qty,n_lines) st, regr_intercept(qty,n_lines) it
 FROM b, (VALUES (0),(1),(2)) v(f) WHERE l_orderkey%3<>f GROUP BY 1),
 res AS (SELECT b.*, price-iy-sy*n_lines AS ry, qty-it-st*n_lines AS rt FROM b JOIN fit ON l_orderkey%3=f)"""


@query("G30_nuisance_linear", f"WITH {_RES} SELECT CAST(l_orderkey%3 AS INTEGER) AS fold, count(*) AS n, round(sum(ry*ry)/count(*),0) AS mse_y, round(sum(rt*rt)/count(*),4) AS mse_t FROM res GROUP BY 1")
def nuisance_linear(spark, sf):
    return residuals(spark, sf).groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(F.col("res_y") ** 2), 0).alias("mse_y"), F.round(F.avg(F.col("res_t") ** 2), 4).alias("mse_t"))


@query("G30_nuisance_boosted", f"WITH {BASKETS} SELECT CAST(l_orderkey%3 AS INTEGER) AS fold, count(*) AS n, true AS explains_y, true AS explains_t FROM b GROUP BY 1")
def nuisance_boosted(spark, sf):
    """Rows per fold, and that out-of-fold predictions leave less than half of the variance."""
    df = dml.with_folds(baskets(spark, sf), "l_orderkey")
    res = dml.boosted_residuals(df, "price", "qty", ["n_lines", "disc", "tax"])
    left = {c: F.avg(F.col(f"res_{k}") ** 2) < 0.5 * F.var_pop(v) for c, k, v in (("explains_y", "y", "price"), ("explains_t", "t", "qty"))}
    return res.groupBy("fold").agg(F.count("*").alias("n"), *[v.alias(c) for c, v in left.items()])


@query("G30_boosted_stump", f"""WITH {BASKETS}, long AS (SELECT l_orderkey%3 AS fold, n_lines AS x, unnest([0,1]) AS t, unnest([price, qty]) AS v FROM b),
 tr AS (SELECT f, t, x, v, avg(v) OVER (PARTITION BY f, t) AS m FROM long, (VALUES (0),(1),(2)) z(f) WHERE fold<>f),
 u AS (SELECT f, t, x, any_value(m) AS m, count(*) AS n, sum(v-m) AS g FROM tr GROUP BY 1, 2, 3),
 s AS (SELECT f, t, x, m, sum(n) OVER w AS nl, sum(g) OVER w AS gl, sum(n) OVER p AS nt, sum(g) OVER p AS gt FROM u WINDOW w AS (PARTITION BY f, t ORDER BY x), p AS (PARTITION BY f, t)),
 best AS (SELECT f, t, m, arg_max((x, gl/nl, (gt-gl)/(nt-nl)), gl*gl/nl+(gt-gl)*(gt-gl)/(nt-nl)) AS k FROM s WHERE nt>nl GROUP BY 1, 2, 3),
 res AS (SELECT fold, long.t, v-m-0.5*CASE WHEN x<=k[1] THEN k[2] ELSE k[3] END AS e FROM long JOIN best ON best.f=fold AND best.t=long.t)
SELECT CAST(fold AS INTEGER) AS fold, count(*)//2 AS n, round(avg(e*e) FILTER (t=0),0) AS mse_y, round(avg(e*e) FILTER (t=1),4) AS mse_t FROM res GROUP BY 1""")
def boosted_stump(spark, sf):
    """One tree of one split at rate 1/2: what it leaves out of fold."""
    df = dml.with_folds(baskets(spark, sf), "l_orderkey")
    res = dml.boosted_residuals(df, "price", "qty", ["n_lines"], trees=1, depth=1, rate=0.5)
    return res.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(F.col("res_y") ** 2), 0).alias("mse_y"), F.round(F.avg(F.col("res_t") ** 2), 4).alias("mse_t"))


_THETA = "round(sum(ry*rt)/sum(rt*rt),4) AS ate, round(sqrt(sum(rt*rt*pow(ry-th*rt,2)))/sum(rt*rt),4) AS se"


@query("G31_dml_ate", f"WITH {_RES}, t AS (SELECT sum(ry*rt)/sum(rt*rt) AS th FROM res) SELECT 'double_ml' AS method, {_THETA}, count(*) AS n FROM res, t")
def dml_ate(spark, sf):
    return dml.dml_estimate(residuals(spark, sf), "price", "qty").select("method", r("ate").alias("ate"), r("se").alias("se"), "n")


@query("G32_linear_cate", f"""WITH {_RES}, g AS (SELECT sum(rt*rt) a, sum(rt*rt*n_lines) b, sum(rt*rt*n_lines*n_lines) c, sum(rt*ry) p, sum(rt*n_lines*ry) q FROM res),
 k AS (SELECT a,b,c,(c*p-b*q)/(a*c-b*b) AS t0,(a*q-b*p)/(a*c-b*b) AS t1, a*c-b*b AS det FROM g),
 h AS (SELECT sum(rt*rt*pow(e,2)) m00, sum(rt*rt*n_lines*pow(e,2)) m01, sum(rt*rt*n_lines*n_lines*pow(e,2)) m11 FROM (SELECT rt, n_lines, ry-t0*rt-t1*rt*n_lines AS e FROM res, k))
SELECT 'base' AS term, round(t0,4) AS coef, round(sqrt((c*c*m00-2*b*c*m01+b*b*m11)/(det*det)),4) AS se FROM k, h
 UNION ALL SELECT 'n_lines', round(t1,4), round(sqrt((b*b*m00-2*a*b*m01+a*a*m11)/(det*det)),4) FROM k, h""")
def linear_cate(spark, sf):
    return dml.linear_cate(residuals(spark, sf), ["n_lines"]).coef_table(spark).select("term", r("coef").alias("coef"), r("se").alias("se"))


@query("G33_forest_cate")
def forest_cate(spark, sf):
    """Effects of the whole honest forest, by number of lines."""
    res = dml.linear_residuals(dml.with_folds(baskets(spark, sf), "l_orderkey"), "price", "qty", ["n_lines", "disc", "tax"])
    out, _ = dml.forest_cate(res, ["n_lines", "disc", "tax"], "l_orderkey")
    return out.groupBy("n_lines").agg(F.count("cate").alias("n"), r(F.avg("cate"), 2).alias("effect"), F.count_if((F.col("cate_lower") > 0) | (F.col("cate_upper") < 0)).alias("n_significant"))


@query("G33_honest_tree", f"""WITH {_RES}, c AS (SELECT l_orderkey%2 AS half, ry*rt AS a, rt*rt AS b, unnest([0,1]) AS f, unnest([n_lines, tax]) AS x FROM res),
 th AS (SELECT sum(a)/sum(b) AS th FROM c WHERE half=0 AND f=0), u AS (SELECT f, x, count(*) AS n, sum(a-th*b) AS g FROM c, th WHERE half=0 GROUP BY 1, 2),
 s AS (SELECT f, x, sum(n) OVER w AS nl, sum(g) OVER w AS gl, sum(n) OVER (PARTITION BY f) AS nt, sum(g) OVER (PARTITION BY f) AS gt FROM u WINDOW w AS (PARTITION BY f ORDER BY x)),
 best AS (SELECT f, x AS cut FROM s WHERE nl>=20 AND nt-nl>=20 ORDER BY gl*gl/nl+(gt-gl)*(gt-gl)/(nt-nl) DESC, f, x LIMIT 1)
SELECT CASE any_value(c.f) WHEN 0 THEN 'n_lines' ELSE 'tax' END AS feature, round(any_value(cut),4) AS cut, x>cut AS above, CAST(count(*) AS INTEGER) AS n, round(sum(a)/sum(b),4) AS effect
 FROM c JOIN best ON c.f=best.f WHERE half=1 GROUP BY x>cut""")
def honest_tree(spark, sf):
    """One split chosen by the even orders, effects of its two leaves from the odd ones."""
    tree = honest_forest(residuals(spark, sf), ["n_lines", "tax"], F.col("l_orderkey"), trees=1, depth=1, min_leaf=20, share=1.0, half=F.col("l_orderkey") % 2)
    rows = [(*path[0], n, effect) for _, n, effect, path in tree.leaves()]
    return spark.createDataFrame(rows, "feature string, cut double, above boolean, n int, effect double").withColumns({"cut": r("cut"), "effect": r("effect")})


@query("G34_segment_cate", f"WITH {_RES}, s AS (SELECT o_orderpriority AS segment, ry, rt FROM res JOIN orders ON o_orderkey=l_orderkey), t AS (SELECT segment, sum(ry*rt)/sum(rt*rt) AS th FROM s GROUP BY 1) "
       f"SELECT segment, count(*) AS n, {_THETA} FROM s JOIN t USING (segment) GROUP BY 1")
def segment_cate(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("segment"))
    return dml.residual_effect(residuals(spark, sf).join(o, "l_orderkey"), "segment").select("segment", "n", r("ate").alias("ate"), r("se").alias("se"))


@query("G4_run_diagnostics", f"""WITH {_RM} SELECT 'pre_trend_slope' AS name, round(max(k) FILTER (big=1)-max(k) FILTER (big=0),3) AS value
 FROM (SELECT big, regr_slope(price, day-DATE '1970-01-01') AS k FROM d, md WHERE day<dd GROUP BY 1)
 UNION ALL SELECT 'density_chi2', round((pow(b-(a+b)/2,2)+pow(a-(a+b)/2,2))/((a+b)/2),3) FROM (SELECT CAST(count(*) FILTER (qty<100) AS DOUBLE) AS b, CAST(count(*) FILTER (qty>=100) AS DOUBLE) AS a FROM d)""")
def run_diagnostics(spark, sf):
    """Checks that come with the methods of a run."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("day"))
    df = baskets(spark, sf).join(o, "l_orderkey").withColumn("big", (F.col("qty") > 100).cast("int"))
    req = sel.CausalRequest("price", "big", ["n_lines", "disc"], key="l_orderkey", time="day", running="qty", cutoff=100.0)
    found = sel.run_all(df, req, ["DID", "rdd"]).diagnostics
    return found.filter(F.col("name").isin("pre_trend_slope", "density_chi2")).select("name", r("value", 3).alias("value"))


_WIDE = 120


@query("G5_wide_moments", "WITH m AS (SELECT " + ", ".join(f"avg(l_partkey%{i + 3}) AS m{i}, covar_pop(l_quantity, l_partkey%{i + 3}) AS v{i}" for i in range(_WIDE)) + " FROM lineitem) SELECT unnest(["
       + ", ".join(f"'k{i}'" for i in range(_WIDE)) + "]) AS term, round(unnest([" + ", ".join(f"m{i}" for i in range(_WIDE)) + "]),6) AS mean, round(unnest(["
       + ", ".join(f"v{i}" for i in range(_WIDE)) + "]),6) AS cov FROM m")
def wide_moments(spark, sf):
    """Means of 120 columns and their covariances with one more."""
    df = table(spark, sf, "lineitem").select("l_quantity", *[(F.col("l_partkey") % (i + 3)).alias(f"k{i}") for i in range(_WIDE)])
    m = gram.moments(df, df.columns)
    rows = [(c, float(m.mean[i]), float(m.cross[0, i] / m.n)) for i, c in enumerate(m.cols) if i]
    return spark.createDataFrame(rows, "term string, mean double, cov double").withColumns({"mean": r("mean", 6), "cov": r("cov", 6)})


@query("G35_effect_matrix")
def effect_matrix(spark, sf):
    b = baskets(spark, sf).persist()
    ests = []
    for t in ("qty", "disc"):
        for y in ("price", "tax"):
            req = sel.CausalRequest(y, t, ["n_lines", "supp"], key="l_orderkey")
            ests.append(sel.run_methods(b, req, ["double_ml", "propensity_score"])[0])
    out = sel.effect_matrix(reduce(lambda a, c: a.unionByName(c), ests))
    b.unpersist()
    return out.withColumns({"double_ml_ate": r("double_ml_ate", 2), "propensity_score_ate": r("propensity_score_ate", 2)})


_IX = ols_sql(f"{BASKETS}, x AS (SELECT price, qty, disc*100 AS d, qty*disc*100 AS qd FROM b)", "x", "price", ["qty", "d", "qd"], "interaction", 3)


@query("G36_effect_independence", f"SELECT * FROM ({_IX}) WHERE term='qd'")
def effect_independence(spark, sf):
    b = baskets(spark, sf).withColumns({"d": F.col("disc") * 100, "qd": F.col("qty") * F.col("disc") * 100})
    return tidy(gram.ols(b, "price", ["qty", "d", "qd"], "interaction").coef_table(spark), 3).filter("term = 'qd'")


_V = ["disc", "n_lines", "price", "qty", "tax"]
_CORR = "cr AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{c}' AS b, corr({a},{c}) AS r FROM b" for i, a in enumerate(_V) for c in _V[i + 1:]) + ")"


@query("G37_correlation_graph", f"WITH {BASKETS}, {_CORR} SELECT a, b, round(r,6) AS r FROM cr WHERE abs(r)>0.3")
def correlation_graph(spark, sf):
    return dag.correlation_edges(baskets(spark, sf), _V).withColumn("r", r("r", 6))


def _z(expr, given):
    return f"abs(atanh({expr}))*sqrt((SELECT count(*) FROM b)-{given}-3)>1.959963984540054"


_P1 = "(ab.r-ak.r*bk.r)/sqrt((1-ak.r*ak.r)*(1-bk.r*bk.r))"
_PC = f"""{_CORR}, cc AS (SELECT a,b,r FROM cr UNION ALL SELECT b,a,r FROM cr), e0 AS (SELECT a,b,r FROM cr WHERE {_z('r', 0)}),
 a0 AS (SELECT a,b FROM e0 UNION ALL SELECT b,a FROM e0),
 k1 AS (SELECT DISTINCT e.a, e.b, x.b AS k FROM e0 e JOIN a0 x ON (x.a=e.a OR x.a=e.b) WHERE x.b<>e.a AND x.b<>e.b),
 c1 AS (SELECT k1.a, k1.b FROM k1 JOIN cc ab ON ab.a=k1.a AND ab.b=k1.b JOIN cc ak ON ak.a=k1.a AND ak.b=k JOIN cc bk ON bk.a=k1.b AND bk.b=k WHERE NOT ({_z(_P1, 1)})),
 e1 AS (SELECT * FROM e0 WHERE (a,b) NOT IN (SELECT (a,b) FROM c1)),
 a1 AS (SELECT a,b FROM e1 UNION ALL SELECT b,a FROM e1),
 k2 AS (SELECT DISTINCT e.a, e.b, x.b AS k, y.b AS l FROM e1 e JOIN a1 x ON (x.a=e.a OR x.a=e.b) JOIN a1 y ON y.a=x.a WHERE x.b<y.b AND x.b NOT IN (e.a,e.b) AND y.b NOT IN (e.a,e.b)),
 p2 AS (SELECT k2.*, {_P1} AS abk, (al.r-ak.r*kl.r)/sqrt((1-ak.r*ak.r)*(1-kl.r*kl.r)) AS alk, (bl.r-bk.r*kl.r)/sqrt((1-bk.r*bk.r)*(1-kl.r*kl.r)) AS blk FROM k2
  JOIN cc ab ON ab.a=k2.a AND ab.b=k2.b JOIN cc ak ON ak.a=k2.a AND ak.b=k JOIN cc bk ON bk.a=k2.b AND bk.b=k JOIN cc al ON al.a=k2.a AND al.b=l
  JOIN cc bl ON bl.a=k2.b AND bl.b=l JOIN cc kl ON kl.a=k AND kl.b=l),
 c2 AS (SELECT a,b FROM p2 WHERE NOT ({_z('(abk-alk*blk)/sqrt((1-alk*alk)*(1-blk*blk))', 2)}))"""


@query("G38_pc_skeleton", f"WITH {BASKETS}, {_PC} SELECT a, b, round(r,6) AS r FROM e1 WHERE (a,b) NOT IN (SELECT (a,b) FROM c2)")
def pc_skeleton(spark, sf):
    return dag.pc_skeleton(baskets(spark, sf), _V)[0].withColumn("r", r("r", 6))


_ROUND = """,
 o{k} AS (SELECT x, y FROM adj WHERE (x,y) NOT IN (SELECT (x,y) FROM d{k}) AND (y,x) NOT IN (SELECT (x,y) FROM d{k}) AND (x,y) NOT IN (SELECT (x,y) FROM cf)),
 n{k} AS (SELECT DISTINCT o.x, o.y FROM o{k} o WHERE EXISTS (SELECT 1 FROM d{k} w WHERE w.y=o.x AND w.x<>o.y AND (w.x,o.y) NOT IN (SELECT (x,y) FROM adj))
  OR EXISTS (SELECT 1 FROM d{k} f JOIN d{k} g ON f.y=g.x WHERE f.x=o.x AND g.y=o.y)
  OR EXISTS (SELECT 1 FROM d{k} c JOIN d{k} e ON c.y=e.y AND c.x<e.x WHERE c.y=o.y AND (o.x,c.x) IN (SELECT (x,y) FROM o{k}) AND (o.x,e.x) IN (SELECT (x,y) FROM o{k})
   AND (c.x,e.x) NOT IN (SELECT (x,y) FROM adj))),
 d{j} AS (SELECT x, y FROM d{k} UNION SELECT x, y FROM n{k} n WHERE x<y OR (y,x) NOT IN (SELECT (x,y) FROM n{k}))"""
# a round that orients anything orients one of at most ten edges
_ORIENT = f"""WITH {BASKETS}, {_PC}, e2 AS (SELECT a, b, r FROM e1 WHERE (a,b) NOT IN (SELECT (a,b) FROM c2)),
 adj AS (SELECT a AS x, b AS y FROM e2 UNION ALL SELECT b, a FROM e2),
 sep AS (SELECT a, b, '' AS given FROM cr WHERE (a,b) NOT IN (SELECT (a,b) FROM e0)
  UNION ALL SELECT k1.a, k1.b, min(k) FROM k1 JOIN cc ab ON ab.a=k1.a AND ab.b=k1.b JOIN cc ak ON ak.a=k1.a AND ak.b=k JOIN cc bk ON bk.a=k1.b AND bk.b=k WHERE NOT ({_z(_P1, 1)}) GROUP BY 1, 2
  UNION ALL SELECT a, b, min(k || ',' || l) FROM p2 WHERE NOT ({_z('(abk-alk*blk)/sqrt((1-alk*alk)*(1-blk*blk))', 2)}) GROUP BY 1, 2),
 v AS (SELECT p.x AS a, q.x AS b, p.y AS via FROM adj p JOIN adj q ON p.y=q.y AND p.x<q.x JOIN sep s ON s.a=p.x AND s.b=q.x
  WHERE (p.x,q.x) NOT IN (SELECT (x,y) FROM adj) AND NOT list_contains(string_split(given, ','), p.y)),
 h AS (SELECT a AS x, via AS y FROM v UNION SELECT b, via FROM v),
 cf AS (SELECT p.x, p.y FROM h p JOIN h q ON p.x=q.y AND p.y=q.x),
 d0 AS (SELECT x, y FROM h WHERE (x,y) NOT IN (SELECT (x,y) FROM cf)){"".join(_ROUND.format(k=k, j=k + 1) for k in range(5))}
SELECT CASE WHEN (b,a) IN (SELECT (x,y) FROM d5) THEN b ELSE a END AS src, CASE WHEN (b,a) IN (SELECT (x,y) FROM d5) THEN a ELSE b END AS dst, round(r,6) AS weight,
 CASE WHEN (a,b) IN (SELECT (x,y) FROM cf) THEN 'conflict' WHEN (a,b) IN (SELECT (x,y) FROM d5) OR (b,a) IN (SELECT (x,y) FROM d5) THEN 'directed' ELSE 'undirected' END AS kind FROM e2"""


@query("G38_pc_orientation", _ORIENT)
def pc_orientation(spark, sf):
    edges, seps = dag.pc_skeleton(baskets(spark, sf), _V)
    return dag.orient(edges, seps).withColumn("weight", r("weight", 6))


@query("G39_lingam_order")
def lingam_order(spark, sf):
    return dag.lingam_order(baskets(spark, sf), ["n_lines", "qty", "price"])


@query("G39_lingam_edges")
def lingam_edges(spark, sf):
    return dag.lingam_edges(baskets(spark, sf), ["n_lines", "qty", "price"]).withColumn("weight", r("weight", 3))


@query("G40_bootstrap_edges")
def bootstrap_edges(spark, sf):
    return dag.bootstrap_edges(baskets(spark, sf), "l_orderkey", _V).withColumns({"mean_r": r("mean_r", 3)})


@query("G41_calibration_multipliers", f"WITH {_RES}, t AS (SELECT sum(ry*rt)/sum(rt*rt) AS th FROM res) SELECT 'qty' AS treatment, 'price' AS outcome, round(any_value(th),4) AS ate, round(any_value(th)*10000,0) AS ate_per_unit FROM res, t")
def calibration_multipliers(spark, sf):
    return sel.calibration_multipliers(dml.dml_estimate(residuals(spark, sf), "price", "qty")).select(
        "treatment", "outcome", r("ate").alias("ate"), r("ate_per_unit", 0).alias("ate_per_unit"))


@query("F1_rank_methods", "WITH t AS (SELECT o_orderpriority AS method, sum(o_totalprice) AS score FROM orders GROUP BY 1) SELECT method, round(score,2) AS score, CAST(rk AS INTEGER) AS rank "
       "FROM (SELECT *, row_number() OVER (ORDER BY score DESC, method) rk, max(score) OVER () b FROM t) WHERE score>=b*0.3 AND rk<=3")
def rank_methods(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.sum("o_totalprice").alias("score"))
    return sel.select_methods(s.withColumn("ord", F.col("method"))).select("method", r("score", 2).alias("score"), "rank")
