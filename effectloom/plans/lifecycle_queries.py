"""Customer-lifecycle queries: profiles, policies, gaps, churn, experiments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import bands
from ..sources.workspace import materialize
from ..operators import churn as ch
from ..operators import customer as cu
from ..operators import gaps as gp
from ..operators import messages as ms
from ..operators import policy as po
from ..operators.profiling import with_rollup
from .inputs import ASOF, COVERAGE, CUSTOMERS, EVENTS_ASOF, POLICIES, PRODUCTS, coverage, customers, policies, r, table
from .registry import query

def up(col, n: int = 4):
    """Round with a guard: exact half-way values, off by an ulp, go up on both sides."""
    return F.round((F.col(col) if isinstance(col, str) else col) + F.lit(1e-7), n)


A, E = f"DATE '{ASOF}'", f"DATE '{EVENTS_ASOF}'"
SHIFT = 8766  # days from the order years to the event month


def shifted(spark, sf):
    return policies(spark, sf).withColumns({"effective_date": F.date_add("effective_date", SHIFT), "expiry_date": F.date_add("expiry_date", SHIFT)})


_TIER = "CASE WHEN d<=7 THEN 'active' WHEN d<=30 THEN 'regular' WHEN d<=90 THEN 'infrequent' ELSE 'dormant' END"
_EV = f"""ev AS (SELECT user_id, {E}-CAST(max(ts) AS DATE) AS d, count(*) FILTER (event_type='signup') AS tr, count(*) FILTER ({E}-CAST(ts AS DATE)<30) AS n30 FROM events WHERE CAST(ts AS DATE)<={E} GROUP BY 1),
 tops AS (SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS top3 FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) rk
  FROM events WHERE CAST(ts AS DATE)<={E} GROUP BY 1,2) WHERE rk<=3 GROUP BY 1)"""
_NEEDS = """concat_ws(',', CASE WHEN sum_medical<500000 THEN '医疗刚需' END, CASE WHEN sum_critical_illness<300000 THEN '大病保障' END,
 CASE WHEN children>0 AND sum_life<income*5 THEN '家庭责任' END, CASE WHEN age>=35 AND sum_annuity<=0 THEN '养老储蓄' END,
 CASE WHEN children>0 AND sum_annuity<=0 THEN '子女规划' END, CASE WHEN travel_events>0 AND sum_accident<=0 THEN '出行保障' END)"""


@query("H1_profiles", f"""WITH {CUSTOMERS}, {POLICIES}, {_EV}, p AS (SELECT user_id, count(*) AS pc, sum(premium) AS tp, """ + ", ".join(
    f"coalesce(sum(sum_insured) FILTER (live AND product='{x}'),0) AS sum_{x}" for x in PRODUCTS) + f""", count(*) FILTER (live) AS ac
 FROM (SELECT *, effective_date+{SHIFT}<={E} AND expiry_date+{SHIFT}>={E} AS live FROM policies) GROUP BY 1),
 j AS (SELECT c.*, coalesce(pc,0) pc, coalesce(ac,0) ac, coalesce(tp,0) tp, """ + ", ".join(f"coalesce(sum_{x},0) AS sum_{x}" for x in PRODUCTS) + f""", d, coalesce(tr,0) AS travel_events, coalesce(n30,0) n30, top3
 FROM customers c LEFT JOIN p USING (user_id) LEFT JOIN ev USING (user_id) LEFT JOIN tops USING (user_id))
SELECT user_id, 'v{EVENTS_ASOF.replace('-', '')}_001' AS version, age, pc AS policy_count, ac AS active_count, round(tp,4) AS total_premium, round(sum_medical,2) AS medical_sum,
 n30 AS n_30d, coalesce(top3,'-') AS top_types, CASE WHEN d IS NULL THEN 'missing' ELSE {_TIER} END AS activity_tier,
 round(least(100.0, greatest(0.0,60.0-coalesce(d,9999)*60.0/90.0)+least(n30,40)*1.0),6) AS dormancy_score,
 CASE WHEN n30>=5 AND d<=7 THEN 'high' WHEN n30>=1 AND d<=30 THEN 'medium' ELSE 'low' END AS intent_level, {_NEEDS} AS need_tags FROM j""")
def profiles(spark, sf):
    p = cu.build_profiles(customers(spark, sf), shifted(spark, sf), table(spark, sf, "events"), EVENTS_ASOF, travel_kinds=["signup"])
    b, i = "behavior_tags", "insurance_tags"
    return p.select("user_id", "version", F.col("basic_tags.age").alias("age"), F.col(f"{i}.policy_count").alias("policy_count"),
                    F.col(f"{i}.active_count").alias("active_count"), r(F.col(f"{i}.total_premium")).alias("total_premium"),
                    F.round(F.coalesce(F.col(f"{i}.coverage_matrix")["medical"]["sum_insured"], F.lit(0.0)), 2).alias("medical_sum"), F.col(f"{b}.n_30d").alias("n_30d"),
                    F.coalesce(F.array_join(F.array_sort(F.map_keys(f"{b}.top_event_types")), ","), F.lit("-")).alias("top_types"),
                    F.col(f"{b}.activity_tier").alias("activity_tier"), r(F.col(f"{b}.dormancy_score"), 6).alias("dormancy_score"),
                    F.col(f"{b}.intent_level").alias("intent_level"), F.array_join(F.transform("need_tags", lambda t: t["tag"]), ",").alias("need_tags"))


@query("H1_health_layer", f"""WITH {CUSTOMERS}, h AS (SELECT user_id, CASE WHEN user_id%5<>0 THEN 18.0+user_id%17 END AS bmi, CASE WHEN user_id%4<2 THEN CASE WHEN user_id%3=0 THEN 'yes' ELSE 'no' END END AS smoker,
 CASE WHEN user_id%20<>0 AND user_id%4<>3 THEN segment END AS last_result FROM customers), f AS (SELECT *, ((bmi IS NOT NULL)::INT+(smoker IS NOT NULL)::INT+(last_result IS NOT NULL)::INT)/3.0::DOUBLE AS s FROM h)
SELECT user_id, CAST(bmi AS DOUBLE) AS bmi, smoker, round(s,4) AS data_completeness, CASE WHEN s=0 THEN 'missing' WHEN s<1 THEN 'partial' ELSE 'complete' END AS status FROM f""")
def health_layer(spark, sf):
    k = F.col("user_id")
    c = customers(spark, sf).withColumns({
        "bmi": F.when(k % 5 != 0, 18.0 + k % 17), "smoker": F.when(k % 4 < 2, F.when(k % 3 == 0, "yes").otherwise("no")),
        "last_result": F.when((k % 20 != 0) & (k % 4 != 3), F.col("segment"))})
    p = cu.build_profiles(c, shifted(spark, sf), table(spark, sf, "events"), EVENTS_ASOF, health_fields=["bmi", "smoker", "last_result"])
    return p.select("user_id", "health_tags.bmi", "health_tags.smoker", r(F.col("health_tags.data_completeness")).alias("data_completeness"), "health_tags.status")


@query("H2_rfm_segments", f"""WITH {CUSTOMERS}, {POLICIES}, {_EV}, p AS (SELECT user_id, count(*) n, sum(premium) m FROM policies GROUP BY 1)
SELECT user_id, CASE WHEN coalesce(d<=90,false) AND n>=3 AND m>20000 THEN 'high_value' WHEN coalesce(d<=90,false) THEN 'potential' WHEN n>=3 AND m>20000 THEN 'at_risk' ELSE 'dormant' END AS rfm_segment
 FROM (SELECT c.user_id, d, coalesce(n,0) n, coalesce(m,0) m FROM customers c LEFT JOIN p USING (user_id) LEFT JOIN ev USING (user_id))""")
def rfm_segments(spark, sf):
    c = with_rollup(customers(spark, sf).select("user_id"), policies(spark, sf), "user_id", "user_id", {"n": F.count("*"), "m": F.sum("premium")})
    c = c.join(cu.behaviour_rollup(table(spark, sf, "events"), EVENTS_ASOF).select("user_id", "days_since"), "user_id", "left")
    return cu.rfm(c, "days_since", "n", "m").select("user_id", "rfm_segment")


@query("H3_life_stage", f"WITH {CUSTOMERS} SELECT user_id, CASE WHEN age<28 THEN '单身期' WHEN age<35 THEN '家庭形成期' WHEN age<50 THEN '家庭成长期' WHEN age<65 THEN '家庭成熟期' ELSE '退休期' END AS stage FROM customers")
def life_stage(spark, sf):
    return customers(spark, sf).select("user_id", bands.life_stage(F.col("age")).alias("stage"))


def tagged(spark, sf):
    return cu.need_tags(coverage(spark, sf).withColumn("travel_events", F.col("complaints")))


_TAGGED = COVERAGE + ", tagged AS (SELECT *, complaints AS travel_events FROM coverage)"


@query("H4_need_tags", f"""WITH {_TAGGED} SELECT user_id, {_NEEDS} AS tags, round(CASE WHEN sum_medical>=500000 THEN 0.0::DOUBLE WHEN sum_medical<=0 THEN 0.95 ELSE 0.6 END,2) AS medical_confidence FROM tagged""")
def need_tags(spark, sf):
    med = F.filter("need_tags", lambda t: t["tag"] == "医疗刚需")
    return tagged(spark, sf).select(
        "user_id", F.array_join(F.transform("need_tags", lambda t: t["tag"]), ",").alias("tags"),
        F.coalesce(F.try_element_at(F.transform(med, lambda t: t["confidence"]), F.lit(1)), F.lit(0.0)).alias("medical_confidence"))


@query("H5_tag_freshness", f"""SELECT user_id, event_type AS tag, CAST(CAST(max(ts) AS DATE)+CAST(7+user_id%20 AS INTEGER) AS VARCHAR) AS expires_on, CAST(max(ts) AS DATE)+CAST(7+user_id%20 AS INTEGER)<{E} AS expired FROM events GROUP BY user_id, event_type""")
def tag_freshness(spark, sf):
    t = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("tag")).agg(F.max("ts").alias("updated_at")).withColumn(
        "ttl_days", (F.col("user_id") % 20 + 7).cast("int"))
    return cu.tag_freshness(t, EVENTS_ASOF).select("user_id", "tag", F.date_format("expires_on", "yyyy-MM-dd").alias("expires_on"), "expired")


@query("H6_incremental_refresh", "SELECT user_id, count(*) AS n, round(sum(premium),4) AS premium FROM (WITH " + POLICIES + " SELECT * FROM policies) GROUP BY 1")
def incremental_refresh(spark, sf):
    p = policies(spark, sf)
    build = lambda d: d.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("premium").alias("premium"))
    cut = F.lit("2001-01-01").cast("date")
    changed = p.filter(F.col("effective_date") >= cut)
    affected = p.join(changed.select("user_id").distinct(), "user_id", "left_semi")
    return cu.refresh_profiles(build(p.filter(F.col("effective_date") < cut)), build(affected), changed).withColumn("premium", r("premium"))


@query("H7_propensity", f"""WITH {CUSTOMERS}, p AS (SELECT o_custkey, count(*) n FROM orders GROUP BY 1)
SELECT user_id, round(1/(1+exp(-(-0.5+0.4*CASE WHEN engagement>=80 THEN 4 WHEN engagement>=55 THEN 3 WHEN engagement>=30 THEN 2 WHEN engagement>=10 THEN 1 ELSE 0 END+0.3*ln(greatest(coalesce(n,0),1))))),8) AS renewal_propensity,
 round(1/(1+exp(-(-2.0+0.5*ln(greatest(coalesce(n,0),1))+0.3*ln(greatest(income,1.0))))),8) AS upsell_propensity FROM customers LEFT JOIN p ON user_id=o_custkey""")
def propensity(spark, sf):
    c = with_rollup(customers(spark, sf), table(spark, sf, "orders"), "user_id", "o_custkey", {"n": F.count("*")})
    return cu.propensities(c, "engagement", "n", "income").select("user_id", r("renewal_propensity", 8).alias("renewal_propensity"), r("upsell_propensity", 8).alias("upsell_propensity"))


@query("H8_risk_level", f"""WITH {CUSTOMERS}, s AS (SELECT user_id, occupation_class*15+(age>55)::INT*20+(complaints>2)::INT*15 AS score FROM customers)
SELECT user_id, score, CASE WHEN score<25 THEN '低风险' WHEN score<40 THEN '中低风险' WHEN score<55 THEN '中风险' WHEN score<70 THEN '中高风险' ELSE '高风险' END AS risk FROM s""")
def risk_level(spark, sf):
    s = bands.risk_score(F.col("occupation_class"), F.col("age"), F.col("complaints"))
    return customers(spark, sf).select("user_id", s.alias("score"), bands.risk_level(s).alias("risk"))


@query("H9_activation_list", f"""WITH {CUSTOMERS}, {_EV}, s AS (SELECT c.user_id, least(100.0, greatest(0.0,60.0-coalesce(d,9999)*60.0/90.0)+least(coalesce(n30,0),40)*1.0) AS ds FROM customers c LEFT JOIN ev USING (user_id))
SELECT user_id, round(ds,6) AS dormancy_score FROM s WHERE ds<=30 AND user_id NOT IN (SELECT o_custkey FROM orders WHERE {A}-CAST(o_orderdate AS DATE) BETWEEN 0 AND 29)""")
def activation_list(spark, sf):
    b = cu.behaviour_rollup(table(spark, sf, "events"), EVENTS_ASOF).select("user_id", "days_since", "n_30d")
    p = customers(spark, sf).select("user_id").join(b, "user_id", "left").select("user_id", cu.dormancy_score(F.col("days_since"), F.col("n_30d")).alias("dormancy_score"))
    contacts = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("contact_ts"))
    return cu.activation_list(p, contacts, ASOF).withColumn("dormancy_score", r("dormancy_score", 6))


_STATE = f"""CASE WHEN status='surrendered' THEN 'other' WHEN effective_date>{A} THEN 'pending' WHEN expiry_date-{A}>=0 THEN 'active' WHEN expiry_date-{A}>=-60 THEN 'grace' ELSE 'terminated' END"""


@query("H10_policy_state", f"WITH {POLICIES} SELECT policy_id, CAST(expiry_date-{A} AS BIGINT) AS days_to_expiry, CAST(greatest({A}-expiry_date,0) AS BIGINT) AS days_past_expiry, product IN ('medical','accident') AS is_short_term, {_STATE} AS inferred_state FROM policies")
def policy_state(spark, sf):
    return po.policy_state(policies(spark, sf), ASOF).select("policy_id", F.col("days_to_expiry").cast("long").alias("days_to_expiry"),
                                                             F.col("days_past_expiry").cast("long").alias("days_past_expiry"), "is_short_term", "inferred_state")


@query("H10_ledger_summary", f"WITH {POLICIES}, s AS (SELECT user_id, {_STATE} AS st FROM policies) SELECT user_id, count(*) AS total, " + ", ".join(
    f"count(*) FILTER (st='{k}') AS {k}" for k in ("active", "pending", "grace", "terminated", "other")) + " FROM s GROUP BY 1")
def ledger_summary(spark, sf):
    return po.ledger_summary(po.policy_state(policies(spark, sf), ASOF))


@query("H11_expiry_alerts", f"""WITH {POLICIES}, d AS (SELECT *, expiry_date-{A} AS d FROM policies WHERE product IN ('medical','accident'))
SELECT user_id, policy_id, CAST(d AS BIGINT) AS days_to_expiry, CASE WHEN d<=7 THEN 'red' WHEN d<=15 THEN 'yellow' ELSE 'green' END AS alert_level,
 CASE WHEN d<=7 THEN 'urgent_renewal' WHEN d<=15 THEN 'renewal_with_risk_notice' ELSE 'renewal_reminder' END AS recommended_action, 'EVT{ASOF.replace('-', '')}_'||policy_id AS event_id FROM d WHERE d BETWEEN 0 AND 30""")
def expiry_alerts(spark, sf):
    return po.expiry_alerts(policies(spark, sf), ASOF).withColumn("days_to_expiry", F.col("days_to_expiry").cast("long"))


_SCHED = POLICIES + f""", sched AS (SELECT p.*, y AS year_no, q AS period_no, effective_date+CAST(y*365+q*step AS INTEGER) AS due_date, premium*share AS due_amount
 FROM policies p JOIN (VALUES ('annual',1,365,1.0::DOUBLE),('half',2,182,0.52),('quarter',4,90,0.265),('month',12,30,0.09)) m(f,n,step,share) ON f=pay_freq, range(10) ry(y), range(12) rq(q)
 WHERE q<n AND y<greatest(1,floor(({A}-effective_date)/365)+1) AND effective_date+CAST(y*365+q*step AS INTEGER)<={A})"""


@query("H12_payment_schedule", f"WITH {_SCHED} SELECT policy_id, count(*) AS n_dues, round(sum(due_amount)+1e-7,4) AS due_total, CAST(max(due_date) AS VARCHAR) AS last_due FROM sched GROUP BY 1")
def payment_schedule(spark, sf):
    return po.payment_schedule(policies(spark, sf), ASOF).groupBy("policy_id").agg(
        F.count("*").alias("n_dues"), up(F.sum("due_amount")).alias("due_total"), F.date_format(F.max("due_date"), "yyyy-MM-dd").alias("last_due"))


@query("H13_payment_reminders", f"""WITH {_SCHED} SELECT policy_id, year_no::INT AS year_no, period_no::INT AS period_no, CAST({A}-due_date AS BIGINT) AS offset_days,
 CASE {A}-due_date WHEN 0 THEN 'confirm' WHEN 15 THEN 'grace' WHEN 45 THEN 'countdown' ELSE 'final' END AS reminder FROM sched WHERE {A}-due_date IN (0,15,45,59)""")
def payment_reminders(spark, sf):
    return po.payment_reminders(po.payment_schedule(policies(spark, sf), ASOF), ASOF).select(
        "policy_id", "year_no", "period_no", F.col("offset_days").cast("long").alias("offset_days"), "reminder")


def payments(schedule):
    return schedule.filter((F.col("policy_id") + F.col("year_no") * 12 + F.col("period_no")) % 5 != 0).select(
        "policy_id", "due_date", F.date_add("due_date", (F.col("policy_id") % 100).cast("int")).alias("paid_date"))


_LAPSE = _SCHED + f""", ls AS (SELECT s.*, CASE WHEN (policy_id+year_no*12+period_no)%5<>0 AND due_date+CAST(policy_id%100 AS INTEGER)<={A} THEN due_date+CAST(policy_id%100 AS INTEGER) END AS paid_date, due_date+60 AS ge,
 CAST(due_date+60+INTERVAL 24 MONTH AS DATE) AS re FROM sched s),
 lapse AS (SELECT *, CASE WHEN paid_date<=ge THEN 'paid' WHEN paid_date<=re THEN 'reinstated' WHEN {A}<=due_date THEN 'due' WHEN {A}<=ge THEN 'grace' WHEN {A}<=re THEN 'lapsed' ELSE 'terminated' END AS state FROM ls)"""


def lapses(spark, sf):
    schedule = materialize(po.payment_schedule(policies(spark, sf), ASOF))
    return po.lapse_state(schedule, payments(schedule), ASOF)


@query("H14_lapse_state", f"WITH {_LAPSE} SELECT policy_id, state, count(*) AS n, round(sum(due_amount)+1e-7,4) AS amount FROM lapse GROUP BY 1,2")
def lapse_state(spark, sf):
    return lapses(spark, sf).groupBy("policy_id", "state").agg(F.count("*").alias("n"), up(F.sum("due_amount")).alias("amount"))


@query("H15_reinstatement", f"WITH {_LAPSE} SELECT policy_id, round(sum(due_amount)+1e-7,4) AS arrears, round(sum(due_amount*pow(1.055,({A}-due_date)/365.0))+1e-7,4) AS amount_due FROM lapse WHERE state='lapsed' GROUP BY 1")
def reinstatement(spark, sf):
    return po.reinstatement_due(lapses(spark, sf), 0.055, ASOF).withColumns({"arrears": up("arrears"), "amount_due": up("amount_due")})


@query("H16_surrender_quote", f"""WITH {POLICIES}, q AS (SELECT *, {A}-effective_date AS held, premium*greatest(1,floor(({A}-effective_date)/365)+1) AS pp FROM policies),
 v AS (SELECT *, pp*0.6 AS cv, held>=0 AND expiry_date>={A} AS live FROM q),
 k AS (SELECT *, CASE WHEN NOT live THEN 'none' WHEN product NOT IN ('medical','accident') AND held<=15 THEN 'cooling_off' WHEN has_claim=1 THEN 'restricted' ELSE 'cash_value' END AS kind FROM v)
SELECT policy_id, kind AS refund_kind, round(CASE kind WHEN 'cooling_off' THEN greatest(pp-10,0) WHEN 'cash_value' THEN cv ELSE 0 END,4) AS surrender_value,
 round(CASE WHEN live AND held>=365 AND cv*0.8>=1000 THEN cv*0.8 ELSE 0 END,4) AS loan_limit FROM k""")
def surrender_quote(spark, sf):
    years = F.greatest(F.lit(1), F.floor(F.datediff(F.lit(ASOF).cast("date"), "effective_date") / 365) + 1)
    p = policies(spark, sf).withColumn("premiums_paid", F.col("premium") * years).withColumn("cash_value", F.col("premiums_paid") * 0.6)
    return po.surrender_quote(p, ASOF).select("policy_id", "refund_kind", r("surrender_value").alias("surrender_value"), r("loan_limit").alias("loan_limit"))


_LIVE = f"effective_date<={A} AND expiry_date>={A}"


@query("H17_family_report", f"WITH {POLICIES} SELECT coalesce(user_id,-1) AS user_id, coalesce(person,'all') AS person, CAST(GROUPING(user_id)*2+GROUPING(person) AS INTEGER) AS level, count(*) AS policies, "
       "round(sum(premium),4) AS premium, " + ", ".join(f"round(coalesce(sum(sum_insured) FILTER (product='{p}'),0),2) AS {p}" for p in PRODUCTS)
       + f" FROM policies WHERE {_LIVE} GROUP BY ROLLUP(user_id, person)")
def family_report(spark, sf):
    f = po.family_report(policies(spark, sf), ASOF, PRODUCTS)
    return f.withColumns({"user_id": F.coalesce("user_id", F.lit(-1)), "person": F.coalesce("person", F.lit("all")), "premium": r("premium"),
                          **{p: r(p, 2) for p in PRODUCTS}})


@query("H17_cover_alerts", f"""WITH {POLICIES}, n AS (SELECT DISTINCT user_id, person, unnest(['medical','critical_illness','accident']) AS product FROM policies)
SELECT n.user_id, n.person, n.product FROM n WHERE NOT EXISTS (SELECT 1 FROM policies p WHERE p.user_id=n.user_id AND p.person=n.person AND p.product=n.product AND {_LIVE})""")
def cover_alerts(spark, sf):
    return po.cover_alerts(policies(spark, sf), ASOF, ["medical", "critical_illness", "accident"]).select("user_id", "person", "product")


@query("H18_duplicate_cover", f"WITH {POLICIES} SELECT user_id, person, product, count(*) AS n, round(sum(premium),4) AS premium FROM policies WHERE {_LIVE} GROUP BY 1,2,3 HAVING count(*)>1")
def duplicate_cover(spark, sf):
    return po.duplicate_cover(policies(spark, sf), ASOF).withColumn("premium", r("premium"))


_DIMS = [("medical", "greatest(cap*2, expense*5, 200000.0)", 1, "have_medical"), ("critical_illness", "greatest(300000.0, income*3)", 1, "have_ci"),
         ("accident", "greatest(500000.0, income*10)", 3, "have_accident"), ("life", "greatest(mortgage+other_debt+expense*10, income*5)", 2, "have_life"),
         ("property", "greatest(mortgage*0.5, 300000.0)", 4, "have_property"), ("pension", "expense*15", 2, "0.0"), ("education", "education*1.5", 4, "0.0")]
_GAPS = COVERAGE + ", g0 AS (" + " UNION ALL ".join(
    f"SELECT user_id, '{d}' AS dimension, greatest({i}, 50000.0) AS ideal, {b} AS base, {h} AS existing FROM coverage" for d, i, b, h in _DIMS) + """),
 gaps AS (SELECT *, greatest(0.0, ideal-existing) AS gap, CASE WHEN existing/ideal<0.2 THEN 'severe' WHEN existing/ideal<0.5 THEN 'short' WHEN existing/ideal<0.8 THEN 'basic' WHEN existing/ideal<1.2 THEN 'adequate' ELSE 'excess' END AS gap_class FROM g0)"""


@query("H19_coverage_gaps", f"""WITH {_GAPS} SELECT user_id, dimension, round(ideal,4) AS ideal, round(gap,4) AS gap, round(existing-ideal,4) AS surplus, gap_class,
 round(CASE WHEN gap_class='excess' THEN 0 ELSE least(100.0, gap/ideal*100) END,6) AS severity, CAST(least(5, base+CASE WHEN gap_class IN ('adequate','excess') THEN 0 ELSE 1 END) AS INTEGER) AS priority FROM gaps""")
def coverage_gaps(spark, sf):
    return gp.coverage_gaps(coverage(spark, sf)).select("user_id", "dimension", r("ideal").alias("ideal"), r("gap").alias("gap"), r("surplus").alias("surplus"), "gap_class",
                                                        r("severity", 6).alias("severity"), "priority")


_CI = [("agent", "400000.0+income*4+150000.0"), ("actuarial", "CASE city_tier WHEN 1 THEN 350000.0 WHEN 2 THEN 275000.0 ELSE 200000.0 END+income*5+150000.0"), ("threshold", "greatest(300000.0,income*3)")]


@query("H20_ci_gap", f"WITH {COVERAGE} " + " UNION ALL ".join(
    f"SELECT user_id, '{m}' AS model, round({x},4) AS required, round(greatest(0.0,{x}-have_ci),4) AS ci_gap, round(greatest(0.0,{x}-have_ci)/({x}),6) AS gap_ratio FROM coverage" for m, x in _CI))
def ci_gap(spark, sf):
    c = coverage(spark, sf)
    return reduce(lambda a, b: a.unionByName(b), [gp.ci_gap(c, m).select("user_id", F.lit(m).alias("model"), r("required").alias("required"), r("ci_gap").alias("ci_gap"),
                                                                        r("gap_ratio", 6).alias("gap_ratio")) for m, _ in _CI])


@query("H21_life_gap", f"""WITH {COVERAGE}, n AS (SELECT *, mortgage+other_debt+expense*CASE WHEN children>0 THEN greatest(10,22-youngest_age) ELSE 0 END+education+elder_cost
 +CASE WHEN children>0 OR mortgage>0 THEN 100000.0 ELSE 0.0 END+75000.0 AS need FROM coverage) SELECT user_id, round(need,4) AS life_need, round(greatest(0.0,need-have_life-savings),4) AS life_gap FROM n""")
def life_gap(spark, sf):
    return gp.life_gap(coverage(spark, sf)).select("user_id", r("life_need").alias("life_need"), r("life_gap").alias("life_gap"))


@query("H22_saving_targets", f"""WITH {CUSTOMERS} SELECT user_id, round(400000.0*pow(1.03,greatest(1,18-youngest_age))+1e-7,3) AS education_target, round(400000.0*pow(1.03,greatest(1,18-youngest_age))/greatest(1,18-youngest_age)+1e-7,3) AS education_yearly,
 round(income*pow(1.03,greatest(1,60-age))*0.3+1e-7,3) AS pension_shortfall, round(income*pow(1.03,greatest(1,60-age))*0.3*25+1e-7,3) AS pension_target FROM customers""")
def saving_targets(spark, sf):
    s = gp.saving_target(customers(spark, sf).withColumn("education_goal", F.lit(400000.0)))
    return s.select("user_id", *[up(c, 3).alias(c) for c in ("education_target", "education_yearly", "pension_shortfall", "pension_target")])


_BILL = """bill AS (SELECT l_orderkey, l_linenumber, l_extendedprice*2 AS ca, l_extendedprice*1.5 AS cb, l_extendedprice*0.5 AS cc, l_linenumber%2 AS hc, CASE WHEN l_linenumber%3=0 THEN 1 ELSE 0 END AS hm,
  coalesce(500+n_nationkey*50,800) AS ded, 300000.0 AS cap, coalesce(0.7+n_regionkey*0.03,0.75) AS rate FROM lineitem LEFT JOIN (SELECT * FROM nation WHERE n_nationkey<15) ON l_suppkey%25=n_nationkey),
 b1 AS (SELECT *, ca+cb+cc AS total, ca+cb*0.85 AS cov, least(greatest(0,ca+cb*0.85-ded)*rate,cap) AS basic FROM bill),
 b2 AS (SELECT *, greatest(0,cov-basic-30404) AS x FROM b1),
 b3 AS (SELECT *, least(x,50000)*0.6+least(greatest(x-50000,0),50000)*0.65+least(greatest(x-100000,0),50000)*0.7+least(greatest(x-150000,0),50000)*0.75+greatest(x-200000,0)*0.8 AS cat FROM b2),
 b4 AS (SELECT *, CASE WHEN hc=1 THEN greatest(0,total-basic-cat-20000)*0.5 ELSE 0 END AS city FROM b3),
 b5 AS (SELECT *, CASE WHEN hm=1 THEN greatest(0,total-basic-cat-city-10000) ELSE 0 END AS com FROM b4),
 b6 AS (SELECT *, total-basic-cat-city-com AS self FROM b5)"""


@query("H23_reimbursement", f"WITH {_BILL} SELECT CASE WHEN self<=10000 THEN 'safe' WHEN self<=50000 THEN 'warning' ELSE 'severe' END AS gap_level, hc AS has_city, count(*) AS n, round(sum(basic),2) AS basic, "
       "round(sum(cat),2) AS catastrophic, round(sum(city),2) AS city, round(sum(com),2) AS commercial, round(sum(self),2) AS self_paid FROM b6 GROUP BY 1,2")
def reimbursement(spark, sf):
    p = F.col("l_extendedprice")
    bills = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 25).cast("int").alias("city_id"), (p * 2).alias("class_a"), (p * 1.5).alias("class_b"), (p * 0.5).alias("class_c"),
        (F.col("l_linenumber") % 2).cast("int").alias("has_city"), (F.col("l_linenumber") % 3 == 0).cast("int").alias("has_commercial"))
    params = table(spark, sf, "nation").filter("n_nationkey < 15").select(
        F.col("n_nationkey").alias("city_id"), (F.col("n_nationkey") * 50 + 500).cast("double").alias("deductible"), F.lit(300000.0).alias("cap"),
        (F.col("n_regionkey") * 0.03 + 0.7).alias("rate"))
    out = gp.reimbursement(bills, params, "city_id", {"deductible": 800.0, "cap": 300000.0, "rate": 0.75})
    return out.groupBy("gap_level", "has_city").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 2).alias(c) for c in ("basic", "catastrophic", "city", "commercial", "self_paid")])


@query("H24_claim_payout", """SELECT l_returnflag, l_linenumber, count(*) AS n, round(sum(greatest(0,l_extendedprice-sp-op-10000)*CASE WHEN sp>0 THEN 1.0 ELSE 0.6 END),2) AS payout
 FROM (SELECT *, l_extendedprice*l_discount*5 AS sp, l_extendedprice*l_tax AS op FROM lineitem) GROUP BY 1,2""")
def claim_payout(spark, sf):
    p = F.col("l_extendedprice")
    c = table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", p.alias("cost"), (p * F.col("l_discount") * 5).alias("social_paid"),
                                            (p * F.col("l_tax")).alias("other_paid"), F.lit(10000.0).alias("deductible"))
    return gp.claim_payout(c).groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("payout"), 2).alias("payout"))


@query("H25_denial_breakdown", """WITH c AS (SELECT chr(CAST(65+l_linenumber%5 AS INTEGER))||CAST(l_partkey%4+1 AS VARCHAR) AS code FROM lineitem WHERE l_returnflag='R'),
 t AS (SELECT code, CASE substr(code,1,1) WHEN 'A' THEN 'application' WHEN 'B' THEN 'clause' WHEN 'C' THEN 'treatment' WHEN 'D' THEN 'insurer' ELSE 'other' END AS k FROM c)
SELECT coalesce(k,'all') AS denial_class, coalesce(code,'all') AS denial_code, CAST(GROUPING(k)*2+GROUPING(code) AS INTEGER) AS level, count(*) AS n FROM t GROUP BY ROLLUP(k, code)""")
def denial_breakdown(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.concat(F.char(F.col("l_linenumber") % 5 + 65), (F.col("l_partkey") % 4 + 1).cast("string")).alias("code"))
    return gp.denial_breakdown(li, "code").select(F.coalesce("denial_class", F.lit("all")).alias("denial_class"), F.coalesce("denial_code", F.lit("all")).alias("denial_code"), "level", "n")


_WANT = {"medical": "500000.0", "critical_illness": "income*3+300000.0", "accident": "500000.0", "life": "income*5+100000.0"}


def wanted(spark, sf):
    return coverage(spark, sf).withColumns({f"want_{p}": F.expr(x).cast("double") for p, x in _WANT.items()})


_ANOM = []
for _p, _s in (("medical", "critical"), ("critical_illness", "high"), ("accident", "high"), ("life", "critical")):
    _ANOM += [f"SELECT user_id, 'missing' AS anomaly, '{_p}' AS detail, '{_s}' AS severity FROM coverage WHERE sum_{_p}<=0",
              f"SELECT user_id, 'insufficient', '{_p}', 'high' FROM coverage WHERE sum_{_p}>0 AND sum_{_p}<({_WANT[_p]})*0.5",
              f"SELECT user_id, 'duplicate', '{_p}', 'medium' FROM coverage WHERE n_{_p}>1"]
_ANOM += ["SELECT user_id, 'mismatch', 'elder_term_life', 'medium' FROM coverage WHERE age>=65 AND sum_life>0",
          "SELECT user_id, 'mismatch', 'young_annuity_first', 'medium' FROM coverage WHERE age<35 AND sum_annuity>0 AND sum_medical<=0"]


@query("H26_coverage_anomalies", f"WITH {COVERAGE} " + " UNION ALL ".join(_ANOM))
def coverage_anomalies(spark, sf):
    return gp.coverage_anomalies(wanted(spark, sf))


@query("H27_calibrate_gaps", f"""WITH {COVERAGE}, p AS (SELECT segment, avg(age)/1000 AS m, avg(income)/10000 AS base FROM coverage WHERE segment<>'MACHINERY' GROUP BY 1)
SELECT user_id, round(greatest(0.0, greatest(0.0,550000.0+income*4-have_ci)*(1+coalesce(m,0))+CASE WHEN m IS NULL THEN 0 ELSE 100.0 END*(income/10000-coalesce(base,0))),4) AS gap_adjusted FROM coverage LEFT JOIN p USING (segment)""")
def calibrate_gaps(spark, sf):
    g = gp.ci_gap(coverage(spark, sf)).select("user_id", "segment", F.col("ci_gap").alias("gap"), (F.col("income") / 10000).alias("driver"))
    params = customers(spark, sf).filter("segment <> 'MACHINERY'").groupBy("segment").agg(
        (F.avg("age") / 1000).alias("multiplier"), F.lit(100.0).alias("ate"), (F.avg("income") / 10000).alias("base"))
    return gp.calibrate_gaps(g, params).select("user_id", r("gap_adjusted").alias("gap_adjusted"))


@query("H28_segment_key", f"""WITH {CUSTOMERS} SELECT user_id, CASE WHEN age<=17 THEN '少儿' WHEN age<=25 THEN '青年' WHEN age<=35 THEN '青壮' WHEN age<=45 THEN '中青' WHEN age<=55 THEN '中年' WHEN age<=65 THEN '中老' ELSE '老年' END||'_'||segment||'_'||city_tier AS segment FROM customers""")
def segment_key(spark, sf):
    c = customers(spark, sf).withColumn("band", bands.age_band(F.col("age")))
    return cu.segment_key(c, ["band", "segment", "city_tier"]).select("user_id", "segment")


def _plan_sql(plan):
    def s(kind=None):
        parts = [f"CASE WHEN gap_{p}>0 THEN {price} ELSE 0 END" for pl, p, k, _, price in gp.PLAN_CATALOGUE if pl == plan and (kind is None or k == kind)]
        return "CAST(" + ("+".join(parts) or "0") + " AS DOUBLE)"
    return f"SELECT user_id, income, '{plan}' AS plan, {s()} AS total_premium, {s('protection')} AS protection, {s('savings')} AS savings FROM og"


_PLANS = COVERAGE + ", og AS (SELECT user_id, income, " + ", ".join(f"{_WANT[p]}-sum_{p} AS gap_{p}" for p in _WANT) + ", 100000.0-sum_annuity AS gap_annuity FROM coverage), pl AS (" + " UNION ALL ".join(map(_plan_sql, ("minimal", "balanced", "premium"))) + ")"


def planned(spark, sf):
    g = wanted(spark, sf).withColumns({f"gap_{p}": F.col(f"want_{p}") - F.col(f"sum_{p}") for p in _WANT} | {"gap_annuity": 100000.0 - F.col("sum_annuity")})
    return gp.plans(g)


@query("H29_three_plans", f"WITH {_PLANS} SELECT user_id, plan, total_premium, protection, savings, round(CASE WHEN income>0 THEN total_premium/income ELSE -1 END,6) AS income_share, income>0 AND total_premium/nullif(income,0)<=0.15 AS fits_budget FROM pl")
def three_plans(spark, sf):
    return planned(spark, sf).select("user_id", "plan", "total_premium", "protection", "savings", F.round(F.coalesce("income_share", F.lit(-1.0)), 6).alias("income_share"), "fits_budget")


@query("H30_budget_check", f"WITH {_PLANS} SELECT user_id, plan, CASE WHEN income=0 THEN 'unknown' WHEN total_premium/income>0.2 THEN 'heavy' WHEN total_premium/income<0.05 THEN 'low' ELSE 'normal' END AS load, savings>protection AS savings_first FROM pl")
def budget_check(spark, sf):
    return gp.budget_check(planned(spark, sf)).select("user_id", "plan", "load", "savings_first")


@query("H30_budget_allocation", f"WITH {CUSTOMERS} " + " UNION ALL ".join(f"SELECT user_id, '{p}' AS product, round(income*0.1*{lo},4) AS low, round(income*0.1*{hi},4) AS high FROM customers" for p, (lo, hi) in gp.BUDGET_SHARES.items()))
def budget_allocation(spark, sf):
    b = gp.budget_allocation(customers(spark, sf).withColumn("budget", F.col("income") * 0.1), "budget")
    return b.withColumns({"low": r("low"), "high": r("high")})


_REC = "(VALUES " + ",".join(f"('{t}',{a},{b},'{c}')" for t, a, b, c, _ in gp.NEED_PRODUCTS) + ") v(tag,tier,rk,product)"


@query("H31_recommendation", f"WITH {_TAGGED}, t AS (SELECT user_id, unnest(string_split({_NEEDS}, ',')) AS tag FROM tagged) SELECT user_id, tag, product, CAST(row_number() OVER (PARTITION BY user_id ORDER BY tier, rk) AS INTEGER) AS priority FROM t JOIN {_REC} USING (tag)")
def recommendation(spark, sf):
    t = tagged(spark, sf).select("user_id", F.explode("need_tags").alias("n")).select("user_id", F.col("n.tag").alias("tag"))
    return gp.recommend(t).select("user_id", "tag", "product", "priority")


@query("H32_churn_events", f"""WITH {POLICIES}, d AS (SELECT *, {A}-expiry_date AS past FROM policies), c AS (
 SELECT *, 'expiry_no_renewal' AS churn_type FROM d WHERE product IN ('medical','accident') AND past>30 AND status<>'surrendered' AND NOT EXISTS (SELECT 1 FROM policies r WHERE r.user_id=d.user_id AND r.effective_date>d.expiry_date AND r.effective_date<=d.expiry_date+30)
 UNION ALL SELECT *, 'lapsed' FROM d WHERE product NOT IN ('medical','accident') AND status='lapsed' AND past>=0 UNION ALL SELECT *, 'surrendered' FROM d WHERE status='surrendered' AND effective_date<={A})
SELECT user_id, policy_id, product, churn_type, CAST(greatest(past,0) AS BIGINT) AS days_past_expiry, sum_insured AS sum_insured_lost, round(premium,4) AS annual_premium_lost FROM c""")
def churn_events(spark, sf):
    return ch.churn_events(policies(spark, sf), ASOF).withColumns({"days_past_expiry": F.col("days_past_expiry").cast("long"), "annual_premium_lost": r("annual_premium_lost")})


def churn_users(spark, sf):
    f = policies(spark, sf).groupBy("user_id").agg(
        F.count("*").alias("policy_count"), F.sum("premium").alias("prem"), (F.count_distinct("product") - 1).alias("switches"), F.sum("has_claim").alias("n_claims"),
        F.count_if((F.col("has_claim") == 1) & (F.col("status") == "lapsed")).alias("denied_claims"), F.max((F.col("status") == "surrendered").cast("int")).alias("surrendered"),
        F.floor(F.datediff(F.lit(ASOF).cast("date"), F.min("effective_date")) / 365).alias("tenure_years"))
    return customers(spark, sf).join(f, "user_id").withColumns({
        "premium_ratio": F.col("prem") / (F.col("income") + 1), "n_30d": F.col("user_id") % 4, "family_changed": (F.col("user_id") % 7 == 0).cast("int")})


_USERS = CUSTOMERS + ", " + POLICIES + f""", cu AS (SELECT c.*, f.*EXCLUDE(user_id), prem/(income+1) AS premium_ratio, c.user_id%4 AS n_30d, CASE WHEN c.user_id%7=0 THEN 1 ELSE 0 END AS family_changed FROM customers c JOIN
 (SELECT user_id, count(*) AS policy_count, sum(premium) AS prem, count(DISTINCT product)-1 AS switches, sum(has_claim) AS n_claims, count(*) FILTER (has_claim=1 AND status='lapsed') AS denied_claims,
  max((status='surrendered')::INT) AS surrendered, floor(({A}-min(effective_date))/365) AS tenure_years FROM policies GROUP BY 1) f USING (user_id)),
 sg AS (SELECT user_id, segment, 'price_sensitivity' AS cause, (premium_ratio>0.10)::INT+(policy_count<=2)::INT+(n_claims=0)::INT+(tenure_years<2)::INT AS n_signals FROM cu
 UNION ALL SELECT user_id, segment, 'product_dissatisfaction', (switches>0)::INT+(complaints>0)::INT+(policy_count BETWEEN 2 AND 3)::INT+(tenure_years BETWEEN 2 AND 3)::INT FROM cu
 UNION ALL SELECT user_id, segment, 'need_change', (family_changed=1)::INT+(switches>1)::INT+(complaints=0)::INT+(surrendered=1)::INT FROM cu
 UNION ALL SELECT user_id, segment, 'forgetfulness', (n_30d=0)::INT+(complaints=0)::INT+(policy_count>=3)::INT+(surrendered=0)::INT FROM cu
 UNION ALL SELECT user_id, segment, 'claim_dispute', (denied_claims>0)::INT+(n_claims>0)::INT+(complaints>0)::INT+(n_30d=0)::INT FROM cu)"""


@query("H33_churn_signals", f"WITH {_USERS} SELECT user_id, cause, n_signals, CAST(n_signals/4.0 AS DOUBLE) AS intensity FROM sg")
def churn_signals(spark, sf):
    return ch.churn_signals(churn_users(spark, sf)).select("user_id", "cause", "n_signals", "intensity")


def attributed(spark, sf):
    s = ch.churn_signals(churn_users(spark, sf))
    params = s.groupBy("segment", "cause").agg(F.round(F.avg("intensity"), 6).alias("ate"))
    return ch.attribute_churn(s, params)


_ATTR = _USERS + """, pm AS (SELECT segment, cause, round(avg(n_signals/4.0),6) AS ate FROM sg GROUP BY 1,2), sc AS (SELECT user_id, cause, n_signals, CAST(ate*(n_signals/4.0) AS DOUBLE) AS score FROM sg JOIN pm USING (segment, cause)),
 at_ AS (SELECT user_id, cause AS primary_cause, score, n_signals, n_signals>=3 AS conclusive FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, cause) rn FROM sc) WHERE rn=1)"""


@query("H34_attribution", f"WITH {_ATTR} SELECT user_id, primary_cause, round(score,6) AS score, n_signals, conclusive FROM at_")
def attribution(spark, sf):
    return attributed(spark, sf).withColumn("score", r("score", 6))


@query("H35_inertia", f"""WITH {POLICIES}, i AS (SELECT policy_id, greatest(0,floor(({A}-effective_date)/365))*0.1+CASE WHEN policy_id%2=0 THEN 0.3 ELSE 0 END+CASE WHEN policy_id%3=0 THEN 0.1 ELSE 0 END AS inertia,
 CASE WHEN has_claim=1 AND status='in_force' THEN 0.3 WHEN has_claim=1 THEN -0.65 ELSE 0 END+CASE WHEN policy_id%11=0 THEN -0.4 ELSE 0 END+CASE WHEN policy_id%7=0 THEN -0.2 ELSE 0 END AS shock FROM policies)
SELECT policy_id, CAST(round(inertia,6) AS DOUBLE) AS inertia, CAST(round(inertia+shock,6) AS DOUBLE) AS renewal_drive FROM i""")
def inertia(spark, sf):
    k = F.col("policy_id")
    p = policies(spark, sf).withColumns({
        "renewal_years": F.greatest(F.lit(0), F.floor(F.datediff(F.lit(ASOF).cast("date"), "effective_date") / 365)), "auto_debit": (k % 2 == 0).cast("int"),
        "custody": (k % 3 == 0).cast("int"), "discontinued": (k % 11 == 0).cast("int"), "rival_contact": (k % 7 == 0).cast("int"),
        "claim_outcome": F.when((F.col("has_claim") == 1) & (F.col("status") == "in_force"), "paid").when(F.col("has_claim") == 1, "disputed").otherwise("none")})
    return ch.inertia_score(p).select("policy_id", r("inertia", 6).alias("inertia"), r("renewal_drive", 6).alias("renewal_drive"))


@query("H36_recovery_plan", f"""WITH {_ATTR}, cov AS (SELECT user_id, income*3 AS g FROM customers), j AS (SELECT a.*, coalesce(g,0)>900000 AND primary_cause<>'claim_dispute' AS o FROM at_ a LEFT JOIN cov USING (user_id))
SELECT user_id, primary_cause, o AS override_to_gap, CASE WHEN o THEN 'gap_reactivation' ELSE CASE primary_cause WHEN 'price_sensitivity' THEN 'coupon' WHEN 'product_dissatisfaction' THEN 'product_switch' WHEN 'need_change' THEN 'gap_reactivation'
 WHEN 'forgetfulness' THEN 'simple_reminder' ELSE 'manual_followup' END END AS strategy, CASE primary_cause WHEN 'price_sensitivity' THEN 'sms_push' WHEN 'product_dissatisfaction' THEN 'agent' WHEN 'need_change' THEN 'wechat_sms'
 WHEN 'forgetfulness' THEN 'sms_push' ELSE 'phone' END AS channel, CAST({A}+7 AS VARCHAR) AS follow_up_date FROM j""")
def recovery_plan(spark, sf):
    gaps = customers(spark, sf).select("user_id", (F.col("income") * 3).alias("total_gap"))
    return ch.recovery_plan(attributed(spark, sf), gaps, ASOF, 900_000.0).select(
        "user_id", "primary_cause", "override_to_gap", "strategy", "channel", F.date_format("follow_up_date", "yyyy-MM-dd").alias("follow_up_date"))


@query("H37_renewal_cohorts", f"""WITH {POLICIES}, l AS (SELECT *, lead(effective_date) OVER w AS nx, min(effective_date) OVER (PARTITION BY user_id, product) AS fs FROM policies WINDOW w AS (PARTITION BY user_id, product ORDER BY effective_date, policy_id))
SELECT product, CAST(floor((effective_date-fs)/365)+1 AS INTEGER) AS policy_year, count(*) AS n, count(*) FILTER (nx-expiry_date<=30) AS renewed, round(count(*) FILTER (nx-expiry_date<=30)/count(*),6) AS renewal_rate FROM l GROUP BY 1,2""")
def renewal_cohorts(spark, sf):
    return ch.renewal_cohorts(policies(spark, sf)).withColumn("renewal_rate", r("renewal_rate", 6))


@query("H38_ab_assign", "SELECT c_custkey AS user_id, CASE WHEN c_custkey%2=0 THEN 'control' ELSE 'treatment' END AS arm FROM customer")
def ab_assign(spark, sf):
    return ch.ab_assign(customers(spark, sf).select("user_id"), "user_id")


def experiment(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "user_id")
    return ch.ab_assign(o, "user_id").withColumns({"converted": (F.col("o_orderstatus") == "F").cast("int")})


_AB = """e AS (SELECT *, o_custkey%2 AS t, (o_orderstatus='F')::INT AS c FROM orders), g AS (SELECT o_orderpriority AS segment, count(*) FILTER (t=0)::DOUBLE n0, count(*) FILTER (t=1)::DOUBLE n1, sum(c) FILTER (t=0)::DOUBLE k0, sum(c) FILTER (t=1)::DOUBLE k1,
 avg(o_totalprice) FILTER (t=0) m0, avg(o_totalprice) FILTER (t=1) m1, var_samp(o_totalprice) FILTER (t=0) v0, var_samp(o_totalprice) FILTER (t=1) v1 FROM e GROUP BY 1),
 x AS (SELECT *, (n0+n1)*pow(k1*(n0-k0)-k0*(n1-k1),2)/(n0*n1*(k0+k1)*(n0+n1-k0-k1)) AS chi2, (m1-m0)/sqrt(v0/n0+v1/n1) AS tt FROM g)"""


@query("H39_ab_test", f"WITH {_AB} SELECT segment, round(k0/n0,6) AS rate_control, round(k1/n1,6) AS rate_treatment, round(chi2,6) AS chi2, round(tt,6) AS t_stat, "
       "CASE WHEN chi2>3.841458820694124 AND k1/n1>k0/n0 THEN 'promote' WHEN chi2>3.841458820694124 THEN 'stop' ELSE 'hold' END AS decision FROM x")
def ab_test(spark, sf):
    e = experiment(spark, sf).withColumnRenamed("o_orderpriority", "segment")
    return ch.ab_test(e, "arm", "converted", "o_totalprice", "segment").select("segment", *[r(c, 6).alias(c) for c in ("rate_control", "rate_treatment", "chi2", "t_stat")], "decision")


@query("H40_ab_sample_size", "WITH g AS (SELECT o_orderpriority AS segment, avg((o_orderstatus='F')::INT) AS p FROM orders GROUP BY 1) SELECT segment, "
       "CAST(ceil(7.848879734349086*(p*(1-p)+(p+0.05)*(0.95-p))/0.0025) AS BIGINT) AS n_per_arm FROM g")
def ab_sample_size(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("segment")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("base"))
    return ch.ab_sample_size(g, "base").select("segment", "n_per_arm")


# phrases that occur in the supplied messages, by made-up category
PHRASES = {"claims": ["with the", "of the"], "pressure": ["dans la", "pour le"], "rebate": ["und der", "para el"]}


@query("H41_compliance_flags", "SELECT conv_id, turn, array_to_string(list_filter([" + ",".join(
    f"CASE WHEN regexp_matches(text, '{'|'.join(w)}') THEN '{c}' END" for c, w in sorted(PHRASES.items())) + "], lambda x: x IS NOT NULL), ',') AS categories FROM conversations")
def compliance_flags(spark, sf):
    return ms.compliance_flags(table(spark, sf, "conversations"), "text", PHRASES).select("conv_id", "turn", F.array_join("categories", ",").alias("categories"))


@query("H41_prohibited_documents", "SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '保证收益|稳赚不赔|什么都赔|一定能赔|最后一天|限时抢购')) AS n_flagged FROM documents GROUP BY 1")
def prohibited_documents(spark, sf):
    return ms.compliance_flags(table(spark, sf, "documents"), "text").groupBy("lang").agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged"))


@query("H42_funnel", """WITH a AS (SELECT user_id, min(ts) t0 FROM events WHERE event_type='signup' GROUP BY 1),
 b AS (SELECT user_id, any_value(t0) t0, min(ts) t1 FROM events JOIN a USING (user_id) WHERE event_type='view' AND ts>=t0 GROUP BY 1),
 c AS (SELECT user_id, any_value(t1) t1, min(ts) t2 FROM events JOIN b USING (user_id) WHERE event_type='click' AND ts>=t1 GROUP BY 1),
 d AS (SELECT user_id, any_value(t2) t2, min(ts) t3 FROM events JOIN c USING (user_id) WHERE event_type='purchase' AND ts>=t2 GROUP BY 1)
SELECT 0 AS step, 'signup' AS stage, count(*) AS n_users, 1.0::DOUBLE AS conversion, 0.0::DOUBLE AS mean_lag_hours FROM a
UNION ALL SELECT 1,'view',count(*),round(count(*)/(SELECT count(*) FROM a),6),round(avg(date_diff('microsecond',t0,t1)/3.6e9),6) FROM b
UNION ALL SELECT 2,'click',count(*),round(count(*)/(SELECT count(*) FROM b),6),round(avg(date_diff('microsecond',t1,t2)/3.6e9),6) FROM c
UNION ALL SELECT 3,'purchase',count(*),round(count(*)/(SELECT count(*) FROM c),6),round(avg(date_diff('microsecond',t2,t3)/3.6e9),6) FROM d""")
def funnel(spark, sf):
    f = ms.funnel(table(spark, sf, "events"), "user_id", "ts", "event_type", ["signup", "view", "click", "purchase"])
    return f.withColumns({"conversion": r("conversion", 6), "mean_lag_hours": r("mean_lag_hours", 6)})


@query("H43_event_dedup", "SELECT event_id, event_type, CASE WHEN event_id%50=0 THEN 2 ELSE 1 END AS copies FROM events")
def event_dedup(spark, sf):
    e = table(spark, sf, "events").drop("props")
    again = e.filter("event_id % 50 = 0").withColumn("event_id", F.col("event_id") + 10_000_000_000)
    return ms.dedup_events(e.unionByName(again), ["user_id", "ts", "event_type", "value"], "event_id").select("event_id", "event_type", F.col("copies").cast("int").alias("copies"))


@query("H43_event_quality", "SELECT event_type, count(*) AS n, count(*) FILTER (value>168) AS n_slow, count(*) FILTER (CAST(props->>'k' AS INTEGER)<5) AS n_failed, round(avg((value>168)::INT),6) AS slow_rate, "
       "round(avg((CAST(props->>'k' AS INTEGER)<5)::INT),6) AS failed_rate FROM events GROUP BY 1")
def event_quality(spark, sf):
    q = ms.event_quality(table(spark, sf, "events"), "event_type", F.col("value") > 168, F.get_json_object("props", "$.k").cast("int") < 5)
    return q.withColumns({"slow_rate": r("slow_rate", 6), "failed_rate": r("failed_rate", 6)})


@query("H44_consult_preference", "SELECT user_id, event_type, n, CAST(rk AS INTEGER) AS rank FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) rk FROM events GROUP BY 1,2) WHERE rk<=3")
def consult_preference(spark, sf):
    return cu.consult_preference(table(spark, sf, "events"), "event_type")


@query("H44_intent_level", f"WITH {_EV} SELECT user_id, n30 AS n_30d, CASE WHEN n30>=5 AND d<=7 THEN 'high' WHEN n30>=1 AND d<=30 THEN 'medium' ELSE 'low' END AS intent_level FROM ev")
def intent_level(spark, sf):
    return cu.behaviour_rollup(table(spark, sf, "events"), EVENTS_ASOF).select("user_id", "n_30d", "intent_level")


_RULES = "(VALUES " + ",".join(f"('{p}',{lo},{hi},{c},{w})" for p, lo, hi, c, w in gp.PRODUCT_RULES) + ") v(product,lo,hi,cls,waiting_days)"


@query("H45_eligibility", f"WITH {CUSTOMERS} SELECT user_id, product, waiting_days FROM customers JOIN {_RULES} ON age BETWEEN lo AND hi AND occupation_class<=cls")
def eligibility(spark, sf):
    return gp.eligible(customers(spark, sf))


_FIND = "(VALUES ('1-URGENT','hypertension_2'),('2-HIGH','bmi_30'),('3-MEDIUM','thyroid_1_2'),('4-NOT SPECIFIED','fatty_liver'),('5-LOW','hypertension_1')) f(p,finding)"
_UW = "(VALUES " + ",".join(f"('{f}','{p}','{o}',{gp.OUTCOME_SEVERITY[o]})" for f, p, o in gp.UNDERWRITING) + ") u(finding,product,outcome,sev)"


@query("H46_underwriting", f"""WITH d AS (SELECT DISTINCT o_custkey AS user_id, finding FROM orders JOIN {_FIND} ON o_orderpriority=p)
SELECT user_id, product, arg_max(outcome, sev) AS outcome, CAST(max(sev) AS INTEGER) AS severity, count(*) AS n_findings,
 CASE WHEN max(sev)>=3 AND product='medical' THEN 'cancer_medical' WHEN max(sev)>=3 AND product='critical_illness' THEN 'cancer_cover' ELSE 'none' END AS substitute FROM d JOIN {_UW} USING (finding) GROUP BY 1,2""")
def underwriting(spark, sf):
    f = bands.code_map(F.col("o_orderpriority"), {"1-URGENT": "hypertension_2", "2-HIGH": "bmi_30", "3-MEDIUM": "thyroid_1_2", "4-NOT SPECIFIED": "fatty_liver"}, "hypertension_1")
    found = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), f.alias("finding")).distinct()
    return gp.underwrite(found)


def _ill(label, rate, y):
    paid = min(y, 10)
    factor = sum((1 + rate) ** (y - i) for i in range(paid)) * 0.9
    return f"SELECT '{label}' AS scenario, {y} AS year, round(sum(premium*{float(paid)!r}),2) AS total_paid, round(sum(premium*{factor!r}),2) AS value, count(*) FILTER (premium*{factor!r}>=premium*{float(paid)!r}) AS n_even FROM policies"


@query("H47_illustration", f"WITH {POLICIES} " + " UNION ALL ".join(_ill(s, x, y) for s, x in (("low", 0.02), ("mid", 0.045), ("high", 0.06)) for y in (5, 10, 15, 20, 30)))
def illustration(spark, sf):
    return gp.illustrate(policies(spark, sf), "premium").groupBy("scenario", "year").agg(
        F.round(F.sum("total_paid"), 2).alias("total_paid"), F.round(F.sum("value"), 2).alias("value"), F.count_if("broke_even").alias("n_even"))


@query("H48_waiver", f"""WITH {_SCHED}, w AS (SELECT s.*, CASE WHEN policy_id%4=1 AND due_date>=effective_date+400 THEN 1 ELSE 0 END AS wv FROM sched s)
SELECT policy_id, count(*) AS n, CAST(sum(wv) AS BIGINT) AS n_waived, round(sum(CASE WHEN wv=1 THEN 0 ELSE due_amount END)+1e-7,4) AS payable FROM w GROUP BY 1""")
def waiver(spark, sf):
    p = policies(spark, sf)
    w = p.filter("policy_id % 4 = 1").select("policy_id", F.date_add("effective_date", 400).alias("waived_from"))
    return po.apply_waiver(po.payment_schedule(p, ASOF), w).groupBy("policy_id").agg(
        F.count("*").alias("n"), F.count_if("waived").alias("n_waived"), up(F.sum("payable")).alias("payable"))
