"""Coverage gaps, reimbursement, plans, recommendation and underwriting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import materialize
from .joins import bracket_sum, small

# Treatment cost by city tier for the actuarial model (mid points).
CITY_TREATMENT_COST = {1: 350_000.0, 2: 275_000.0, 3: 200_000.0}
# Catastrophic cover brackets (lower, upper, rate) above the deductible.
CATASTROPHIC_STEPS = [(0, 50_000, 0.60), (50_000, 100_000, 0.65), (100_000, 150_000, 0.70),
                      (150_000, 200_000, 0.75), (200_000, None, 0.80)]
# Denial classes by leading letter of the code.
DENIAL_CLASSES = {"A": "application", "B": "clause", "C": "treatment", "D": "insurer"}
# Plan catalogue (plan, product, kind, sum insured, annual premium), mid points.
PLAN_CATALOGUE = [
    ("minimal", "medical", "protection", 3_000_000.0, 400.0), ("minimal", "accident", "protection", 400_000.0, 200.0),
    ("balanced", "medical", "protection", 4_000_000.0, 800.0), ("balanced", "accident", "protection", 1_000_000.0, 550.0),
    ("balanced", "critical_illness", "protection", 500_000.0, 9_000.0), ("balanced", "life", "protection", 2_500_000.0, 2_250.0),
    ("premium", "medical", "protection", 8_000_000.0, 19_000.0), ("premium", "accident", "protection", 2_500_000.0, 2_000.0),
    ("premium", "critical_illness", "protection", 1_000_000.0, 18_500.0), ("premium", "life", "protection", 3_000_000.0, 30_000.0),
    ("premium", "annuity", "savings", 90_000.0, 100_000.0)]
# Need tag -> (tier, rank, first choice, budget alternative).
NEED_PRODUCTS = [("医疗刚需", 1, 1, "百万医疗险", "惠民保"), ("出行保障", 1, 2, "综合意外险", "交通意外险"),
                 ("大病保障", 2, 1, "重疾险", "防癌险"), ("家庭责任", 2, 2, "定期寿险", "意外险"),
                 ("养老储蓄", 3, 1, "养老年金", "养老目标基金"), ("子女规划", 3, 2, "教育年金", "储蓄型重疾")]
# Product -> (min age, max age, highest occupation class, waiting days).
PRODUCT_RULES = [("medical", 0, 65, 4, 30), ("critical_illness", 0, 60, 4, 90), ("accident", 0, 65, 3, 0),
                 ("life", 18, 60, 4, 90), ("annuity", 0, 65, 6, 0), ("whole_life", 0, 70, 6, 0)]
# Underwriting severity order and finding x product outcomes.
OUTCOME_SEVERITY = {"standard": 0, "loading": 1, "exclusion": 2, "postpone": 3, "decline": 4}
UNDERWRITING = [
    ("thyroid_1_2", "medical", "exclusion"), ("thyroid_1_2", "critical_illness", "standard"), ("thyroid_1_2", "life", "standard"),
    ("thyroid_3", "medical", "exclusion"), ("thyroid_3", "critical_illness", "exclusion"), ("thyroid_3", "life", "standard"),
    ("thyroid_4", "medical", "decline"), ("thyroid_4", "critical_illness", "decline"), ("thyroid_4", "life", "loading"),
    ("hypertension_1", "medical", "loading"), ("hypertension_1", "critical_illness", "loading"), ("hypertension_1", "life", "standard"),
    ("hypertension_2", "medical", "decline"), ("hypertension_2", "critical_illness", "decline"), ("hypertension_2", "life", "loading"),
    ("glucose", "medical", "decline"), ("glucose", "critical_illness", "decline"), ("glucose", "life", "loading"),
    ("bmi_30", "medical", "loading"), ("bmi_30", "critical_illness", "loading"), ("bmi_30", "life", "standard"),
    ("bmi_35", "medical", "decline"), ("bmi_35", "critical_illness", "decline"), ("bmi_35", "life", "loading"),
    ("fatty_liver", "medical", "standard"), ("fatty_liver", "critical_illness", "standard"), ("fatty_liver", "life", "standard")]
SUBSTITUTES = {"medical": "cancer_medical", "critical_illness": "cancer_cover"}


def _gap_class(ratio: Column) -> Column:
    return (F.when(ratio < 0.2, "severe").when(ratio < 0.5, "short").when(ratio < 0.8, "basic")
            .when(ratio < 1.2, "adequate").otherwise("excess"))


def coverage_gaps(df: DataFrame) -> DataFrame:
    """Seven dimensions per user: ideal, gap, signed surplus, class, severity, priority.

    Expects income, expense, mortgage, other_debt, education, cap and have_* columns.
    """
    inc, exp, mort = F.col("income"), F.col("expense"), F.col("mortgage")
    def top(*c): return F.greatest(*[x if isinstance(x, Column) else F.lit(float(x)) for x in c])
    dims = [("medical", top(F.col("cap") * 2, exp * 5, 200_000), 1, "have_medical"),
            ("critical_illness", top(300_000, inc * 3), 1, "have_ci"),
            ("accident", top(500_000, inc * 10), 3, "have_accident"),
            ("life", top(mort + F.col("other_debt") + exp * 10, inc * 5), 2, "have_life"),
            ("property", top(mort * 0.5, 300_000), 4, "have_property"),
            ("pension", exp * 15, 2, None),
            ("education", F.when(F.col("education") > 0, F.col("education") * 1.5).otherwise(0.0), 4, None)]
    rows = F.explode(F.array(*[F.struct(
        F.lit(d).alias("dimension"), top(ideal, 50_000).alias("ideal"), F.lit(base).alias("base"),
        (F.col(have).cast("double") if have else F.lit(0.0)).alias("existing")) for d, ideal, base, have in dims]))
    long = df.select("user_id", rows.alias("g")).select("user_id", "g.*")
    ratio = F.col("existing") / F.col("ideal")
    long = long.withColumns({"gap": F.greatest(F.lit(0.0), F.col("ideal") - F.col("existing")),
                             "surplus": F.col("existing") - F.col("ideal"), "gap_class": _gap_class(ratio)})
    enough = F.col("gap_class").isin("adequate", "excess")
    return long.withColumns({
        "severity": F.when(F.col("gap_class") == "excess", 0.0).otherwise(F.least(F.lit(100.0), F.col("gap") / F.col("ideal") * 100)),
        "minimum": F.col("ideal") * 0.5,
        "priority": F.least(F.lit(5), F.col("base") + F.when(enough, 0).otherwise(1))}).drop("base")


def ci_gap(df: DataFrame, model: str = "agent") -> DataFrame:
    """Critical-illness need under one of three published rules, with components."""
    inc = F.col("income")
    if model == "agent":
        treat, loss, rehab = F.lit(400_000.0), inc * 4, F.lit(150_000.0)
    elif model == "actuarial":
        cost = F.lit(CITY_TREATMENT_COST[3])
        for tier in (2, 1):
            cost = F.when(F.col("city_tier") == tier, CITY_TREATMENT_COST[tier]).otherwise(cost)
        treat, loss, rehab = cost, inc * 5, F.lit(150_000.0)
    elif model == "threshold":
        treat, loss, rehab = F.greatest(F.lit(300_000.0) - inc * 3, F.lit(0.0)), inc * 3, F.lit(0.0)
    else:
        raise ValueError(f"unknown model: {model}")
    return df.withColumns({"treatment_cost": treat, "income_loss": loss, "rehab_cost": rehab}).withColumn(
        "required", F.col("treatment_cost") + F.col("income_loss") + F.col("rehab_cost")).withColumn(
        "ci_gap", F.greatest(F.lit(0.0), F.col("required") - F.col("have_ci"))).withColumn(
        "gap_ratio", F.when(F.col("required") > 0, F.col("ci_gap") / F.col("required")).otherwise(0.0))


def life_gap(df: DataFrame, emergency: float = 100_000.0, funeral: float = 75_000.0) -> DataFrame:
    """Liabilities + living cost to the youngest child's 22nd year (at least 10) + future duties - assets."""
    years = F.when(F.col("children") > 0, F.greatest(F.lit(10), 22 - F.col("youngest_age"))).otherwise(0)
    need = (F.col("mortgage") + F.col("other_debt") + F.col("expense") * years + F.col("education")
            + F.col("elder_cost") + F.when((F.col("children") > 0) | (F.col("mortgage") > 0), emergency).otherwise(0.0) + funeral)
    return df.withColumn("life_need", need).withColumn(
        "life_gap", F.greatest(F.lit(0.0), F.col("life_need") - F.col("have_life") - F.col("savings")))


def saving_target(df: DataFrame, inflation: float = 0.03, target_rate: float = 0.7, state_rate: float = 0.4,
                  retire_at: int = 60, live_to: int = 85) -> DataFrame:
    """Inflated education goal and pension shortfall with the yearly saving each needs."""
    edu_years = F.greatest(F.lit(1), 18 - F.col("youngest_age"))
    goal = F.col("education_goal") * F.pow(F.lit(1 + inflation), edu_years)
    work_years = F.greatest(F.lit(1), retire_at - F.col("age"))
    final = F.col("income") * F.pow(F.lit(1 + inflation), work_years)
    short = final * F.lit(target_rate - state_rate)
    return df.withColumns({"education_target": goal, "education_yearly": goal / edu_years,
                           "pension_shortfall": short, "pension_target": short * F.lit(live_to - retire_at),
                           "pension_yearly": short * F.lit(live_to - retire_at) / work_years})


def reimbursement(bills: DataFrame, params: DataFrame, key: str, default: dict[str, float], prepay: float = 0.15,
                  cat_deductible: float = 30_404.0, commercial_deductible: float = 10_000.0,
                  city_deductible: float = 20_000.0, city_rate: float = 0.5) -> DataFrame:
    """Layered payout: basic -> catastrophic -> city supplementary -> commercial.

    ``bills`` has class_a, class_b, class_c, has_city, has_commercial; ``params``
    has deductible, cap and rate per key, with a default row.
    """
    from .joins import lookup
    b = lookup(bills, params, key, default)
    zero = F.lit(0.0)
    total = F.col("class_a") + F.col("class_b") + F.col("class_c")
    covered = F.col("class_a") + F.col("class_b") * (1 - prepay)
    b = b.withColumns({"total": total, "covered": covered})
    b = b.withColumn("basic", F.least(F.greatest(zero, F.col("covered") - F.col("deductible")) * F.col("rate"), F.col("cap")))
    b = b.withColumn("catastrophic", bracket_sum(F.greatest(zero, F.col("covered") - F.col("basic") - cat_deductible), CATASTROPHIC_STEPS))
    left = F.col("total") - F.col("basic") - F.col("catastrophic")
    b = b.withColumn("city", F.when(F.col("has_city") == 1, F.greatest(zero, left - city_deductible) * city_rate).otherwise(0.0))
    left = left - F.col("city")
    b = b.withColumn("commercial", F.when(F.col("has_commercial") == 1, F.greatest(zero, left - commercial_deductible)).otherwise(0.0))
    b = b.withColumn("self_paid", left - F.col("commercial"))
    return b.withColumn("gap_level", F.when(F.col("self_paid") <= 10_000, "safe").when(F.col("self_paid") <= 50_000, "warning").otherwise("severe"))


def claim_payout(claims: DataFrame) -> DataFrame:
    """(cost - social - other - deductible) x rate; 60% when social insurance was not used."""
    rate = F.when(F.col("social_paid") > 0, 1.0).otherwise(0.6)
    base = F.col("cost") - F.col("social_paid") - F.col("other_paid") - F.col("deductible")
    return claims.withColumns({"payout_rate": rate, "payout": F.greatest(F.lit(0.0), base) * rate})


def denial_breakdown(claims: DataFrame, code: str) -> DataFrame:
    """Counts by class and code with subtotals (level 0 code, 1 class, 3 total)."""
    m = F.create_map(*[x for k, v in DENIAL_CLASSES.items() for x in (F.lit(k), F.lit(v))])
    tagged = claims.withColumns({"denial_class": F.coalesce(F.try_element_at(m, F.substring(code, 1, 1)), F.lit("other")),
                                 "denial_code": F.col(code)})
    return tagged.rollup("denial_class", "denial_code").agg(
        F.grouping_id("denial_class", "denial_code").cast("int").alias("level"), F.count("*").alias("n"))


def coverage_anomalies(df: DataFrame) -> DataFrame:
    """Missing, under half, mismatched and duplicate cover with severity, one row each.

    One pass: each user yields an array of the rules that hold.
    """
    def rule(kind, detail, cond, severity):
        return F.when(cond, F.struct(F.lit(kind).alias("anomaly"), F.lit(detail).alias("detail"), F.lit(severity).alias("severity")))
    out = []
    for p, sev in (("medical", "critical"), ("critical_illness", "high"), ("accident", "high"), ("life", "critical")):
        have, want = F.col(f"sum_{p}"), F.col(f"want_{p}")
        out += [rule("missing", p, have <= 0, sev), rule("insufficient", p, (have > 0) & (have < want * 0.5), "high"),
                rule("duplicate", p, F.col(f"n_{p}") > 1, "medium")]
    out += [rule("mismatch", "elder_term_life", (F.col("age") >= 65) & (F.col("sum_life") > 0), "medium"),
            rule("mismatch", "young_annuity_first", (F.col("age") < 35) & (F.col("sum_annuity") > 0) & (F.col("sum_medical") <= 0), "medium")]
    return df.select("user_id", F.explode(F.array_compact(F.array(*out))).alias("a")).select("user_id", "a.*")


def calibrate_gaps(gaps: DataFrame, params: DataFrame, key: str = "segment") -> DataFrame:
    """gap x (1 + multiplier) + ATE x (driver - base); unknown segments stay raw.

    ``params`` holds one row per segment and its size is checked before broadcast.
    """
    m, a, b = (F.coalesce(c, F.lit(0.0)) for c in ("multiplier", "ate", "base"))
    return gaps.join(small(materialize(params)), key, "left").withColumn(
        "gap_adjusted", F.greatest(F.lit(0.0), F.col("gap") * (1 + m) + a * (F.col("driver") - b)))


def plan_catalogue(spark) -> DataFrame:
    return spark.createDataFrame(PLAN_CATALOGUE, "plan string, product string, kind string, cover double, price double")


def plans(gaps: DataFrame, income: str = "income", low: float = 0.05, high: float = 0.15) -> DataFrame:
    """Three plans per user: premium of products with an open gap, share of income, fits budget.

    ``gaps`` has user_id, income and gap_<product> columns.  The catalogue is a
    fixed list, so each plan is a conditional sum and no join is needed.
    """
    def total(plan, kind=None):
        parts = [F.when(F.col(f"gap_{p}") > 0, F.lit(price)).otherwise(0.0) for pl, p, k, _, price in PLAN_CATALOGUE
                 if pl == plan and (kind is None or k == kind)]
        return reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0)
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("plan"), total(p).alias("total_premium"),
                                        total(p, "protection").alias("protection"), total(p, "savings").alias("savings"))
                               for p in ("minimal", "balanced", "premium")]))
    out = gaps.select("user_id", income, rows.alias("p")).select("user_id", income, "p.*")
    pct = F.when(F.col(income) > 0, F.col("total_premium") / F.col(income)).otherwise(F.lit(None).cast("double"))
    return out.withColumn("income_share", pct).withColumn(
        "fits_budget", F.coalesce(F.col("income_share") <= high, F.lit(False)))


def budget_check(df: DataFrame) -> DataFrame:
    """heavy above 20% of income, low below 5%, and savings above protection."""
    share = F.col("total_premium") / F.nullif(F.col("income"), F.lit(0.0))
    return df.withColumns({
        "load": F.when(share > 0.20, "heavy").when(share < 0.05, "low").when(share.isNull(), "unknown").otherwise("normal"),
        "savings_first": F.col("savings") > F.col("protection")})


# Share of a protection budget by product (low, high).
BUDGET_SHARES = {"medical": (0.10, 0.15), "accident": (0.05, 0.10), "critical_illness": (0.35, 0.45),
                 "life": (0.25, 0.35), "property": (0.0, 0.05)}


def budget_allocation(df: DataFrame, budget: str) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("product"), (F.col(budget) * lo).alias("low"), (F.col(budget) * hi).alias("high"))
                               for p, (lo, hi) in BUDGET_SHARES.items()]))
    return df.select("user_id", rows.alias("b")).select("user_id", "b.*")


def recommend(tags: DataFrame) -> DataFrame:
    """Product per need tag in gated order: a tier opens once every lower tier is listed or covered.

    ``tags`` has user_id and tag (only open needs), so lower tiers are always
    either covered or recommended alongside.
    """
    rules = tags.sparkSession.createDataFrame(NEED_PRODUCTS, "tag string, tier int, rank int, product string, budget_product string")
    hit = tags.join(F.broadcast(rules), "tag")
    w = Window.partitionBy("user_id").orderBy("tier", "rank")  # at most six rows per user
    return hit.withColumn("priority", F.row_number().over(w))


def eligible(customers: DataFrame) -> DataFrame:
    """(user_id, product, waiting_days) where age and occupation class pass."""
    rows = F.explode(F.array_compact(F.array(*[
        F.when(F.col("age").between(lo, hi) & (F.col("occupation_class") <= cls),
               F.struct(F.lit(p).alias("product"), F.lit(wait).alias("waiting_days")))
        for p, lo, hi, cls, wait in PRODUCT_RULES])))
    return customers.select("user_id", rows.alias("r")).select("user_id", "r.*")


def underwrite(findings: DataFrame) -> DataFrame:
    """Worst outcome per user and product over all findings, with a substitute on refusal."""
    spark = findings.sparkSession
    rules = spark.createDataFrame([(f, p, o, OUTCOME_SEVERITY[o]) for f, p, o in UNDERWRITING],
                                  "finding string, product string, outcome string, severity int")
    worst = findings.join(F.broadcast(rules), "finding").groupBy("user_id", "product").agg(
        F.max_by("outcome", "severity").alias("outcome"), F.max("severity").alias("severity"), F.count("*").alias("n_findings"))
    sub = F.lit(None).cast("string")
    for p, s in SUBSTITUTES.items():
        sub = F.when((F.col("product") == p) & (F.col("severity") >= 3), s).otherwise(sub)
    return worst.withColumn("substitute", F.coalesce(sub, F.lit("none")))


def illustrate(policies: DataFrame, premium: str, pay_years: int = 10, rates: dict[str, float] | None = None,
               years: tuple[int, ...] = (5, 10, 15, 20, 30)) -> DataFrame:
    """Value at each year for low/mid/high rates, with total paid and a break-even flag."""
    rates = rates or {"low": 0.02, "mid": 0.045, "high": 0.06}
    rows = []
    for label, r in rates.items():
        for y in years:
            paid = min(y, pay_years)
            factor = sum((1 + r) ** (y - i) for i in range(paid)) * 0.9
            rows.append(F.struct(F.lit(label).alias("scenario"), F.lit(y).alias("year"),
                                 (F.col(premium) * F.lit(float(paid))).alias("total_paid"),
                                 (F.col(premium) * F.lit(factor)).alias("value")))
    return (policies.select("policy_id", F.explode(F.array(*rows)).alias("i")).select("policy_id", "i.*")
            .withColumn("broke_even", F.col("value") >= F.col("total_paid")))
