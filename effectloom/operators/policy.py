"""Policy ledger: states, alerts, schedules, lapse, quotes and family reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRACE_DAYS = 60
REINSTATE_MONTHS = 24
SHORT_TERM = ("medical", "accident")

# Day offsets relative to the due date, by rule set.
REMINDER_OFFSETS = {
    "operations": [(-30, "first"), (-15, "second"), (-7, "urgent"), (-1, "last"), (0, "confirm"),
                   (15, "grace"), (45, "countdown"), (59, "final")],
    "orchestrator": [(-7, "debit_reminder"), (0, "confirm"), (30, "grace_30"), (55, "grace_55")],
}
# Frequency -> (payments per year, interval days, share of the annual premium).
PAYMENT_MODES = {"annual": (1, 365, 1.0), "half": (2, 182, 0.52), "quarter": (4, 90, 0.265), "month": (12, 30, 0.09)}


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def policy_state(policies: DataFrame, asof: str) -> DataFrame:
    """pending / active / grace / terminated / other from dates and status."""
    to_expiry = F.datediff("expiry_date", day(asof))
    state = (F.when(F.col("status") == "surrendered", "other")
             .when(F.col("effective_date") > day(asof), "pending")
             .when(to_expiry >= 0, "active")
             .when(to_expiry >= -GRACE_DAYS, "grace").otherwise("terminated"))
    return policies.withColumns({
        "days_to_expiry": to_expiry, "days_past_expiry": F.greatest(-to_expiry, F.lit(0)),
        "is_short_term": F.col("product").isin(*SHORT_TERM), "inferred_state": state})


def ledger_summary(states: DataFrame) -> DataFrame:
    kinds = ["active", "pending", "grace", "terminated", "other"]
    return states.groupBy("user_id").agg(F.count("*").alias("total"), *[
        F.count_if(F.col("inferred_state") == k).alias(k) for k in kinds])


def expiry_alerts(policies: DataFrame, asof: str) -> DataFrame:
    """Short-term policies expiring in 0..30 days; expired ones belong to lapse detection."""
    left = F.datediff("expiry_date", day(asof))
    level = F.when(left <= 7, "red").when(left <= 15, "yellow").otherwise("green")
    action = (F.when(level == "red", "urgent_renewal").when(level == "yellow", "renewal_with_risk_notice")
              .otherwise("renewal_reminder"))
    return (policies.filter(F.col("product").isin(*SHORT_TERM) & left.between(0, 30))
            .select("user_id", "policy_id", left.alias("days_to_expiry"), level.alias("alert_level"),
                    action.alias("recommended_action"),
                    F.concat_ws("_", F.lit("EVT" + asof.replace("-", "")), F.col("policy_id").cast("string")).alias("event_id")))


def payment_schedule(policies: DataFrame, asof: str) -> DataFrame:
    """Due rows up to ``asof``: year index x period, for as long as the policy runs."""
    mode = F.create_map(*[x for k, (n, step, share) in PAYMENT_MODES.items() for x in (
        F.lit(k), F.struct(F.lit(n).alias("n"), F.lit(step).alias("step"), F.lit(share).alias("share")))])
    years = F.greatest(F.lit(1), F.floor(F.datediff(day(asof), F.col("effective_date")) / 365).cast("int") + 1)
    return (policies.withColumn("__m", F.element_at(mode, F.col("pay_freq")))
            .withColumn("year_no", F.explode(F.sequence(F.lit(0), years - 1)))
            .withColumn("period_no", F.explode(F.sequence(F.lit(0), F.col("__m.n") - 1)))
            .withColumn("due_date", F.date_add("effective_date", F.col("year_no") * 365 + F.col("period_no") * F.col("__m.step")))
            .filter(F.col("due_date") <= day(asof))
            .withColumn("due_amount", F.col("premium") * F.col("__m.share")).drop("__m"))


def payment_reminders(schedule: DataFrame, asof: str, rules: str = "operations") -> DataFrame:
    """Dues whose offset lands on ``asof``; the offset list is a short CASE."""
    past = F.datediff(day(asof), F.col("due_date"))
    kind = F.lit(None).cast("string")
    for offset, name in REMINDER_OFFSETS[rules]:
        kind = F.when(past == offset, name).otherwise(kind)
    return schedule.withColumns({"offset_days": past, "reminder": kind}).filter(F.col("reminder").isNotNull())


def lapse_state(schedule: DataFrame, payments: DataFrame, asof: str) -> DataFrame:
    """Per due: paid / due / grace / lapsed / terminated with its boundary dates.

    ``payments`` has policy_id, due_date and paid_date, one row per payment;
    those made after ``asof`` are not known yet.
    """
    paid = payments.filter(F.col("paid_date") <= day(asof)).groupBy("policy_id", "due_date").agg(F.min("paid_date").alias("paid_date"))
    end = day(asof)
    grace_end = F.date_add("due_date", GRACE_DAYS)
    window_end = F.add_months(grace_end, REINSTATE_MONTHS)
    state = (F.when(F.col("paid_date").isNotNull() & (F.col("paid_date") <= F.col("grace_end")), "paid")
             .when(F.col("paid_date").isNotNull() & (F.col("paid_date") <= F.col("reinstate_end")), "reinstated")
             .when(end <= F.col("due_date"), "due").when(end <= F.col("grace_end"), "grace")
             .when(end <= F.col("reinstate_end"), "lapsed").otherwise("terminated"))
    return (schedule.join(paid, ["policy_id", "due_date"], "left")
            .withColumns({"grace_end": grace_end, "reinstate_end": window_end}).withColumn("state", state))


def reinstatement_due(lapsed: DataFrame, rate: float, asof: str) -> DataFrame:
    """Arrears with compound interest from each due date, per policy."""
    grown = F.col("due_amount") * F.pow(F.lit(1.0 + rate), F.datediff(day(asof), F.col("due_date")) / F.lit(365.0))
    return lapsed.filter(F.col("state") == "lapsed").groupBy("policy_id").agg(
        F.sum("due_amount").alias("arrears"), F.sum(grown).alias("amount_due"))


def surrender_quote(policies: DataFrame, asof: str, cooling_days: int = 15, fee: float = 10.0, loan_share: float = 0.8) -> DataFrame:
    """Refund kind, surrender value and loan limit.

    Expects premiums_paid and cash_value; one-year policies have no cooling-off.
    """
    held = F.datediff(day(asof), F.col("effective_date"))
    long_term = ~F.col("product").isin(*SHORT_TERM)
    live = (held >= 0) & (F.col("expiry_date") >= day(asof))
    kind = (F.when(~live, "none").when(long_term & (held <= cooling_days), "cooling_off")
            .when(F.col("has_claim") == 1, "restricted").otherwise("cash_value"))
    value = (F.when(kind == "cooling_off", F.greatest(F.col("premiums_paid") - fee, F.lit(0.0)))
             .when(kind == "cash_value", F.col("cash_value")).otherwise(0.0))
    loan = F.when(live & (held >= 365) & (F.col("cash_value") * loan_share >= 1000), F.col("cash_value") * loan_share).otherwise(0.0)
    return policies.withColumns({"refund_kind": kind, "surrender_value": value, "loan_limit": loan})


def family_report(policies: DataFrame, asof: str, products: list[str]) -> DataFrame:
    """Per family and person: policies, premium and cover by product, with level tag."""
    live = policies.filter((F.col("effective_date") <= day(asof)) & (F.col("expiry_date") >= day(asof)))
    return live.rollup("user_id", "person").agg(
        F.grouping_id("user_id", "person").cast("int").alias("level"), F.count("*").alias("policies"),
        F.sum("premium").alias("premium"),
        *[F.coalesce(F.sum(F.when(F.col("product") == p, F.col("sum_insured"))), F.lit(0.0)).alias(p) for p in products])


def cover_alerts(policies: DataFrame, asof: str, required: list[str]) -> DataFrame:
    """Persons with any policy on file that lack a required product in force."""
    persons = policies.select("user_id", "person").distinct()
    needed = persons.withColumn("product", F.explode(F.array(*[F.lit(p) for p in required])))
    live = policies.filter((F.col("effective_date") <= day(asof)) & (F.col("expiry_date") >= day(asof)))
    return needed.join(live.select("user_id", "person", "product").distinct(), ["user_id", "person", "product"], "left_anti")


def duplicate_cover(policies: DataFrame, asof: str) -> DataFrame:
    """Same insured and product with two or more policies in force."""
    live = (F.col("effective_date") <= day(asof)) & (F.col("expiry_date") >= day(asof))
    return (policies.filter(live).groupBy("user_id", "person", "product")
            .agg(F.count("*").alias("n"), F.sum("premium").alias("premium")).filter(F.col("n") > 1))


def apply_waiver(schedule: DataFrame, waivers: DataFrame) -> DataFrame:
    """Dues on or after the waiver date count as paid at zero."""
    w = waivers.groupBy("policy_id").agg(F.min("waived_from").alias("waived_from"))
    hit = F.coalesce(F.col("due_date") >= F.col("waived_from"), F.lit(False))
    return schedule.join(w, "policy_id", "left").withColumns(
        {"waived": hit, "payable": F.when(hit, 0.0).otherwise(F.col("due_amount"))})
