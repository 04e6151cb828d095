"""Churn events, attribution, recovery plans and experiments."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import chi2_sf, normal_quantile, t_two_sided
from ..sources.workspace import materialize
from .joins import small, within_interval
from .ordered import SLICE_ROWS, argmax_by, carry, seconds
from .policy import SHORT_TERM, day

CAUSES = ("price_sensitivity", "product_dissatisfaction", "need_change", "forgetfulness", "claim_dispute")
# Cause -> (strategy, channel).
STRATEGIES = {"price_sensitivity": ("coupon", "sms_push"), "product_dissatisfaction": ("product_switch", "agent"),
              "need_change": ("gap_reactivation", "wechat_sms"), "forgetfulness": ("simple_reminder", "sms_push"),
              "claim_dispute": ("manual_followup", "phone")}


def churn_events(policies: DataFrame, asof: str, days: int = 30, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """expiry_no_renewal, lapsed and surrendered events with what was lost.

    A short-term policy counts once it is more than ``days`` past expiry with no
    policy of the same user starting in (expiry, expiry + days].
    """
    past = F.datediff(day(asof), F.col("expiry_date"))
    starts = policies.groupBy("user_id", F.col("effective_date").alias("renewed_on")).agg(F.count("*").alias("n_started"))
    short = policies.filter(F.col("product").isin(*SHORT_TERM) & (past > days) & (F.col("status") != "surrendered"))
    short = within_interval(short, starts, "user_id", "expiry_date", "renewed_on", days, ["n_started"], slice_rows)
    short = short.filter(~F.col("matched")).withColumn("churn_type", F.lit("expiry_no_renewal"))
    lapsed = policies.filter(~F.col("product").isin(*SHORT_TERM) & (F.col("status") == "lapsed") & (past >= 0)).withColumn(
        "churn_type", F.lit("lapsed"))
    gone = policies.filter((F.col("status") == "surrendered") & (F.col("effective_date") <= day(asof))).withColumn("churn_type", F.lit("surrendered"))
    cols = ["user_id", "policy_id", "product", "churn_type", F.greatest(past, F.lit(0)).alias("days_past_expiry"),
            F.col("sum_insured").alias("sum_insured_lost"), F.col("premium").alias("annual_premium_lost")]
    return short.select(*cols).unionByName(lapsed.select(*cols)).unionByName(gone.select(*cols))


def churn_signals(users: DataFrame) -> DataFrame:
    """Long table (user_id, cause, intensity, n_signals) for the five causes.

    Expects premium_ratio, policy_count, complaints, switches, denied_claims,
    n_claims, n_30d, tenure_years, family_changed, surrendered.
    """
    def flags(*conds: Column) -> Column:
        return sum((c.cast("int") for c in conds), F.lit(0))
    c = F.col
    signals = {
        "price_sensitivity": flags(c("premium_ratio") > 0.10, c("policy_count") <= 2, c("n_claims") == 0, c("tenure_years") < 2),
        "product_dissatisfaction": flags(c("switches") > 0, c("complaints") > 0, c("policy_count").between(2, 3), c("tenure_years").between(2, 3)),
        "need_change": flags(c("family_changed") == 1, c("switches") > 1, c("complaints") == 0, c("surrendered") == 1),
        "forgetfulness": flags(c("n_30d") == 0, c("complaints") == 0, c("policy_count") >= 3, c("surrendered") == 0),
        "claim_dispute": flags(c("denied_claims") > 0, c("n_claims") > 0, c("complaints") > 0, c("n_30d") == 0)}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("cause"), v.alias("n_signals"), (v / F.lit(4.0)).alias("intensity"))
                               for k, v in signals.items()]))
    return users.select("user_id", "segment", rows.alias("s")).select("user_id", "segment", "s.*")


def attribution_scores(signals: DataFrame, params: DataFrame) -> DataFrame:
    """Segment effect x individual intensity; the parameter table is size-checked."""
    return signals.join(small(materialize(params)), ["segment", "cause"], "left").withColumn(
        "score", F.coalesce("ate", F.lit(0.0)) * F.col("intensity"))


def attribute_churn(signals: DataFrame, params: DataFrame, min_signals: int = 3) -> DataFrame:
    """Primary cause per user; ``conclusive`` needs enough supporting signals."""
    scored = attribution_scores(signals, params)
    best = argmax_by(scored, "user_id", "cause", "score")
    support = scored.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("cause", "n_signals"))).alias("m"))  # five entries
    return (best.join(support, "user_id").withColumn("n_signals", F.element_at("m", F.col("cause")))
            .withColumn("conclusive", F.col("n_signals") >= min_signals)
            .select("user_id", F.col("cause").alias("primary_cause"), "score", "n_signals", "conclusive"))


def inertia_score(df: DataFrame) -> DataFrame:
    """years x 0.1 + auto debit 0.3 + custody 0.1 plus event shocks."""
    shock = (F.when(F.col("claim_outcome") == "paid", 0.3).when(F.col("claim_outcome") == "disputed", -0.65).otherwise(0.0)
             + F.when(F.col("discontinued") == 1, -0.4).otherwise(0.0) + F.when(F.col("rival_contact") == 1, -0.2).otherwise(0.0))
    return df.withColumn("inertia", F.col("renewal_years") * 0.1 + F.when(F.col("auto_debit") == 1, 0.3).otherwise(0.0)
                         + F.when(F.col("custody") == 1, 0.1).otherwise(0.0)).withColumn("renewal_drive", F.col("inertia") + shock)


def recovery_plan(attribution: DataFrame, gaps: DataFrame, asof: str, gap_cutoff: float, follow_days: int = 7) -> DataFrame:
    """Strategy by cause; a large open gap overrides to gap reactivation.

    ``gaps`` has one row per user with total_gap.
    """
    strategy, channel = F.lit("simple_reminder"), F.lit("sms_push")
    for cause, (s, ch) in STRATEGIES.items():
        strategy = F.when(F.col("primary_cause") == cause, s).otherwise(strategy)
        channel = F.when(F.col("primary_cause") == cause, ch).otherwise(channel)
    override = (F.coalesce("total_gap", F.lit(0.0)) > gap_cutoff) & ~F.col("primary_cause").isin("claim_dispute")
    return (attribution.join(gaps, "user_id", "left").withColumns({
        "override_to_gap": override, "strategy": F.when(override, "gap_reactivation").otherwise(strategy),
        "channel": channel, "follow_up_date": F.date_add(day(asof), follow_days)}))


def renewal_cohorts(policies: DataFrame, days: int = 30, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Renewal rate by product and policy year of the user's product history.

    A policy renews when the next one of the same user and product starts no
    later than ``days`` after its expiry.
    """
    work = policies.withColumn("__pos", seconds("effective_date"))
    nxt = carry(work, ["user_id", "product"], ["__pos", "policy_id"], {"next_start": F.col("effective_date")},
                direction="ahead", slice_rows=slice_rows)
    first = policies.groupBy("user_id", "product").agg(F.min("effective_date").alias("first_start"))
    year = F.floor(F.datediff("effective_date", "first_start") / 365).cast("int") + 1
    renewed = F.coalesce(F.datediff("next_start", "expiry_date") <= days, F.lit(False))
    return (nxt.join(first, ["user_id", "product"]).groupBy("product", year.alias("policy_year"))
            .agg(F.count("*").alias("n"), F.count_if(renewed).alias("renewed"))
            .withColumn("renewal_rate", F.col("renewed") / F.col("n")))


def ab_assign(users: DataFrame, key: str, arms: tuple[str, ...] = ("control", "treatment"), hashed: bool = False) -> DataFrame:
    """Stable arm from the user id; the same user always lands in the same arm."""
    h = F.xxhash64(key) if hashed else F.col(key)
    return users.withColumn("arm", F.element_at(F.array(*[F.lit(a) for a in arms]), (F.pmod(h, F.lit(len(arms))) + 1).cast("int")))


def ab_aggregates(df: DataFrame, arm: str, converted: str, metric: str, *segment: str) -> DataFrame:
    """Chi-square (2x2) on conversion and Welch t on the metric, per segment, lazily."""
    def side(a):
        on = F.col(arm) == a
        return [F.count_if(on).alias(f"n_{a}"), F.count_if(on & (F.col(converted) == 1)).alias(f"k_{a}"),
                F.avg(F.when(on, F.col(metric))).alias(f"m_{a}"), F.var_samp(F.when(on, F.col(metric))).alias(f"v_{a}")]
    g = df.groupBy(*segment).agg(*side("control"), *side("treatment"))
    n0, n1, k0, k1 = (F.col(c).cast("double") for c in ("n_control", "n_treatment", "k_control", "k_treatment"))
    n = n0 + n1
    k = k0 + k1
    den = n0 * n1 * k * (n - k)
    chi2 = F.when(den > 0, n * F.pow(k1 * (n0 - k0) - k0 * (n1 - k1), 2) / den).otherwise(0.0)
    a, b = F.col("v_control") / n0, F.col("v_treatment") / n1
    return g.withColumns({
        "rate_control": k0 / n0, "rate_treatment": k1 / n1, "chi2": chi2,
        "t_stat": (F.col("m_treatment") - F.col("m_control")) / F.sqrt(a + b),
        "t_df": F.pow(a + b, 2) / (a * a / (n0 - 1) + b * b / (n1 - 1))})


def ab_test(df: DataFrame, arm: str, converted: str, metric: str, *segment: str) -> DataFrame:
    """Adds p-values and the decision (promote / stop / hold), vectorized per batch of segments."""
    @F.pandas_udf("double")
    def chi_p(x: pd.Series) -> pd.Series:
        return x.map(lambda v: chi2_sf(v, 1))

    @F.pandas_udf("double")
    def t_p(t: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(a, b) for a, b in zip(t, d)])

    out = ab_aggregates(df, arm, converted, metric, *segment).withColumns(
        {"p_conversion": chi_p("chi2"), "p_metric": t_p("t_stat", "t_df")})
    better = F.col("rate_treatment") > F.col("rate_control")
    return out.withColumn("decision", F.when((F.col("p_conversion") < 0.05) & better, "promote")
                          .when((F.col("p_conversion") < 0.05) & ~better, "stop").otherwise("hold"))


def ab_sample_size(df: DataFrame, base: str, mde: float = 0.05, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Closed-form size per arm for a two-proportion test; one row per segment."""
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    p1 = F.col(base)
    p2 = p1 + F.lit(mde)
    return df.withColumn("n_per_arm", F.ceil(F.lit(z * z) * (p1 * (1 - p1) + p2 * (1 - p2)) / F.lit(mde * mde)).cast("long"))


def min_sample(rate: float, mde: float = 0.05, alpha: float = 0.05, power: float = 0.8) -> int:
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    p2 = rate + mde
    return math.ceil(z * z * (rate * (1 - rate) + p2 * (1 - p2)) / mde ** 2)
