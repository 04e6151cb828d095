"""Customer profiles: tags, segments, propensities and incremental refresh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import ENGAGEMENT_POINTS, code_map, engagement_tier, sigmoid
from .ordered import activity_tier
from .profiling import top_k_values
from .typing import mark_missing

PRODUCTS = ("medical", "critical_illness", "accident", "life", "annuity")


def policy_rollup(policies: DataFrame, asof: str, products: tuple[str, ...] = PRODUCTS) -> DataFrame:
    """Per user: counts, premium and the product coverage matrix of in-force policies.

    The matrix map has one entry per product, never one per policy.
    """
    live = (F.col("effective_date") <= F.lit(asof).cast("date")) & (F.col("expiry_date") >= F.lit(asof).cast("date"))
    def on(p): return live & (F.col("product") == p)
    aggs = [F.count("*").alias("policy_count"), F.count_if(live).alias("active_count"),
            F.sum("premium").alias("total_premium")]
    for p in products:
        aggs += [F.count_if(on(p)).alias(f"n_{p}"), F.coalesce(F.sum(F.when(on(p), F.col("sum_insured"))), F.lit(0.0)).alias(f"sum_{p}")]
    g = policies.groupBy("user_id").agg(*aggs)
    matrix = F.create_map(*[x for p in products for x in (F.lit(p), F.struct(
        (F.col(f"n_{p}") > 0).alias("has_coverage"), F.col(f"sum_{p}").alias("sum_insured"), F.col(f"n_{p}").alias("count")))])
    return g.withColumn("coverage_matrix", matrix)


def behaviour_rollup(events: DataFrame, asof: str, travel_kinds: Sequence[str] = ("travel",)) -> DataFrame:
    """Per user: last event, 30/90-day counts, travel events, dormancy score and top three event types."""
    day = F.to_date("ts")
    end = F.lit(asof).cast("date")
    seen = events.filter(day <= end)
    g = seen.groupBy("user_id").agg(
        F.max("ts").alias("last_interaction"), F.count("*").alias("total_events"),
        F.count_if(F.col("event_type").isin(*travel_kinds)).alias("travel_events"),
        F.count_if(F.datediff(end, day) < 30).alias("n_30d"), F.count_if(F.datediff(end, day) < 90).alias("n_90d"))
    tops = (top_k_values(seen, "user_id", "event_type", 3).groupBy("user_id")
            .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("top_event_types")))
    days = F.datediff(end, F.to_date("last_interaction"))
    return (g.join(tops, "user_id", "left").withColumn("days_since", days)
            .withColumns({"activity_tier": activity_tier(F.col("days_since")),
                          "dormancy_score": dormancy_score(F.col("days_since"), F.col("n_30d")),
                          "intent_level": intent_level(F.col("n_30d"), F.col("days_since"))}))


def dormancy_score(days_since: Column, n_30d: Column) -> Column:
    """0-100 activity score from recency and 30-day frequency; 30 or less is dormant."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 60.0 - F.coalesce(days_since, F.lit(9999)) * 60.0 / 90.0)
                   + F.least(F.coalesce(n_30d, F.lit(0)), F.lit(40)) * 1.0)


def intent_level(n_30d: Column, days_since: Column) -> Column:
    return (F.when((n_30d >= 5) & (days_since <= 7), "high").when((n_30d >= 1) & (days_since <= 30), "medium").otherwise("low"))


def consult_preference(events: DataFrame, kind: str, k: int = 3) -> DataFrame:
    """Top-k consulted kinds per user, ties by name."""
    return top_k_values(events, "user_id", kind, k)


def rfm(df: DataFrame, days_since: str, n_policies: str, premium: str) -> DataFrame:
    """Recent within 90 days, at least 3 policies, premium above 20 000."""
    r = F.coalesce(F.col(days_since) <= 90, F.lit(False))
    f, m = F.col(n_policies) >= 3, F.col(premium) > 20_000
    return df.withColumn("rfm_segment", F.when(r & f & m, "high_value").when(r, "potential")
                         .when(f & m, "at_risk").otherwise("dormant"))


def need_tags(df: DataFrame) -> DataFrame:
    """need_tags array of {tag, confidence, evidence_fields}, only tags that apply.

    Expects coverage amounts sum_*, age, income, children, travel_events.
    """
    def tag(name, cond, confidence, *fields):
        return F.when(cond, F.struct(F.lit(name).alias("tag"), confidence.alias("confidence"),
                                     F.array(*[F.lit(f) for f in fields]).alias("evidence_fields")))
    def conf(amount, full): return F.when(amount <= 0, F.lit(0.95)).otherwise(F.lit(full))
    med, ci, life = F.col("sum_medical"), F.col("sum_critical_illness"), F.col("sum_life")
    tags = F.array(
        tag("医疗刚需", med < 500_000, conf(med, 0.6), "insurance_tags.coverage_matrix.medical.sum_insured"),
        tag("大病保障", ci < 300_000, conf(ci, 0.8), "insurance_tags.coverage_matrix.critical_illness.sum_insured"),
        tag("家庭责任", (F.col("children") > 0) & (life < F.col("income") * 5), conf(life, 0.8),
            "basic_tags.family_structure", "insurance_tags.coverage_matrix.life.sum_insured"),
        tag("养老储蓄", (F.col("age") >= 35) & (F.col("sum_annuity") <= 0), F.lit(0.9), "basic_tags.age",
            "insurance_tags.coverage_matrix.annuity.has_coverage"),
        tag("子女规划", (F.col("children") > 0) & (F.col("sum_annuity") <= 0), F.lit(0.7), "basic_tags.children",
            "insurance_tags.coverage_matrix.annuity.has_coverage"),
        tag("出行保障", (F.col("travel_events") > 0) & (F.col("sum_accident") <= 0), F.lit(0.8), "behavior_tags.travel_events",
            "insurance_tags.coverage_matrix.accident.has_coverage"))
    return df.withColumn("need_tags", F.filter(tags, lambda x: x.isNotNull()))


def tag_freshness(tags: DataFrame, asof: str) -> DataFrame:
    """Expiry date and expired flag from updated_at and ttl_days."""
    return tags.withColumn("expires_on", F.date_add(F.to_date("updated_at"), F.col("ttl_days"))).withColumn(
        "expired", F.col("expires_on") < F.lit(asof).cast("date"))


def build_profiles(customers: DataFrame, policies: DataFrame, events: DataFrame, asof: str, seq: int = 1,
                   travel_kinds: Sequence[str] = ("travel",), health_fields: Sequence[str] = ()) -> DataFrame:
    """One five-layer document per user.

    ``health_fields`` are customer columns; the health layer holds them with the
    share that is filled (0 without any) and missing / partial / complete.

    Fact tables are aggregated before the joins.  The document holds bounded
    maps only; policy details stay rows of the policy table.
    """
    work = (customers.join(policy_rollup(policies, asof), "user_id", "left")
            .join(behaviour_rollup(events, asof, travel_kinds), "user_id", "left"))
    zero = {c: 0 for c in ["policy_count", "active_count", "total_premium", "n_30d", "n_90d", "total_events", "travel_events"]}
    zero |= {f"{a}_{p}": 0 for p in PRODUCTS for a in ("n", "sum")}
    work = need_tags(work.na.fill(zero))
    missing = F.lit("missing")
    health = list(health_fields)
    work = mark_missing(work, health, "__filled") if health else work.withColumn("__filled", F.lit(0.0))
    status = F.when(F.col("__filled") == 0, missing).when(F.col("__filled") < 1, "partial").otherwise("complete")
    return work.select(
        "user_id", F.lit(f"v{asof.replace('-', '')}_{seq:03d}").alias("version"),
        F.struct("age", "income", "children", "city_tier").alias("basic_tags"),
        F.struct("policy_count", "active_count", "total_premium", "coverage_matrix").alias("insurance_tags"),
        F.struct(*health, status.alias("status"), F.col("__filled").alias("data_completeness")).alias("health_tags"),
        F.struct("last_interaction", "n_30d", "n_90d", "top_event_types",
                 F.coalesce("activity_tier", missing).alias("activity_tier"),
                 dormancy_score(F.col("days_since"), F.col("n_30d")).alias("dormancy_score"),
                 F.coalesce("intent_level", F.lit("low")).alias("intent_level")).alias("behavior_tags"),
        "need_tags")


def refresh_profiles(old: DataFrame, rebuilt: DataFrame, changed: DataFrame, key: str = "user_id") -> DataFrame:
    """Changed users from the rebuilt table, everyone else unchanged."""
    keys = changed.select(key).distinct()
    return old.join(keys, key, "left_anti").unionByName(rebuilt.join(keys, key, "left_semi"))


def propensities(df: DataFrame, engagement: str, n_policies: str, income: str) -> DataFrame:
    """Renewal and up-sell propensity without the random term."""
    eng = code_map(engagement_tier(F.col(engagement)), ENGAGEMENT_POINTS, 2)
    pol = F.ln(F.greatest(F.col(n_policies), F.lit(1)).cast("double"))
    inc = F.ln(F.greatest(F.col(income), F.lit(1.0)))
    return df.withColumns({"renewal_propensity": sigmoid(-0.5 + eng * 0.4 + pol * 0.3),
                           "upsell_propensity": sigmoid(-2.0 + pol * 0.5 + inc * 0.3)})


def activation_list(profiles: DataFrame, contacts: DataFrame, asof: str, cutoff: float = 30.0, cap_days: int = 30) -> DataFrame:
    """Users at or below the dormancy cutoff not contacted within the cap."""
    end = F.lit(asof).cast("date")
    gap = F.datediff(end, F.to_date("contact_ts"))
    recent = contacts.filter((gap >= 0) & (gap < cap_days)).select("user_id").distinct()
    return profiles.filter(F.col("dormancy_score") <= cutoff).join(recent, "user_id", "left_anti")


def segment_key(df: DataFrame, cols: list[str], out: str = "segment") -> DataFrame:
    return df.withColumn(out, F.concat_ws("_", *cols))
