"""Dataset profiling, histograms, roll-ups and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles

# Column-name hints for panel detection.
ID_HINTS = ("id", "code", "编号", "代码", "企业", "公司", "entity", "firm", "person")
TIME_HINTS = ("date", "year", "month", "time", "日期", "年份", "时间", "年", "period")


def hinted(columns: list[str], hints: tuple[str, ...]) -> str | None:
    return next((c for c in columns if any(h in c.lower().strip() for h in hints)), None)


def panel_columns(df: DataFrame, entity: str | None = None, time: str | None = None) -> tuple[str | None, str | None]:
    """Explicit names win; otherwise the first column whose name hints at the role."""
    return entity or hinted(df.columns, ID_HINTS), time or hinted(df.columns, TIME_HINTS)


def panel_balance(df: DataFrame, entity: str, time: str) -> DataFrame:
    """One row: entities, distinct periods, rows, fewest and most periods per entity."""
    per_pair = df.groupBy(entity, time).agg(F.count("*").alias("n"))
    per_entity = per_pair.groupBy(entity).agg(F.count("*").alias("t"), F.sum("n").alias("n"))
    periods = per_pair.select(time).distinct().agg(F.count("*").alias("n_periods"))
    return (per_entity.agg(F.count("*").alias("n_entities"), F.sum("n").alias("n_rows"),
                           F.min("t").alias("min_periods"), F.max("t").alias("max_periods"))
            .crossJoin(periods)  # one row on each side
            .withColumn("balanced", (F.col("min_periods") == F.col("max_periods"))
                        & (F.col("min_periods") == F.col("n_periods"))))


def shape_label(meta: DataFrame) -> DataFrame:
    """panel / time_series / cross_section from the column meta table."""
    return meta.agg(
        F.count_if(F.col("semantic_type") == "datetime").alias("n_datetime"),
        F.count_if((F.col("semantic_type") == "categorical") & (F.col("n_unique") > 5)).alias("n_group_ids"),
    ).withColumn("data_type", F.when((F.col("n_datetime") > 0) & (F.col("n_group_ids") > 0), "panel")
                 .when(F.col("n_datetime") > 0, "time_series").otherwise("cross_section"))


def dataset_stats(df: DataFrame, meta: DataFrame, treatment: str | None = None, entity: str | None = None,
                  time: str | None = None) -> DataFrame:
    """One-row summary used for method scoring."""
    entity, time = panel_columns(df, entity, time)
    is_panel = entity is not None and time is not None
    kind = F.max(F.when(F.col("column") == (treatment or ""), F.col("semantic_type")))
    counts = meta.agg(
        F.max("n").alias("sample_size"), F.count("*").alias("feature_count"),
        *[F.count_if(F.col("semantic_type") == t).alias(f"n_{t}")
          for t in ("continuous", "binary", "categorical", "datetime")],
        F.coalesce(kind == "binary", F.lit(False)).alias("has_binary_treatment"),
        F.coalesce(kind == "continuous", F.lit(False)).alias("has_continuous_treatment"))
    return (counts.crossJoin(shape_label(meta).select("data_type"))  # one row on each side
            .withColumn("is_panel", F.lit(is_panel))
            .withColumn("description", F.format_string(
                "n=%d; columns=%d; continuous=%d; categorical=%d; type=%s" + ("; panel" if is_panel else ""),
                "sample_size", "feature_count", "n_continuous", "n_categorical", "data_type")))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """All pairs (a before b) of Pearson correlations in one aggregate, long form."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
                   for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def missing_by_bucket(df: DataFrame, bucket: Column, cols: list[str]) -> DataFrame:
    """Missing rate per column within row buckets: the matrix behind a heat map."""
    wide = df.groupBy(bucket.alias("bucket")).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    return wide.unpivot(["bucket"], cols, "column", "missing_rate")


def histogram(df: DataFrame, col: str, bins: int = 30, by: str | None = None,
              bounds: tuple[float, float] | None = None) -> DataFrame:
    """Equal-width counts; the top edge belongs to the last bin."""
    if bounds is None:
        bounds = tuple(df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first())
    lo, hi = bounds
    width = (hi - lo) / bins
    at = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    keys = ([F.col(by)] if by else []) + [at.alias("bin")]
    return (df.filter(F.col(col).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
            .withColumn("lower", F.lit(lo) + F.col("bin") * F.lit(width))
            .withColumn("upper", F.lit(lo) + (F.col("bin") + 1) * F.lit(width)))


def with_rollup(dim: DataFrame, fact: DataFrame, key: str, fact_key: str, aggs: dict[str, Column]) -> DataFrame:
    """Left join of per-key aggregates with zero fill; aggregated before the join."""
    rolled = fact.groupBy(F.col(fact_key).alias(key)).agg(*[a.alias(n) for n, a in aggs.items()])
    return dim.join(rolled, key, "left").na.fill(0, list(aggs))


def value_tiers(df: DataFrame, premium: str, income: str, out: str = "value_tier") -> DataFrame:
    """Tiers at the P80/P50/P20 of 0.5 ln(premium) + 0.5 ln(income)."""
    score = F.ln(F.greatest(F.col(premium), F.lit(1.0))) * 0.5 + F.ln(F.greatest(F.col(income), F.lit(1.0))) * 0.5
    scored = df.withColumn("value_score", score)
    p20, p50, p80 = exact_quantiles(scored, {"value_score": [0.2, 0.5, 0.8]})["value_score"]
    return scored.withColumn(out, F.when(F.col("value_score") >= p80, "high_net_worth")
                             .when(F.col("value_score") >= p50, "core")
                             .when(F.col("value_score") >= p20, "mass").otherwise("low"))


def share_table(df: DataFrame, *keys: str) -> DataFrame:
    """Counts with their share of the total; the total is one row."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.crossJoin(total).withColumn("share", F.col("n") / F.col("total")).drop("total")


def count_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many keys have k rows: two-level aggregate."""
    return df.groupBy(key).agg(F.count("*").alias("rows_per_key")).groupBy("rows_per_key").agg(F.count("*").alias("n_keys"))


def count_map(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Per key a map value -> count; bounded by the number of distinct values."""
    return (df.groupBy(key, value).agg(F.count("*").alias("n"))
            .groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "n")))).alias(out)))


def top_k_values(df: DataFrame, key: str, value: str, k: int = 3) -> DataFrame:
    """k most frequent values per key; ties by value."""
    w = Window.partitionBy(key).orderBy(F.desc("n"), F.asc(value))
    return (df.groupBy(key, value).agg(F.count("*").alias("n"))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


def coverage_matrix(policies: DataFrame, user: str, product: str, amount: str, active: Column,
                    products: list[str]) -> DataFrame:
    """Per user and product: has, sum, count and active count, pivoted wide."""
    wide = (policies.withColumn("__active", active.cast("int")).groupBy(user).pivot(product, products)
            .agg(F.sum(amount).alias("sum"), F.count(F.lit(1)).alias("count"), F.sum("__active").alias("active")))
    filled = wide.na.fill(0)
    return filled.withColumns({f"{p}_has": F.col(f"{p}_count") > 0 for p in products})


def level_totals(df: DataFrame, levels: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Totals for each person, each family and the portfolio, tagged by level."""
    g = F.grouping_id(*[F.col(c) for c in levels])
    return df.rollup(*levels).agg(g.cast("int").alias("level"), *[a.alias(n) for n, a in aggs.items()])


def effectiveness(df: DataFrame, by: str, success: Column, days: Column) -> DataFrame:
    """Per strategy: cases, success rate and mean days among successes."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(success.cast("int")).alias("rate"),
                              F.avg(F.when(success, days)).alias("avg_days"))


def conversation_metrics(turns: DataFrame, conv: str, order: str, sender: str, text: str) -> DataFrame:
    """Turns by sender, first and last sender, answered flag, mean text length.

    First and last come from min_by/max_by, so a very long conversation is
    reduced on the map side instead of being sorted in one task.
    """
    return turns.groupBy(conv).agg(
        F.count("*").alias("n_turns"),
        F.count_if(F.col(sender) == "user").alias("user_turns"),
        F.count_if(F.col(sender) == "assistant").alias("assistant_turns"),
        F.min_by(sender, order).alias("first_sender"), F.max_by(sender, order).alias("last_sender"),
        (F.max(order) - F.min(order)).alias("span"),
        F.avg(F.length(text)).alias("mean_length"),
        F.avg(F.when(F.col(sender) == "assistant", F.length(text))).alias("mean_reply_length"),
    ).withColumn("resolved", F.col("last_sender") == "assistant")


def nps(df: DataFrame, score: str, *by: str) -> DataFrame:
    """Share of 9-10 minus share of 0-6, in percent."""
    return df.filter(F.col(score).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col(score) >= 9).alias("promoters"),
        F.count_if(F.col(score) <= 6).alias("detractors"),
    ).withColumn("nps", (F.col("promoters") - F.col("detractors")) * 100.0 / F.col("n"))


def diagnosis_confidence(df: DataFrame, parts: list[str], version: str, cutoff: float = 0.7) -> DataFrame:
    """Mean of the part confidences, pass rate and manual-review rate per model version."""
    mean = reduce(lambda a, b: a + b, [F.col(c) for c in parts]) / F.lit(len(parts))
    return (df.withColumn("confidence", mean).groupBy(version)
            .agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"),
                 F.avg((F.col("confidence") >= cutoff).cast("int")).alias("pass_rate"),
                 F.avg((F.col("confidence") < cutoff).cast("int")).alias("manual_rate")))
