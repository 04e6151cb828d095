"""Difference-in-differences, pre-trend tests and event-study tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import materialize
from .gram import LinearFit, diagnostics_table, ols
from .ordered import median_period, seconds
from .typing import NUMERIC, treatment_post


def text_order_statistic(df: DataFrame, col: str, rank: int, step: int = 1) -> str:
    """Value at a 0-based rank of a text column, in Spark's string order.

    Each pass counts the next ``step`` characters under the prefix found so far,
    so neither a sort nor an offset gathers the keys anywhere.
    """
    prefix, below = "", 0
    while True:
        under = df.filter(F.col(col).startswith(prefix)) if prefix else df
        chunk = F.substring(col, len(prefix) + 1, step)
        for row in under.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n")).orderBy("chunk").collect():
            if below + row["n"] > rank:
                break
            below += row["n"]
        prefix += row["chunk"]
        if row["n"] == 1:
            return df.filter(F.col(col).startswith(prefix) if len(row["chunk"]) == step else F.col(col) == prefix).first()[0]
        if len(row["chunk"]) < step:
            return prefix


def half_of_entities(df: DataFrame, entity: str, out: str = "treated") -> DataFrame:
    """First half of the sorted entities is treated; the cut is an exact order statistic."""
    if isinstance(df.schema[entity].dataType, NUMERIC):
        cut = median_period(df, entity)
    else:
        ids = materialize(df.select(F.col(entity).cast("string").alias("e")).na.drop().distinct())
        cut = text_order_statistic(ids, "e", ids.count() // 2)
    return df.withColumn(out, (F.col(entity) < F.lit(cut)).cast("int"))


def did_frame(df: DataFrame, treatment: str | None, time: str | None, entity: str | None = None) -> DataFrame:
    """treated / post / treat_post; post starts at the median distinct period."""
    two = treatment is not None and df.select(treatment).where(F.col(treatment).isNotNull()).distinct().limit(3).count() == 2
    if two:
        high = df.agg(F.max(treatment)).first()[0]  # any two values: the larger one is treated
        work, treated = df, (F.col(treatment) == F.lit(high)).cast("int")
    else:
        if entity is None:
            raise ValueError("a two-valued treatment or an entity column is required")
        work, treated = half_of_entities(df, entity, "__half"), F.col("__half")
    if time is None:
        return treatment_post(work, treated, F.lit(1))
    cut = median_period(df, time)
    at = F.col(time).cast("double") if isinstance(df.schema[time].dataType, NUMERIC) else seconds(time)
    return treatment_post(work, treated, at >= F.lit(cut)).drop("__half")


def did(df: DataFrame, y: str, treatment: str, time: str, entity: str | None = None) -> LinearFit:
    return ols(did_frame(df, treatment, time, entity), y, ["treated", "post", "treat_post"], "diff_in_diff")


def did_diagnostics(frame: DataFrame, fit: LinearFit, y: str, time_number: str) -> DataFrame:
    """Treated-level p-value plus the slope test treated x time on pre rows."""
    level = next(r for r in fit.rows() if r[1] == "treated")
    pre = frame.filter(F.col("post") == 0).withColumn("treated_time", F.col("treated") * F.col(time_number))
    slope = next(r for r in ols(pre, y, ["treated", time_number, "treated_time"], "pre_trend").rows()
                 if r[1] == "treated_time")
    return diagnostics_table(frame.sparkSession, [
        ("diff_in_diff", "treated_level_pvalue", level[5], bool(level[5] < 0.05)),
        ("diff_in_diff", "pre_trend_slope", slope[2], None),
        ("diff_in_diff", "pre_trend_se", slope[3], None),
        ("diff_in_diff", "pre_trend_pvalue", slope[5], bool(slope[5] < 0.05))])


def event_study(df: DataFrame, period: str, treated: str, y: str, baseline: int) -> DataFrame:
    """Treated-control gap per relative period net of the baseline period, +-1.96 se."""
    cells = df.groupBy(period).agg(
        *[f(F.when(F.col(treated) == t, F.col(y))).alias(f"{n}{t}")
          for t in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    gap = cells.select(period, (F.col("m1") - F.col("m0")).alias("gap"),
                       (F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0")).alias("var"))
    base = gap.filter(F.col(period) == baseline).select(F.col("gap").alias("gap_b"), F.col("var").alias("var_b"))
    joined = gap.crossJoin(base)  # the baseline is one row
    is_base = F.col(period) == baseline
    se = F.when(is_base, 0.0).otherwise(F.sqrt(F.col("var") + F.col("var_b")))
    return joined.select(period, (F.col("gap") - F.col("gap_b")).alias("coef"), se.alias("se")).withColumns(
        {"ci_lower": F.col("coef") - 1.96 * F.col("se"), "ci_upper": F.col("coef") + 1.96 * F.col("se")})
