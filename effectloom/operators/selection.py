"""Method scoring, aliases, the estimator registry and multi-method runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.errors import AnalysisException, ArithmeticException, IllegalArgumentException, NumberFormatException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quantiles import median
from .gram import diagnostics_table
from .typing import numeric_columns

# Canonical method keys and the names users give them.
METHOD_NAMES = {
    "panel_regression": ["panel_regression", "panel", "fe", "re", "面板回归", "固定效应", "随机效应"],
    "diff_in_diff": ["diff_in_diff", "did", "双重差分", "倍差法"],
    "instrumental_variable": ["instrumental_variable", "iv", "2sls", "工具变量"],
    "propensity_score": ["propensity_score", "psm", "倾向得分匹配", "倾向性评分"],
    "double_ml": ["double_ml", "dml", "双机器学习"],
    "rdd": ["rdd", "断点回归", "断点回归设计"],
    "dag_discovery": ["dag_discovery", "dag", "因果图", "因果发现"],
}


# Points of each rule.
def score_methods(stats: DataFrame) -> DataFrame:
    """(method, score) from the one-row dataset summary."""
    def pts(cond, yes, no=0.0):
        return F.when(cond, F.lit(yes)).otherwise(F.lit(no))
    n, p = F.col("sample_size"), F.col("feature_count")
    panel, binary, cont = F.col("is_panel"), F.col("has_binary_treatment"), F.col("has_continuous_treatment")
    cross, pan = F.col("data_type") == "cross_section", F.col("data_type") == "panel"
    rules = {
        "dag_discovery": 1.0 + pts(n >= 200, 1.0) + pts(p >= 5, 1.0) + pts(~(binary | cont), 0.5),
        "diff_in_diff": 0.5 + pts(panel, 2.0) + pts(pan, 1.0) + pts(binary, 0.5),
        "instrumental_variable": 0.5 + pts(n >= 100, 0.5) + pts(panel, 0.5),
        "panel_regression": 1.0 + pts(panel, 2.0, -0.5) + pts(pan, 1.0),
        "propensity_score": 1.5 + pts(binary, 1.0, -0.5) + pts(cross, 1.0) + pts(~panel, 0.5, -0.5),
        "double_ml": 1.0 + pts(n >= 500, 1.0, -0.5) + pts(p >= 5, 0.5) + pts(cross, 1.0),
        "rdd": 0.3 + pts(cont, 0.5) + pts(n >= 200, 0.5),
    }
    return stats.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(m).alias("method"), s.alias("score"))
        for i, (m, s) in enumerate(rules.items())])).alias("r")).select("r.*")


def select_methods(scores: DataFrame, top_n: int = 3, confidence: float = 0.3) -> DataFrame:
    """Best methods at or above ``confidence`` of the top score, at most ``top_n`` (seven input rows)."""
    w = Window.orderBy(F.desc("score"), F.asc("ord"))
    best = F.max("score").over(Window.partitionBy())
    return (scores.withColumns({"rank": F.row_number().over(w), "best": best})
            .filter((F.col("score") >= F.col("best") * confidence) & (F.col("rank") <= top_n)).drop("best", "ord"))


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, m) for m, names in METHOD_NAMES.items() for a in names], "alias string, method string")


def resolve_methods(requests: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, position, alias, method) for each comma-separated name; unknown names give null.

    Repeats of a method within one request keep the first position only.
    """
    parts = requests.select(key, F.posexplode(F.split(F.col(raw), ",")).alias("position", "part"))
    parts = parts.withColumn("alias", F.lower(F.trim("part"))).filter(F.col("alias") != "").drop("part")
    hit = parts.join(F.broadcast(alias_table(requests.sparkSession)), "alias", "left")
    return (hit.groupBy(key, "method", F.when(F.col("method").isNull(), F.col("alias")).alias("unknown"))
            .agg(F.min("position").alias("position"), F.min_by("alias", "position").alias("alias"))
            .drop("unknown"))


@dataclass
class CausalRequest:
    outcome: str
    treatment: str
    causes: list[str] = field(default_factory=list)
    key: str | None = None
    entity: str | None = None
    time: str | None = None
    instrument: str | None = None
    running: str | None = None
    cutoff: float | None = None
    nuisance: str = "linear"  # of double ML: linear or boosted
    effects: bool = False     # also the effect of every row, by a causal forest


@dataclass
class MethodResult:
    """What one method found; graph methods have edges instead of an estimate."""
    estimate: DataFrame | None = None
    coefficients: DataFrame | None = None
    diagnostics: DataFrame | None = None
    edges: DataFrame | None = None
    balance: DataFrame | None = None     # covariates before and after matching
    effects: DataFrame | None = None     # method, key, effect of each row with interval
    importance: DataFrame | None = None  # method, feature, share of the splits' gains


@dataclass
class MethodRun:
    estimates: DataFrame | None
    coefficients: DataFrame | None
    diagnostics: DataFrame | None
    edges: DataFrame | None
    balance: DataFrame | None
    effects: DataFrame | None
    importance: DataFrame | None
    errors: dict[str, str]


#: A forest of effects needs this many rows, and takes this many features at most.
FOREST_ROWS, FOREST_FEATURES = 200, 20

ESTIMATORS: dict[str, Callable[[DataFrame, CausalRequest], MethodResult]] = {}
#: What a request that doesn't fit the data raises; anything else, such as a lost executor, is not isolated.
INPUT_ERRORS = (ValueError, KeyError, TypeError, ArithmeticError, np.linalg.LinAlgError, AnalysisException, IllegalArgumentException,
                ArithmeticException, NumberFormatException)


def register_estimator(name: str):
    def wrap(fn):
        ESTIMATORS[name] = fn
        return fn
    return wrap


def method_name(raw: str) -> str:
    """Canonical key of a method name or alias; unknown names stay as they are."""
    name = raw.strip().lower()
    return next((m for m, names in METHOD_NAMES.items() if name in names), name)


def covariates(df: DataFrame, r: CausalRequest) -> list[str]:
    """Numeric causes; if there are none, all numeric columns that play no other part."""
    taken = {r.outcome, r.treatment, r.key, r.entity, r.time}
    numeric = [c for c in numeric_columns(df) if c not in taken]
    return [c for c in r.causes if c in numeric] or numeric


@register_estimator("panel_regression")
def _panel(df, r):
    from .panel import panel_regression, pooled_ols
    xs = [r.treatment, *covariates(df, r)]
    if r.entity is None:
        fit = pooled_ols(df, r.outcome, xs)
        return MethodResult(fit.estimate(df.sparkSession, r.outcome, r.treatment), fit.coef_table(df.sparkSession))
    res = panel_regression(df, r.entity, r.outcome, xs)
    found = [] if res.hausman is None else [("panel_regression", "hausman", res.hausman, bool(res.hausman_p < 0.05))]
    return MethodResult(res.fe.estimate(df.sparkSession, r.outcome, r.treatment), res.fe.coef_table(df.sparkSession), diagnostics_table(df.sparkSession, found) if found else None)


def settled(small: DataFrame) -> DataFrame:
    """A table of a few rows, computed now: it must not depend on what is cached during the run."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


@register_estimator("diff_in_diff")
def _did(df, r):
    from .did import did_diagnostics, did_frame
    from .gram import ols
    from .ordered import _numeric
    frame = did_frame(df, r.treatment, r.time, r.entity)
    fit = ols(frame, r.outcome, ["treated", "post", "treat_post"], "diff_in_diff")
    if r.time is None:
        return MethodResult(fit.estimate(df.sparkSession, r.outcome, r.treatment, "treat_post"), fit.coef_table(df.sparkSession))
    days = F.col(r.time).cast("double") if _numeric(df, r.time) else F.datediff(r.time, F.lit("1970-01-01").cast("date")).cast("double")
    try:
        checks = did_diagnostics(frame.withColumn("__days", days), fit, r.outcome, "__days")
    except INPUT_ERRORS:  # a single period before the start has no trend
        checks = None
    return MethodResult(fit.estimate(df.sparkSession, r.outcome, r.treatment, "treat_post"), fit.coef_table(df.sparkSession), checks)


@register_estimator("instrumental_variable")
def _iv(df, r):
    from .iv import iv_diagnostics, select_instrument, two_stage
    usable = covariates(df, r)
    inst = r.instrument or select_instrument(df, r.treatment, usable)
    fit, first, partial_f = two_stage(df, r.outcome, r.treatment, inst, [c for c in usable if c != inst])
    return MethodResult(fit.estimate(df.sparkSession, r.outcome, r.treatment), fit.coef_table(df.sparkSession), iv_diagnostics(df, first, partial_f))


@register_estimator("propensity_score")
def _psm(df, r):
    from .psm import att, balance, propensity_score_matching
    if r.key is None:
        raise ValueError("matching needs a key column")
    pairs, scored, xs = propensity_score_matching(df, r.key, r.outcome, r.treatment, covariates(df, r))
    table = settled(balance(scored, pairs, "__treated", xs).select(F.lit("propensity_score").alias("method"), "*"))
    checks = table.select("method", F.explode(F.array(*[F.struct(
        F.concat(F.lit(f"{c}:"), "covariate").alias("name"), F.col(c).alias("value"), (F.col(c) >= 0.1).alias("flag")) for c in ("smd_before", "smd_after")])).alias("d"))
    return MethodResult(att(pairs, r.outcome, r.treatment), diagnostics=checks.select("method", "d.*"), balance=table)


@register_estimator("double_ml")
def _dml(df, r):
    from .dml import boosted_residuals, dml_estimate, forest_cate, linear_residuals, with_folds
    if r.key is None:
        raise ValueError("cross-fitting needs a key column")
    xs = covariates(df, r)
    res = {"linear": linear_residuals, "boosted": boosted_residuals}[r.nuisance](with_folds(df, r.key), r.outcome, r.treatment, xs)
    out = MethodResult(dml_estimate(res, r.outcome, r.treatment))
    # as few as 200 rows or one feature give no forest
    if r.effects and len(xs) >= 2 and res.limit(FOREST_ROWS).count() >= FOREST_ROWS:
        rows, importance = forest_cate(res, xs[:FOREST_FEATURES], r.key, out="effect")
        out.effects = rows.select(F.lit("double_ml").alias("method"), F.col(r.key).cast("string").alias("key"), "effect", "effect_se", "effect_lower", "effect_upper")
        out.importance = importance.select(F.lit("double_ml").alias("method"), "*")
    return out


@register_estimator("rdd")
def _rdd(df, r):
    from .rdd import default_running, density_chi2, rdd
    running, cutoff = (r.running, r.cutoff) if r.running else default_running(df, covariates(df, r), r.outcome, r.treatment)
    cutoff = median(df, running) if cutoff is None else cutoff
    fit = rdd(df, r.outcome, running, cutoff).fit
    dense = density_chi2(df, running, cutoff).select(F.lit("rdd").alias("method"), F.lit("density_chi2").alias("name"), F.col("chi2").alias("value"), F.col("concern").alias("flag"))
    return MethodResult(fit.estimate(df.sparkSession, r.outcome, r.treatment, "above"), fit.coef_table(df.sparkSession), settled(dense))


@register_estimator("dag_discovery")
def _dag(df, r):
    from .dag import orient, pc_skeleton
    numeric = set(numeric_columns(df))
    cols = [c for c in dict.fromkeys([r.outcome, r.treatment, *covariates(df, r)]) if c in numeric]
    return MethodResult(edges=orient(*pc_skeleton(df, cols)))


def run_all(df: DataFrame, request: CausalRequest, methods: list[str]) -> MethodRun:
    """Every named method (or alias) over one request; a method the request doesn't fit is reported and doesn't stop the rest."""
    data = df.persist(StorageLevel.MEMORY_AND_DISK)
    found: dict[str, MethodResult] = {}
    errors = {}
    try:
        for raw in methods:
            name = method_name(raw)
            if name not in ESTIMATORS:
                errors[raw] = "not registered"
            elif name not in found:
                try:
                    found[name] = ESTIMATORS[name](data, request)
                except INPUT_ERRORS as e:
                    errors[raw] = f"{type(e).__name__}: {e}"
    finally:
        data.unpersist()

    def union(part: str) -> DataFrame | None:
        frames = [getattr(x, part) for x in found.values() if getattr(x, part) is not None]
        return reduce(DataFrame.unionByName, frames) if frames else None

    return MethodRun(*[union(p) for p in ("estimate", "coefficients", "diagnostics", "edges", "balance", "effects", "importance")], errors)


def run_methods(df: DataFrame, request: CausalRequest, methods: list[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """(union of estimates, errors by method)."""
    run = run_all(df, request, methods)
    return run.estimates, run.errors


def effect_matrix(estimates: DataFrame) -> DataFrame:
    """treatment x outcome rows with one ATE column per method and an agreement flag."""
    return estimates.groupBy("treatment", "outcome").agg(
        F.max(F.when(F.col("method") == "double_ml", F.col("ate"))).alias("double_ml_ate"),
        F.max(F.when(F.col("method") == "propensity_score", F.col("ate"))).alias("propensity_score_ate"),
        F.bool_and("significant").alias("all_significant"),
        (F.min(F.signum("ate")) == F.max(F.signum("ate"))).alias("same_sign"))


def calibration_multipliers(estimates: DataFrame, per: float = 10_000.0) -> DataFrame:
    """ATE, interval and per-unit rescaling for each calibrated pair."""
    return estimates.select("treatment", "outcome", "ate", "ci_lower", "ci_upper",
                            (F.col("ate") * F.lit(per)).alias("ate_per_unit"))


def effect_notes(estimates: DataFrame) -> DataFrame:
    """Significance stars and effect magnitude bands."""
    p, a = F.col("p_value"), F.abs("ate")
    stars = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, ".").otherwise("")
    return estimates.withColumns({"stars": stars, "magnitude": F.when(a > 0.5, "large").when(a > 0.1, "medium").otherwise("small")})
