"""Cross-fitted double machine learning and heterogeneous effects."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ..functions.tails import normal_sf
from .gram import LinearFit, Moments, estimate_row, inverse_scaled, moments_by, prediction, solve_linear
from .histtrees import boost, honest_forest, out_of_fold


def with_folds(df: DataFrame, key: str, k: int = 3, hashed: bool | None = None) -> DataFrame:
    """Repeatable folds from the row key: no random state, stable under retries.

    Keys that are not integral are hashed; integral ones are taken modulo k
    unless ``hashed`` says otherwise.
    """
    if hashed is None:
        hashed = not isinstance(df.schema[key].dataType, (ByteType, ShortType, IntegerType, LongType))
    base = F.xxhash64(key) if hashed else F.col(key)
    return df.withColumn("fold", F.pmod(base, F.lit(k)).cast("int"))


def _total(parts: dict) -> Moments:
    ms = list(parts.values())
    n = sum(m.n for m in ms)
    mean = sum(m.mean * m.n for m in ms) / n
    cross = sum(m.cross + np.outer(m.mean - mean, m.mean - mean) * m.n for m in ms)
    return Moments(ms[0].cols, n, mean, cross)


def linear_residuals(df: DataFrame, y: str, t: str, xs: list[str]) -> DataFrame:
    """Out-of-fold residuals of y and t; one moment pass serves all folds."""
    parts = moments_by(df, [*xs, y, t], "fold")
    total = _total(parts)
    res_y, res_t = F.lit(None).cast("double"), F.lit(None).cast("double")
    for fold, m in sorted(parts.items()):
        rest = total.minus(m)
        by, iy = solve_linear(rest, xs, y)
        bt, it = solve_linear(rest, xs, t)
        res_y = F.when(F.col("fold") == fold, F.col(y) - prediction(by, xs, iy)).otherwise(res_y)
        res_t = F.when(F.col("fold") == fold, F.col(t) - prediction(bt, xs, it)).otherwise(res_t)
    return df.na.drop(subset=[y, t, *xs]).withColumns({"res_y": res_y, "res_t": res_t})


def boosted_residuals(df: DataFrame, y: str, t: str, xs: list[str], trees: int = 100, depth: int = 3, rate: float = 0.1, min_leaf: int = 1) -> DataFrame:
    """Out-of-fold residuals with gradient-boosted trees; a two-valued t gets the logistic loss.

    All folds and both models grow together: one pass over the rows a tree level."""
    work = df.na.drop(subset=[y, t, *xs])
    two = work.filter(~F.col(t).cast("double").isin(0.0, 1.0)).isEmpty()
    model = boost(work, (y, t), xs, trees=trees, depth=depth, rate=rate, min_leaf=min_leaf, logistic=(False, two))
    return work.withColumn("__p", out_of_fold(work, model, xs)).withColumns(
        {"res_y": F.col(y) - F.col("__p.v0"), "res_t": F.col(t) - F.col("__p.v1")}).drop("__p")


def residual_effect(res: DataFrame, *by: str) -> DataFrame:
    """theta = sum(ry rt)/sum(rt^2) with the influence-function se, per group.

    The squares of psi = rt (ry - theta rt) are summed in a second aggregate;
    expanding them would cancel where the fit is tight.  Groups are joined back
    by their (null-safe) keys, so a group's theta reaches its rows.
    """
    y, t = F.col("res_y"), F.col("res_t")
    s = res.groupBy(*by).agg(F.count("*").alias("n"), F.sum(t * y).alias("ty"), F.sum(t * t).alias("tt"))
    s = s.select(*by, "n", "tt", F.try_divide("ty", "tt").alias("ate"))
    psi2 = F.sum(F.pow(t * (y - F.col("__ate") * t), 2)).alias("meat")
    if by:
        keys = s.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("ate").alias("__ate"))
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)])
        meat = res.join(keys, same).groupBy(*[F.col(f"__k{i}") for i in range(len(by))]).agg(psi2)
        s = s.join(meat, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)])).drop(*[f"__k{i}" for i in range(len(by))])
    else:
        one = s.first()
        meat = res.withColumn("__ate", F.lit(one["ate"])).agg(psi2).first()["meat"]
        s = res.sparkSession.createDataFrame([(one["n"], one["tt"], one["ate"], meat)], "n long, tt double, ate double, meat double")
    return s.select(*by, "n", "ate", F.try_divide(F.sqrt("meat"), F.col("tt")).alias("se")).withColumns(
        {"stat": F.try_divide("ate", "se"), "ci_lower": F.col("ate") - 1.96 * F.col("se"),
         "ci_upper": F.col("ate") + 1.96 * F.col("se")})


def dml_estimate(res: DataFrame, y: str, t: str) -> DataFrame:
    r = residual_effect(res).first()
    return estimate_row(res.sparkSession, "double_ml", y, t, r["ate"], r["se"], r["stat"],
                        2 * normal_sf(abs(r["stat"])), r["ci_lower"], r["ci_upper"], r["n"])


def linear_cate(res: DataFrame, xs: list[str]) -> LinearFit:
    """theta(x) = a + b'x: robust least squares of res_y on res_t * [1, x]."""
    z = {"__z0": F.col("res_t"), **{f"__z{i + 1}": F.col("res_t") * F.col(x) for i, x in enumerate(xs)}}
    work = res.withColumns(z)
    k = len(z)
    row = work.agg(*[F.sum(F.col(f"__z{i}") * F.col(f"__z{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)],
                   *[F.sum(F.col(f"__z{i}") * F.col("res_y")).alias(f"y{i}") for i in range(k)], F.count("*").alias("n")).first()
    a = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    inv = inverse_scaled(a)
    beta = inv @ np.array([row[f"y{i}"] for i in range(k)], dtype=float)
    e = F.col("res_y")
    for i, b in enumerate(beta):
        e = e - F.lit(float(b)) * F.col(f"__z{i}")
    work = work.withColumn("__e", e)
    mrow = work.agg(F.sum(F.col("__e") ** 2).alias("ssr"), *[
        F.sum(F.col(f"__z{i}") * F.col(f"__z{j}") * F.col("__e") ** 2).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.array([[mrow[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    n = float(row["n"])
    return LinearFit("linear_cate", ["base", *xs], beta, inv @ meat @ inv, 0.0, 0.0, n, n - k, mrow["ssr"],
                     float("nan"), float("nan"), normal=True)


def cate_column(fit: LinearFit) -> Column:
    return prediction(fit.coef[1:], fit.terms[1:], fit.coef[0])


def forest_cate(res: DataFrame, xs: list[str], key: str, trees: int = 200, depth: int = 5, min_leaf: int = 20,
                seed: int = 42, out: str = "cate") -> tuple[DataFrame, DataFrame]:
    """Honest causal forest on the residuals.

    Returns (rows with the effect, its standard error and 95% interval, importance
    table).  Effects are null where a feature is."""
    forest = honest_forest(res, xs, F.col(key), trees, depth, min_leaf, seed=seed)
    importance = res.sparkSession.createDataFrame(
        [(x, float(v)) for x, v in zip(xs, forest.importance())], "feature string, importance double")
    whole = reduce(and_, [F.col(x).isNotNull() for x in xs])
    scored = res.withColumn("__c", forest.column())
    return scored.select(*res.columns, *[F.when(whole, F.col(f"__c.{c}")).alias(c.replace("cate", out)) for c in ("cate", "cate_se", "cate_lower", "cate_upper")]), importance


def effect_summary(df: DataFrame, col: str = "cate") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                  F.min(col).alias("min"), F.max(col).alias("max"))
