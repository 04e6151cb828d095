"""Distributed moments and the small linear solves built on them.

Every linear estimator in this package is one aggregate that yields counts,
means and centered cross products of a handful of columns, followed by a k-by-k
solve.  ``covar_pop`` merges partial results with a stable update, so columns
need no centering pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tails import f_sf, normal_sf, t_quantile_two_sided, t_two_sided

COEF_SCHEMA = ("method string, term string, coef double, se double, t_stat double, p_value double, "
               "ci_lower double, ci_upper double")
ESTIMATE_SCHEMA = ("method string, outcome string, treatment string, ate double, se double, stat double, "
                   "p_value double, ci_lower double, ci_upper double, significant boolean, n long")
WIDE = 48  # columns of one aggregate of moments
DIAGNOSTIC_SCHEMA = "method string, name string, value double, flag boolean"


@dataclass
class Moments:
    cols: list[str]
    n: float
    mean: np.ndarray
    cross: np.ndarray  # sum of centered products

    def at(self, names: list[str]) -> list[int]:
        return [self.cols.index(c) for c in names]

    def plus(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        d = other.mean - self.mean
        return Moments(self.cols, n, self.mean + d * (other.n / n), self.cross + other.cross + np.outer(d, d) * (self.n * other.n / n))

    def minus(self, other: "Moments") -> "Moments":
        """Moments of the rows of self that are not in other."""
        n = self.n - other.n
        mean = (self.mean * self.n - other.mean * other.n) / n
        d = other.mean - mean
        cross = self.cross - other.cross - np.outer(d, d) * n * other.n / self.n
        return Moments(self.cols, n, mean, cross)


def moment_exprs(cols: list[str]) -> list[Column]:
    d = {c: F.col(c).cast("double") for c in cols}
    out = [F.count("*").alias("n")]
    out += [F.avg(d[c]).alias(f"m{i}") for i, c in enumerate(cols)]
    out += [(F.covar_pop(d[a], d[b])).alias(f"s{i}_{j}")
            for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    return out


def read_moments(row, cols: list[str]) -> Moments:
    k, n = len(cols), float(row["n"])
    cross = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            v = row[f"s{i}_{j}"]
            cross[i, j] = cross[j, i] = (0.0 if v is None else v) * n
    mean = np.array([row[f"m{i}"] if row[f"m{i}"] is not None else np.nan for i in range(k)], dtype=float)
    return Moments(list(cols), n, mean, cross)


def blocked_moments(df: DataFrame, cols: list[str], block: int = 64) -> Moments:
    """Complete-case moments of any number of columns.

    One aggregate for the means, one pass of matrix products about them.  A task
    adds up its rows and gives square blocks of the cross products; blocks are
    added 64 at a time over the tasks, so no group holds more than a few of them.
    """
    k = len(cols)
    d = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).na.drop()
    first = d.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)]).first()
    n = first["n"]
    if not n:
        return Moments(list(cols), 0.0, np.full(k, np.nan), np.zeros((k, k)))
    mean = np.array([first[f"m{i}"] for i in range(k)])
    cuts = list(range(0, k, block))

    def partial(batches):
        cross, rest = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(k)], 1) - mean
            cross += x.T @ x
            rest += x.sum(0)
        parts = [(-1, -1, rest.tobytes())] + [(i, j, cross[i:i + block, j:j + block].tobytes()) for i in cuts for j in cuts if j >= i]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts])], names=["i", "j", "v"])

    def added(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in part["v"])
        return pd.DataFrame({"i": part["i"][:1], "j": part["j"][:1], "task": part["task"][:1], "v": [total.tobytes()]})

    parts = d.mapInArrow(partial, "i int, j int, v binary").withColumn("task", F.spark_partition_id())
    for _ in range(3):
        parts = parts.withColumn("task", F.floor(F.col("task") / 64).cast("int")).groupBy("i", "j", "task").applyInPandas(added, "i int, j int, task int, v binary")
    cross, rest = np.zeros((k, k)), np.zeros(k)
    for row in parts.collect():  # a row per pair of blocks
        v = np.frombuffer(row["v"])
        if row["i"] < 0:
            rest += v
        else:
            i, j = slice(row["i"], row["i"] + block), slice(row["j"], row["j"] + block)
            v = v.reshape(cross[i, j].shape)
            cross[i, j] += v
            if row["i"] != row["j"]:
                cross[j, i] += v.T
    return Moments(list(cols), float(n), mean + rest / n, cross - np.outer(rest, rest) / n)


def moments(df: DataFrame, cols: list[str]) -> Moments:
    """Complete-case moments of ``cols``: one aggregate, or matrix blocks where that would be too many expressions to compile."""
    if len(cols) > WIDE:
        return blocked_moments(df, cols)
    return read_moments(df.select(*cols).na.drop().agg(*moment_exprs(cols)).first(), cols)


def moments_by(df: DataFrame, cols: list[str], key: str) -> dict:
    """Moments per value of a key with few values (folds, arms)."""
    rows = df.select(key, *cols).na.drop().groupBy(key).agg(*moment_exprs(cols)).collect()
    return {r[key]: read_moments(r, cols) for r in rows}


def solve_linear(m: Moments, xs: list[str], y: str, ridge: float = 0.0) -> tuple[np.ndarray, float]:
    """Slopes and intercept; ``ridge`` is relative to each column's own scale."""
    ix, iy = m.at(xs), m.at([y])[0]
    sxx = m.cross[np.ix_(ix, ix)]
    if ridge:
        sxx = sxx + np.diag(ridge * np.maximum(np.diag(sxx), 1e-300))
    beta = solve_scaled(sxx, m.cross[ix, iy])
    return beta, float(m.mean[iy] - m.mean[ix] @ beta)


def evidence_ridge(m: Moments, xs: list[str], y: str, rounds: int = 300, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """Slopes and intercept of a Bayesian ridge, solved from the moments.

    The precisions of noise and slopes (gamma priors, shape and rate 1e-6) are
    raised to the maximum of the evidence in turn, starting from 1 / var(y) and 1,
    until the slopes move by less than ``tol`` in sum.
    """
    ix, iy = m.at(xs), m.at([y])[0]
    if not xs or m.n < 2:
        return np.zeros(len(xs)), float(m.mean[iy])
    prior = 1e-6
    sxx, sxy, syy = m.cross[np.ix_(ix, ix)], m.cross[ix, iy], m.cross[iy, iy]

    def fit(ratio):
        inverse = inverse_scaled(sxx + ratio * np.eye(len(xs)))
        b = inverse @ sxy
        free = len(xs) - ratio * np.trace(inverse)  # slopes that the data determine
        return b, max(syy - 2 * b @ sxy + b @ sxx @ b, 0.0), free

    beta, sse, free = fit(syy / m.n + np.finfo(float).eps)
    for turn in range(rounds):
        slopes = (free + 2 * prior) / (beta @ beta + 2 * prior)
        noise = (m.n - free + 2 * prior) / (sse + 2 * prior)
        last = beta
        beta, sse, free = fit(slopes / noise)
        if turn and np.abs(last - beta).sum() < tol:
            break
    return beta, float(m.mean[iy] - m.mean[ix] @ beta)


def solve_scaled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symmetric solve after scaling to unit diagonal, for conditioning."""
    d = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.solve(a / np.outer(d, d), b / (d if b.ndim == 1 else d[:, None])) / (d if b.ndim == 1 else d[:, None])


def inverse_scaled(a: np.ndarray) -> np.ndarray:
    return solve_scaled(a, np.eye(len(a)))


@dataclass
class LinearFit:
    method: str
    terms: list[str]
    coef: np.ndarray
    cov: np.ndarray
    intercept: float
    intercept_se: float
    n: float
    df_resid: float
    ssr: float
    r2: float
    f_value: float
    normal: bool = False

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0.0))

    @property
    def f_pvalue(self) -> float:
        return f_sf(self.f_value, len(self.terms), self.df_resid)

    def rows(self) -> list[tuple]:
        crit = 1.959963984540054 if self.normal else t_quantile_two_sided(0.05, self.df_resid)
        out = []
        for term, b, s in zip(self.terms, self.coef, self.se):
            t = float(b / s) if s > 0 else float("nan")
            p = 2 * normal_sf(abs(t)) if self.normal else t_two_sided(t, self.df_resid)
            out.append((self.method, term, float(b), float(s), t, p, float(b - crit * s), float(b + crit * s)))
        return out

    def coef_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), COEF_SCHEMA)

    def estimate(self, spark: SparkSession, outcome: str, treatment: str, term: str | None = None) -> DataFrame:
        row = next(r for r in self.rows() if r[1] == (term or treatment))
        return estimate_row(spark, self.method, outcome, treatment, row[2], row[3], row[4], row[5], row[6], row[7], self.n)


def estimate_row(spark, method, outcome, treatment, ate, se, stat, p, lo, hi, n) -> DataFrame:
    return spark.createDataFrame([(method, outcome, treatment, float(ate), float(se), float(stat), float(p),
                                   float(lo), float(hi), bool(p < 0.05), int(n))], ESTIMATE_SCHEMA)


def diagnostics_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, DIAGNOSTIC_SCHEMA)


def fit_from_moments(m: Moments, y: str, xs: list[str], method: str = "ols") -> LinearFit:
    ix, iy, k = m.at(xs), m.at([y])[0], len(xs)
    beta, intercept = solve_linear(m, xs, y)
    syy = m.cross[iy, iy]
    ssr = max(float(syy - beta @ m.cross[ix, iy]), 0.0)
    df_resid = m.n - k - 1
    s2 = ssr / df_resid
    inv = inverse_scaled(m.cross[np.ix_(ix, ix)])
    xbar = m.mean[ix]
    ess = float(syy - ssr)
    f = (ess / k) / s2 if s2 > 0 else float("inf")
    return LinearFit(method, list(xs), beta, s2 * inv, intercept,
                     float(np.sqrt(s2 * (1 / m.n + xbar @ inv @ xbar))), m.n, df_resid, ssr,
                     ess / syy if syy > 0 else float("nan"), f)


def ols(df: DataFrame, y: str, xs: list[str], method: str = "ols") -> LinearFit:
    """Least squares with intercept: t, p, 95% interval, R2 and overall F."""
    return fit_from_moments(moments(df, [*xs, y]), y, xs, method)


def prediction(fit_coef, terms: list[str], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for b, c in zip(fit_coef, terms):
        out = out + F.lit(float(b)) * F.col(c)
    return out
