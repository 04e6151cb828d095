"""Instrument choice, first stage and two-stage least squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gram import LinearFit, diagnostics_table, fit_from_moments, inverse_scaled, moments, prediction, solve_scaled

MIN_ROWS = 30


def instrument_candidates(df: DataFrame, treatment: str, causes: list[str], min_rows: int = 3) -> DataFrame:
    """Absolute correlation of each candidate with the treatment, one aggregate; all causes that have one."""
    both = [F.count_if(F.col(c).isNotNull() & F.col(treatment).isNotNull()).alias(f"n{i}") for i, c in enumerate(causes)]
    rs = [F.abs(F.corr(F.col(treatment).cast("double"), F.col(c).cast("double"))).alias(f"r{i}") for i, c in enumerate(causes)]
    one = df.agg(*both, *rs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("instrument"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("abs_corr"))
        for i, c in enumerate(causes)])).alias("c")).select("c.*").filter((F.col("n") >= min_rows) & F.col("abs_corr").isNotNull())


def select_instrument(df: DataFrame, treatment: str, causes: list[str]) -> str:
    best = instrument_candidates(df, treatment, causes).orderBy(F.desc("abs_corr"), "instrument").first()
    if best is None:
        raise ValueError("no usable instrument")
    return best["instrument"]


def first_stage(df: DataFrame, treatment: str, instrument: str, exog: list[str]) -> tuple[LinearFit, float]:
    """First-stage regression and the partial F of the instrument."""
    m = moments(df, [instrument, *exog, treatment])
    fit = fit_from_moments(m, treatment, [instrument, *exog], "first_stage")
    return fit, float((fit.coef[0] / fit.se[0]) ** 2)


def two_stage(df: DataFrame, y: str, treatment: str, instrument: str, exog: list[str] | None = None,
              robust: bool = True) -> tuple[LinearFit, LinearFit, float]:
    """2SLS (second stage, first stage, partial F).

    Coefficients come from one moment pass; the heteroskedasticity-robust
    variance needs the residuals and so a second aggregate.
    """
    exog = exog or []
    cols = [treatment, *exog, instrument, y]
    work = df.select(*dict.fromkeys(cols)).na.drop()
    m = moments(work, cols)
    if m.n < MIN_ROWS:
        raise ValueError(f"only {m.n:.0f} complete rows")
    xs, zs = [treatment, *exog], [instrument, *exog]
    ix, iz, iy = m.at(xs), m.at(zs), m.at([y])[0]
    zz, zx, zy = m.cross[np.ix_(iz, iz)], m.cross[np.ix_(iz, ix)], m.cross[iz, iy]
    p = solve_scaled(zz, zx)  # projection of X on Z
    xhx = p.T @ zx
    beta = np.linalg.solve(xhx, p.T @ zy)
    intercept = float(m.mean[iy] - m.mean[ix] @ beta)
    sxx, sxy = m.cross[np.ix_(ix, ix)], m.cross[ix, iy]
    ssr = float(m.cross[iy, iy] - 2 * beta @ sxy + beta @ sxx @ beta)
    inv = inverse_scaled((xhx + xhx.T) / 2)
    k = len(xs)
    if robust:
        e = F.col(y) - prediction(beta, xs, intercept)
        hat = []
        for j in range(k):
            h = F.lit(0.0)
            for i, z in enumerate(zs):
                h = h + F.lit(float(p[i, j])) * (F.col(z) - F.lit(float(m.mean[iz[i]])))
            hat.append(h)
        row = work.agg(*[F.sum(hat[a] * hat[b] * e * e).alias(f"h{a}_{b}") for a in range(k) for b in range(a, k)]).first()
        meat = np.zeros((k, k))
        for a in range(k):
            for b in range(a, k):
                meat[a, b] = meat[b, a] = row[f"h{a}_{b}"]
        cov = inv @ meat @ inv
    else:
        cov = inv * ssr / m.n
    syy = m.cross[iy, iy]
    second = LinearFit("instrumental_variable", xs, beta, cov, intercept, float("nan"), m.n, m.n - k - 1, ssr,
                       1 - ssr / syy, float("nan"), normal=True)
    fs = fit_from_moments(m, treatment, zs, "first_stage")
    return second, fs, float((fs.coef[0] / fs.se[0]) ** 2)


def iv_diagnostics(df: DataFrame, fs: LinearFit, partial_f: float) -> DataFrame:
    return diagnostics_table(df.sparkSession, [
        ("instrumental_variable", "first_stage_f", float(fs.f_value), bool(fs.f_value < 10)),
        ("instrumental_variable", "partial_f", partial_f, bool(partial_f < 10))])
