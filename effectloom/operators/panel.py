"""Panel estimators from one entity-level moment table.

Within, between and quasi-demeaned cross products and the per-entity score sums
of the clustered variance are all functions of each entity's count, means and
co-moments.  The rows are aggregated once per entity (map-side combined, so a
hot entity is no problem); everything else is a small aggregate over entities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import chi2_sf
from .gram import LinearFit, Moments, fit_from_moments, inverse_scaled, moment_exprs, ols, solve_scaled

MIN_ROWS = 20


@dataclass
class PanelResult:
    fe: LinearFit
    re: LinearFit | None
    hausman: float | None
    hausman_df: int
    hausman_p: float | None
    sigma2_e: float
    sigma2_u: float


def pooled_ols(df: DataFrame, y: str, xs: list[str]) -> LinearFit:
    return ols(df, y, xs, "pooled_ols")


def entity_moments(df: DataFrame, entity: str, y: str, xs: list[str]) -> DataFrame:
    """One row per entity: n, means m_i and n-scaled co-moments c_i_j of [xs, y]."""
    cols = [*xs, y]
    g = df.select(entity, *cols).na.drop().groupBy(entity).agg(*moment_exprs(cols))
    k = len(cols)
    return g.select(entity, "n", *[f"m{i}" for i in range(k)],
                    *[(F.col(f"s{i}_{j}") * F.col("n")).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)])


def _sym(row, prefix: str, k: int) -> np.ndarray:
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"{prefix}{i}_{j}"]
    return a


def _c(i: int, j: int) -> str:
    return f"c{min(i, j)}_{max(i, j)}"


def panel_regression(df: DataFrame, entity: str, y: str, xs: list[str], clustered: bool = True,
                     with_re: bool = True, count_effects: bool = False) -> PanelResult:
    """Entity fixed effects (clustered by entity), random effects and Hausman.

    The clustered variance is scaled by n / (n - k): effects nested in the
    clusters are not counted, unless ``count_effects`` asks for n / (n - g - k).
    """
    k, iy = len(xs), len(xs)
    ent = entity_moments(df, entity, y, xs).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tot = ent.agg(
            F.sum("n").alias("n"), F.count("*").alias("g"),
            *[F.sum(F.col(f"c{i}_{i}") + F.col("n") * F.col(f"m{i}") ** 2).alias(f"x{i}") for i in range(k)], F.sum(1.0 / F.col("n")).alias("inv_t"),
            *[F.sum(f"c{i}_{j}").alias(f"w{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]).first()
        n, g = float(tot["n"]), float(tot["g"])
        if n < MIN_ROWS:
            raise ValueError(f"panel has only {n:.0f} complete rows")
        w = _sym(tot, "w", k + 1)
        absorbed = [x for i, x in enumerate(xs) if w[i, i] <= 1e-12 * max(tot[f"x{i}"] or 0.0, 1e-300)]
        if absorbed:
            raise ValueError(f"constant within every entity: {absorbed}")
        wxx, wxy = w[:k, :k], w[:k, iy]
        beta = solve_scaled(wxx, wxy)
        ssr = float(w[iy, iy] - beta @ wxy)
        df_resid = n - g - k
        s2e = ssr / df_resid
        inv = inverse_scaled(wxx)
        cov = s2e * inv
        if clustered:
            score = [F.col(_c(i, iy)) - sum((F.lit(float(beta[j])) * F.col(_c(i, j)) for j in range(k)), F.lit(0.0))
                     for i in range(k)]
            meat_row = ent.agg(*[F.sum(score[i] * score[j]).alias(f"h{i}_{j}")
                                 for i in range(k) for j in range(i, k)]).first()
            cov = inv @ _sym(meat_row, "h", k) @ inv * (n / (df_resid if count_effects else n - k))
        r2 = 1.0 - ssr / w[iy, iy] if w[iy, iy] > 0 else float("nan")
        f = ((w[iy, iy] - ssr) / k) / s2e if s2e > 0 else float("inf")
        fe = LinearFit("panel_fe", list(xs), beta, cov, float("nan"), float("nan"), n, df_resid, ssr, r2, f)
        if not with_re or g <= k + 1:
            return PanelResult(fe, None, None, k, None, s2e, 0.0)
        # Between regression on entity means gives the entity variance.
        means = ent.select(*[F.col(f"m{i}").alias(c) for i, c in enumerate([*xs, y])])
        between = ols(means, y, xs, "between")
        t_bar = g / float(tot["inv_t"])
        s2u = max(0.0, between.ssr / between.df_resid - s2e / t_bar)
        theta = 1.0 - F.sqrt(F.lit(s2e) / (F.lit(s2e) + F.col("n") * F.lit(s2u)))
        q = (1.0 - theta) ** 2 * F.col("n")
        # Quasi-demeaned normal equations with the transformed constant 1 - theta.
        sums = ent.agg(F.sum(q).alias("q"), *[F.sum(q * F.col(f"m{i}")).alias(f"q{i}") for i in range(k + 1)],
                       *[F.sum(F.col(f"c{i}_{j}") + q * F.col(f"m{i}") * F.col(f"m{j}")).alias(f"r{i}_{j}")
                         for i in range(k + 1) for j in range(i, k + 1)]).first()
        qsum = float(sums["q"])
        mean = np.array([sums[f"q{i}"] for i in range(k + 1)], dtype=float) / qsum
        cross = _sym(sums, "r", k + 1) - np.outer(mean, mean) * qsum
        re = fit_from_moments(Moments([*xs, y], n, mean, cross), y, xs, "panel_re")
        re.intercept_se = float(np.sqrt(re.ssr / re.df_resid * (
            1 / qsum + mean[:k] @ inverse_scaled(cross[:k, :k]) @ mean[:k])))
        gap = beta - re.coef
        # one error variance on both sides keeps the difference positive semi-definite
        diff = s2e * (inv - inverse_scaled(cross[:k, :k]))
        h = float(gap @ np.linalg.pinv(diff) @ gap)
        return PanelResult(fe, re, h, k, chi2_sf(h, k) if h > 0 else 1.0, s2e, s2u)
    finally:
        ent.unpersist()
