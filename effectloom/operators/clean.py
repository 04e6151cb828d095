"""Imputation, winsorizing and the end-to-end cleaning pass."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles, number, sketched
from ..sources.workspace import materialize
from . import typing as ty
from .gram import WIDE, Moments, evidence_ridge, moment_exprs, moments, read_moments

PATTERNS = 1024  # patterns of holes whose moments are held at once
UNKNOWN = "未知"  # fixed value: filler for a categorical column without any mode


@dataclass
class CleanResult:
    data: DataFrame
    meta: DataFrame
    report: DataFrame


def column_modes(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Most frequent value per column; ties go to the smallest value."""
    if not cols:
        return {}
    num = set(ty.numeric_columns(df))
    counts = ty.value_counts(df, cols)
    order = F.when(F.col("column").isin(*(num & set(cols))) if num & set(cols) else F.lit(False),
                   F.expr("try_cast(value as double)"))
    best = counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("n"), order.alias("o"), F.col("value").alias("v"))).alias("mode"))
    return {r["column"]: r["mode"] for r in best.collect()}


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    med = exact_quantiles(df, {c: [0.5] for c in cols})
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(med[c][0])) for c in cols})


def impute_mode(df: DataFrame, cols: list[str]) -> DataFrame:
    modes = column_modes(df, cols)
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(modes.get(c, UNKNOWN)).try_cast(kinds[c])) for c in cols})


def iterative_impute(df: DataFrame, cols: list[str], rounds: int = 10, tol: float = 1e-3,
                     max_patterns: int = PATTERNS) -> DataFrame:
    """Chained imputation by Bayesian ridge regressions, columns with fewer holes first.

    Holes (null or NaN) start at the column's mean.  In each round every column
    with holes is regressed on all others, holes as filled so far, over the rows
    that have it; the rounds end when no coefficient moves by more than ``tol`` of
    itself.

    Within rows that miss the same columns every filled value is one affine map of
    the present ones, so the moments per pattern of holes, one aggregate, hold all
    that the rounds need: they run on k-by-k matrices, and the maps (at most
    ``max_patterns`` of them) are applied in one pass.  With more patterns, or more
    columns than one aggregate of moments takes, each regression is an aggregate over the rows instead; the results are the same.

    A column without any value stays empty and takes no part.
    """
    if not cols:
        return df
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    seen = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.struct(F.count(v).alias("n"), F.avg(v).alias("m")).alias(c) for c, v in value.items()]).first()
    used = [c for c in cols if seen[c]["n"]]
    holes = sorted((c for c in used if seen[c]["n"] < seen["n"]), key=lambda c: (-seen[c]["n"], cols.index(c)))
    work = df.withColumns({c: value[c] for c in cols})
    if not holes:
        return work
    pattern = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in holes])
    many = len(used) > WIDE or 2 ** len(holes) > max_patterns and work.select(pattern).distinct().limit(max_patterns + 1).count() > max_patterns
    if many:
        return _impute_rows(work, used, holes, {c: seen[c]["m"] for c in holes}, rounds, tol)
    maps = _impute_maps(work, pattern, used, holes, [seen[c]["m"] for c in used], rounds, tol)
    kinds = "__pattern string, " + ", ".join(f"__map{i} array<double>" for i in range(len(holes)))
    table = F.broadcast(df.sparkSession.createDataFrame(maps, kinds))  # at most max_patterns rows of k * k numbers
    present = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in used], F.lit(1.0))
    filled = {c: F.coalesce(F.col(c), F.aggregate(F.zip_with(f"__map{i}", "__present", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x))
              for i, c in enumerate(holes)}
    return (work.withColumns({"__pattern": pattern, "__present": present}).join(table, "__pattern")
            .withColumns(filled).select(*df.columns))


def _chain(holes: list[str], used: list[str], rounds: int, tol: float, moments_of, fill, after_round) -> None:
    """The rounds of a chained imputation over either form of the data."""
    previous: dict[str, list[float]] = {}
    for _ in range(rounds):
        change = 0.0
        for c in holes:
            others = [o for o in used if o != c]
            beta, intercept = evidence_ridge(moments_of(c), others, c)
            fill(c, others, beta, intercept)
            now = [*beta, intercept]
            old = previous.get(c)
            change = max(change, max(abs(a - b) / (abs(a) + 1e-12) for a, b in zip(now, old)) if old else 1.0)
            previous[c] = now
        after_round()
        if change < tol:
            break


def _impute_maps(work: DataFrame, pattern: Column, used: list[str], holes: list[str], means: list[float],
                 rounds: int, tol: float) -> list[tuple]:
    """(pattern, a row of weights over the present columns and a constant per column with holes)."""
    k = len(used)
    rows = work.groupBy(pattern.alias("__pattern")).agg(*moment_exprs(used)).collect()  # at most max_patterns
    raw, maps, missing = {}, {}, {}
    for r in rows:
        p = r["__pattern"]
        raw[p] = read_moments(r, used)
        missing[p] = {c for c, bit in zip(holes, p) if bit == "1"}
        gone = np.array([c in missing[p] for c in used])
        raw[p].mean[gone] = 0.0
        maps[p] = np.hstack([np.diag((~gone).astype(float)), np.where(gone, means, 0.0)[:, None]])

    def moments_of(c: str) -> Moments:
        total = None
        for p, m in raw.items():
            if c not in missing[p]:
                a = maps[p][:, :k]
                part = Moments(used, m.n, a @ m.mean + maps[p][:, k], a @ m.cross @ a.T)
                total = part if total is None else total.plus(part)
        return total

    def fill(c: str, others: list[str], beta: np.ndarray, intercept: float) -> None:
        at, ix = used.index(c), [used.index(o) for o in others]
        for p, m in maps.items():
            if c in missing[p]:
                m[at] = beta @ m[ix]
                m[at, k] += intercept

    _chain(holes, used, rounds, tol, moments_of, fill, lambda: None)
    return [(p, *[[float(x) for x in m[used.index(c)]] for c in holes]) for p, m in maps.items()]


def _impute_rows(work: DataFrame, used: list[str], holes: list[str], means: dict[str, float], rounds: int, tol: float) -> DataFrame:
    """One aggregate a regression and a reliable checkpoint a round."""
    names = work.columns
    state = [materialize(work.withColumns({f"__missing_{c}": F.col(c).isNull() for c in holes}).withColumns(
        {c: F.coalesce(F.col(c), F.lit(means[c])) for c in holes}))]

    def fill(c: str, others: list[str], beta: np.ndarray, intercept: float) -> None:
        guess = F.lit(intercept)
        for b, o in zip(beta, others):
            guess = guess + F.lit(float(b)) * F.col(o)
        state[0] = state[0].withColumn(c, F.when(F.col(f"__missing_{c}"), guess).otherwise(F.col(c)))

    def after_round() -> None:
        state[0] = materialize(state[0])

    _chain(holes, used, rounds, tol, lambda c: moments(state[0].filter(~F.col(f"__missing_{c}")), used), fill, after_round)
    return state[0].select(*names)


def iqr_bounds(df: DataFrame, cols: list[str], k: float = 1.5, min_n: int = 1) -> dict[str, tuple[float, float]]:
    sketches = sketched(df, {c: number(c) for c in cols}) if cols else {}
    cols = [c for c in cols if sketches[c].n >= min_n]
    q = exact_quantiles(df, {c: [0.25, 0.75] for c in cols}, sketches)
    return {c: (q[c][0] - k * (q[c][1] - q[c][0]), q[c][1] + k * (q[c][1] - q[c][0])) for c in cols if q[c][0] is not None}


def zscore_bounds(df: DataFrame, cols: list[str], k: float, min_n: int = 1):
    """Clip bounds use the sample deviation, the outlier flag the population one."""
    s = df.agg(*[F.struct(F.count(F.col(c)).alias("n"), F.avg(c).alias("m"), F.stddev_samp(c).alias("s"),
                          F.stddev_pop(c).alias("p")).alias(c) for c in cols]).first()
    clip, flag = {}, {}
    for c in cols:
        if s[c]["n"] >= min_n:
            clip[c] = (s[c]["m"] - k * s[c]["s"], s[c]["m"] + k * s[c]["s"])
            flag[c] = (s[c]["m"] - k * s[c]["p"], s[c]["m"] + k * s[c]["p"])
    return clip, flag


def clip(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Clamp to the bounds; nulls stay null."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(hi)), F.lit(lo)))
                           for c, (lo, hi) in bounds.items()})


def outlier_report(df: DataFrame, bounds: dict[str, tuple[float, float]],
                   flag: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(column, n_outliers, ratio, lower, upper) in one pass."""
    flag = flag or bounds
    one = df.agg(F.count("*").alias("n"), *[
        F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"k{i}") for i, (c, (lo, hi)) in enumerate(flag.items())])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"k{i}").alias("n_outliers"),
                 (F.col(f"k{i}") / F.greatest(F.col("n"), F.lit(1))).alias("ratio"),
                 F.lit(float(bounds[c][0])).alias("lower"), F.lit(float(bounds[c][1])).alias("upper"))
        for i, c in enumerate(flag)])).alias("r")).select("r.*")


def winsorize(df: DataFrame, cols: list[str], method: str = "iqr", k: float = 1.5) -> DataFrame:
    bounds = iqr_bounds(df, cols, k) if method == "iqr" else zscore_bounds(df, cols, k)[0]
    return clip(df, bounds) if bounds else df


def clean(df: DataFrame, threshold: float = 0.5, method: str = "iqr", k: float = 1.5,
          max_unique: int = 20, max_ratio: float = 0.3) -> CleanResult:
    """Dedup, infer, coerce, drop sparse, impute, winsorize, infer again."""
    spark = df.sparkSession
    base = materialize(df.dropDuplicates())  # the passes below must not repeat the dedup shuffle
    meta = ty.column_meta(base, "", max_unique, max_ratio, with_median=False)
    kinds = ty.semantic_types(meta)
    work = ty.coerce_datetime(base, [c for c, t in kinds.items() if t == "datetime"])
    work = ty.coerce_numeric(work, [c for c, t in kinds.items()
                                    if t == "continuous" and c not in ty.numeric_columns(work)])
    before = {r["column"]: (r["n_missing"], r["missing_rate"]) for r in ty.missing_ratio(work).collect()}
    dropped = [c for c in work.columns if before[c][1] > threshold]
    work = ty.drop_empty_rows(work.drop(*dropped))
    holes = [c for c in work.columns if before[c][0] > 0]
    cont = [c for c in holes if kinds[c] == "continuous"]
    cats = [c for c in holes if kinds[c] in ("categorical", "binary")]
    if cont:
        work = impute_median(work, cont)
    if cats:
        work = impute_mode(work, cats)
    numeric = [c for c in work.columns if kinds[c] == "continuous" and c in ty.numeric_columns(work)]
    bounds, flag = (iqr_bounds(work, numeric, k), None) if method == "iqr" else zscore_bounds(work, numeric, k)
    outliers = {r["column"]: r for r in outlier_report(work, bounds, flag).collect()} if bounds else {}
    work = clip(work, {c: bounds[c] for c in bounds if outliers[c]["n_outliers"] > 0})
    rows = [(c, kinds[c], before[c][0], c in dropped,
             "median" if c in cont else "mode" if c in cats else None,
             before[c][0] if c in cont + cats else 0,
             outliers[c]["n_outliers"] if c in outliers else 0,
             outliers[c]["lower"] if c in outliers else None,
             outliers[c]["upper"] if c in outliers else None) for c in df.columns]
    report = spark.createDataFrame(rows, "column string, semantic_type string, n_missing long, dropped boolean, "
                                         "imputed_by string, n_imputed long, n_outliers long, lower double, upper double")
    return CleanResult(work, ty.column_meta(work, "", max_unique, max_ratio, with_median=False), report)
