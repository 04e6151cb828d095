"""Propensity scores, matching estimates and balance tables."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import t_two_sided
from ..sources.workspace import materialize
from .assignment import one_to_one_match
from .gram import estimate_row
from .joins import nearest_match
from .typing import binarize, numeric_columns, standardize



def confounders(df: DataFrame, y: str, treatment: str, causes: list[str]) -> list[str]:
    numeric = numeric_columns(df)
    chosen = [c for c in causes if c in numeric and c not in (y, treatment)]
    return chosen or [c for c in numeric if c not in (y, treatment)]


def propensity(df: DataFrame, treated: str, xs: list[str], c: float = 1.0, out: str = "score") -> DataFrame:
    """L2 logistic score on standardized confounders; the penalty equals C = c."""
    work = standardize(df.na.drop(subset=[treated, *xs]), xs)
    packed = VectorAssembler(inputCols=[f"{x}_z" for x in xs], outputCol="__x").transform(work)
    n = packed.count()
    model = LogisticRegression(featuresCol="__x", labelCol=treated, regParam=1.0 / (c * n), elasticNetParam=0.0,
                               standardization=False, maxIter=1000, tol=1e-6,
                               probabilityCol="__p", rawPredictionCol="__r", predictionCol="__y").fit(packed)
    return (model.transform(packed).withColumn(out, vector_to_array("__p")[1])
            .drop("__x", "__p", "__r", "__y", *[f"{x}_z" for x in xs]))


def matched_rows(df: DataFrame, matches: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row per treated unit with both sides' columns (t_*, c_*)."""
    t = df.select(F.col(key).alias("treated_key"), *[F.col(x).alias(f"t_{x}") for x in cols])
    c = df.select(F.col(key).alias("control_key"), *[F.col(x).alias(f"c_{x}") for x in cols])
    return matches.join(t, "treated_key").join(c, "control_key")


def att_table(pairs: DataFrame, y: str) -> DataFrame:
    """att, se = sd/sqrt(n), t statistic and +-1.96 se as one lazy row."""
    d = F.col(f"t_{y}") - F.col(f"c_{y}")
    return (pairs.agg(F.avg(d).alias("ate"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))
            .withColumns({"stat": F.col("ate") / F.col("se"), "ci_lower": F.col("ate") - 1.96 * F.col("se"),
                          "ci_upper": F.col("ate") + 1.96 * F.col("se")}))


def att(pairs: DataFrame, y: str, treatment: str) -> DataFrame:
    r = att_table(pairs, y).first()
    p = t_two_sided(r["stat"], max(1, r["n"] - 1)) if r["se"] and r["se"] > 0 else 1.0
    return estimate_row(pairs.sparkSession, "propensity_score", y, treatment, r["ate"], r["se"] or 0.0,
                        r["stat"] if r["se"] else 0.0, p, r["ci_lower"], r["ci_upper"], r["n"])


def _smd(mt: Column, vt: Column, mc: Column, vc: Column) -> Column:
    pooled = F.sqrt((vt + vc) / 2)
    return F.when(pooled > 0, F.abs(mt - mc) / pooled).otherwise(0.0)


def balance(df: DataFrame, pairs: DataFrame, treated: str, xs: list[str], threshold: float = 0.1) -> DataFrame:
    """Per covariate: means, SMD before and after matching, improved and balanced flags."""
    t, c = F.col(treated) == 1, F.col(treated) == 0
    before = df.agg(*[e.alias(f"{n}{i}") for i, x in enumerate(xs) for n, e in (
        ("mt", F.avg(F.when(t, F.col(x)))), ("vt", F.var_samp(F.when(t, F.col(x)))),
        ("mc", F.avg(F.when(c, F.col(x)))), ("vc", F.var_samp(F.when(c, F.col(x)))))])
    after = pairs.agg(*[e.alias(f"{n}{i}") for i, x in enumerate(xs) for n, e in (
        ("at", F.avg(f"t_{x}")), ("bt", F.var_samp(f"t_{x}")), ("ac", F.avg(f"c_{x}")), ("bc", F.var_samp(f"c_{x}")))])
    wide = before.crossJoin(after)  # one row on each side
    rows = wide.select(F.explode(F.array(*[F.struct(
        F.lit(x).alias("covariate"), F.col(f"mt{i}").alias("mean_treated"), F.col(f"mc{i}").alias("mean_control"),
        _smd(F.col(f"mt{i}"), F.col(f"vt{i}"), F.col(f"mc{i}"), F.col(f"vc{i}")).alias("smd_before"),
        _smd(F.col(f"at{i}"), F.col(f"bt{i}"), F.col(f"ac{i}"), F.col(f"bc{i}")).alias("smd_after"))
        for i, x in enumerate(xs)])).alias("r")).select("r.*")
    return rows.withColumns({"improved": F.col("smd_after") < F.col("smd_before"),
                             "balanced": F.col("smd_after") < threshold})


def love_table(before: DataFrame, after: DataFrame) -> DataFrame:
    """SMD pairs of covariates present on both sides, largest imbalance first."""
    return before.join(after, "covariate").orderBy(F.desc("smd_before"), "covariate")


def common_support(df: DataFrame, treated: str, score: str) -> DataFrame:
    """Rows inside the overlap of the two arms' score ranges (a one-row bound)."""
    r = df.agg(F.greatest(F.min(F.when(F.col(treated) == 1, F.col(score))), F.min(F.when(F.col(treated) == 0, F.col(score)))).alias("lo"),
               F.least(F.max(F.when(F.col(treated) == 1, F.col(score))), F.max(F.when(F.col(treated) == 0, F.col(score)))).alias("hi")).first()
    return df.filter(F.col(score).between(F.lit(r["lo"]), F.lit(r["hi"])))


def propensity_score_matching(df: DataFrame, key: str, y: str, treatment: str, causes: list[str], replace: bool = True):
    """Binarize, score, match 1-NN with replacement, or one to one at the least total distance; returns (pairs, scored, covariates)."""
    xs = confounders(df, y, treatment, causes)
    # the score feeds several passes of the match: compute it once
    scored = materialize(propensity(binarize(df, treatment, "__treated"), "__treated", xs).select(
        key, "__treated", "score", *dict.fromkeys([y, *xs])))
    match = nearest_match if replace else one_to_one_match
    pairs = matched_rows(scored, match(scored, key, "__treated", "score"), key, [y, *xs])
    return pairs, scored, xs
