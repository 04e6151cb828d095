"""Sharp regression discontinuity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import median
from .gram import LinearFit, ols
from .typing import cutoff_features, numeric_columns

MIN_INSIDE = 30


@dataclass
class RddResult:
    fit: LinearFit
    running: str
    cutoff: float
    bandwidth: float
    used_all_rows: bool


def default_running(df: DataFrame, causes: list[str], y: str, treatment: str | None = None) -> tuple[str, float]:
    """First numeric cause and its exact median."""
    numeric = set(numeric_columns(df))
    for c in causes:
        if c in numeric and c not in (y, treatment):
            return c, median(df, c)
    raise ValueError("no numeric running variable")


def rot_bandwidth(df: DataFrame, running: str, y: str) -> float:
    """2 x 1.06 sigma n^(-1/5) over complete rows."""
    r = df.select(running, y).na.drop().agg(F.stddev_samp(running).alias("s"), F.count("*").alias("n")).first()
    return 1.06 * r["s"] * r["n"] ** (-0.2) * 2.0


def rdd(df: DataFrame, y: str, running: str, cutoff: float, bandwidth: float | None = None, widen: bool = False) -> RddResult:
    """Local linear fit y ~ rc + above + rc*above inside the bandwidth.

    With fewer than MIN_INSIDE rows inside it raises, or on request fits all rows
    and says so in the method's name.
    """
    bw = rot_bandwidth(df, running, y) if bandwidth is None else bandwidth
    frame = cutoff_features(df.select(running, y).na.drop(), running, cutoff)
    inside = frame.filter(F.abs("rc") <= F.lit(bw))
    few = inside.limit(MIN_INSIDE).count() < MIN_INSIDE
    if few and not widen:
        raise ValueError(f"fewer than {MIN_INSIDE} rows within {bw} of the cutoff")
    return RddResult(ols(frame if few else inside, y, ["rc", "above", "inter"], "rdd_all_rows" if few else "rdd"), running, cutoff, bw, few)


def density_chi2(df: DataFrame, running: str, cutoff: float) -> DataFrame:
    """Two-count chi-square of an even split at the cutoff."""
    half = (F.col("below") + F.col("above")) / 2
    return (df.agg(F.count_if(F.col(running) < cutoff).alias("below"), F.count_if(F.col(running) >= cutoff).alias("above"))
            .withColumn("chi2", F.when(half > 0, (F.pow(F.col("below") - half, 2) + F.pow(F.col("above") - half, 2)) / half)
                        .otherwise(0.0))
            .withColumn("concern", F.col("chi2") > 3.84))


def binned_scatter(df: DataFrame, running: str, y: str, cutoff: float, width: float) -> DataFrame:
    """Means per bin; bins never straddle the cutoff."""
    bin_no = F.floor((F.col(running) - F.lit(cutoff)) / F.lit(width))
    return (df.select(running, y).na.drop().groupBy(bin_no.alias("bin"))
            .agg(F.count("*").alias("n"), F.avg(running).alias("mean_running"), F.avg(y).alias("mean_outcome"))
            .withColumn("above", F.col("bin") >= 0))
