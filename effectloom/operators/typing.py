"""Semantic column typing, coercion and model-frame preparation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import exact_quantiles, median, number, read_sketch, sketch_of

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)

DISTINCT_COLUMNS = 1  # columns per distinct-count pass: one alone is not expanded, and the pass reads no other column

META_SCHEMA = ("table string, column string, dtype string, semantic_type string, n long, n_missing long, "
               "n_unique long, mean double, std double, min double, max double, median double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def is_temporal(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, TEMPORAL)


def value_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, value, n) for every non-null value of every column.

    The rows are unpivoted before one grouped count, so a value that fills a
    third of a column is already combined on the map side.
    """
    cols = cols or df.columns
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    return (df.select(pairs.alias("p")).select("p.column", "p.value")
            .filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count("*").alias("n")))


def column_meta(df: DataFrame, table: str = "", max_unique: int = 20, max_ratio: float = 0.3,
                date_ratio: float = 0.8, with_median: bool = True, exact_unique: bool = True) -> DataFrame:
    """One row per column: counts, moments and the inferred semantic type.

    Rules: datetime by physical type; two distinct values or fewer is binary;
    text is datetime when more than ``date_ratio`` of rows parse, continuous
    when all non-null values are numbers, else categorical; a number with few
    distinct values relative to the rows is categorical.

    ``exact_unique=False`` takes every distinct count from a sketch: no shuffle,
    but the counts, and types near the thresholds, are estimates.
    """
    spark = df.sparkSession
    cols, nums = df.columns, numeric_columns(df)
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    aggs = [F.count("*").alias("n")]
    aggs += [F.count(F.col(c)).alias(f"present_{i}") for i, c in enumerate(cols)]
    for i, c in enumerate(cols):
        if c in nums:
            d = F.col(c).cast("double")
            aggs += [F.avg(d).alias(f"mean_{i}"), F.stddev_samp(d).alias(f"std_{i}"),
                     F.min(d).alias(f"min_{i}"), F.max(d).alias(f"max_{i}")]
        elif c in text:
            aggs += [F.count(F.try_to_timestamp(F.col(c))).alias(f"dates_{i}"),
                     F.count(F.expr(f"try_cast(`{c}` as double)")).alias(f"numbers_{i}")]
    if with_median:
        aggs += [sketch_of(number(c)).alias(f"quantiles_{cols.index(c)}") for c in nums]
    if not exact_unique:
        aggs += [F.approx_count_distinct(F.col(c)).alias(f"sketch_{i}") for i, c in enumerate(cols)]
    first = df.agg(*aggs).first()
    s = first.asDict()
    unique = {} if exact_unique else {c: s[f"sketch_{i}"] for i, c in enumerate(cols)}
    counted = cols if exact_unique else []
    for at in range(0, len(counted), DISTINCT_COLUMNS):
        part = counted[at:at + DISTINCT_COLUMNS]
        row = df.agg(*[F.count_distinct(F.col(c)).alias(f"u{i}") for i, c in enumerate(part)]).first()
        unique |= {c: row[f"u{i}"] for i, c in enumerate(part)}
    medians = exact_quantiles(df, {c: [0.5] for c in nums}, {c: read_sketch(first[f"quantiles_{cols.index(c)}"]) for c in nums}) if with_median and nums else {}
    n, rows = s["n"], []
    for i, c in enumerate(cols):
        u = unique.get(c, 0)
        present = s[f"present_{i}"]
        if is_temporal(df, c):
            kind = "datetime"
        elif u <= 2:
            kind = "binary"
        elif c in text:
            if s[f"dates_{i}"] / max(1, n) > date_ratio:
                kind = "datetime"
            else:
                kind = "continuous" if s[f"numbers_{i}"] == present else "categorical"
        elif c in nums:
            kind = "categorical" if u <= max_unique and u / n < max_ratio else "continuous"
        else:
            kind = "categorical"
        rows.append((table, c, df.schema[c].dataType.simpleString(), kind, n, n - present, u,
                     s.get(f"mean_{i}"), s.get(f"std_{i}"), s.get(f"min_{i}"), s.get(f"max_{i}"),
                     (medians.get(c) or [None])[0]))
    return spark.createDataFrame(rows, META_SCHEMA)


def semantic_types(meta: DataFrame) -> dict[str, str]:
    """Column to type; the meta table has one row per column of the schema."""
    return {r["column"]: r["semantic_type"] for r in meta.select("column", "semantic_type").collect()}


def columns_by_type(meta: DataFrame, *types: str) -> list[str]:
    return [c for c, t in semantic_types(meta).items() if t in types]


def select_by_type(df: DataFrame, meta: DataFrame, *types: str) -> DataFrame:
    keep = set(columns_by_type(meta, *types))
    return df.select(*[c for c in df.columns if c in keep])


def coerce_datetime(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to timestamp; anything unparseable becomes null."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in cols if not is_temporal(df, c)})


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in cols})


def missing_ratio(df: DataFrame) -> DataFrame:
    """(column, n_missing, missing_rate) in one pass, unpivoted."""
    one = df.agg(F.count("*").alias("n"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), (F.col("n") - F.col(f"c{i}")).alias("n_missing"),
                 ((F.col("n") - F.col(f"c{i}")) / F.greatest(F.col("n"), F.lit(1))).alias("missing_rate"))
        for i, c in enumerate(df.columns)]))
    return one.select(rows.alias("r")).select("r.*")


def drop_sparse_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    sparse = [r["column"] for r in missing_ratio(df).filter(F.col("missing_rate") > threshold).collect()]
    return df.drop(*sparse)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)


def binarize(df: DataFrame, col: str, out: str = "treated") -> DataFrame:
    """Two-valued columns become 0/1 by order; others split at the exact median (strict)."""
    lo, hi, other = (lambda r: (r[0], r[1], r[2]))(df.agg(
        F.min(col), F.max(col), F.lit(0)).first())
    between = df.filter((F.col(col) > F.lit(lo)) & (F.col(col) < F.lit(hi))).isEmpty()
    if between and lo != hi:
        return df.withColumn(out, (F.col(col) == F.lit(hi)).cast("int"))
    return df.withColumn(out, (F.col(col) > F.lit(median(df, col))).cast("int"))


def standardize(df: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """Sample-standard z-scores; moments come from one aggregate of 2k scalars."""
    aggs = [f(F.col(c).cast("double")).alias(f"{p}_{i}") for i, c in enumerate(cols)
            for p, f in (("m", F.avg), ("s", F.stddev_samp))]
    m = df.agg(*aggs).first()
    return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m[f"m_{i}"])) / F.lit(m[f"s_{i}"] or None)
                           for i, c in enumerate(cols)})


def treatment_post(df: DataFrame, treated: Column, post: Column) -> DataFrame:
    """Indicator and interaction columns for a two-period comparison."""
    return (df.withColumn("treated", treated.cast("int")).withColumn("post", post.cast("int"))
            .withColumn("treat_post", F.col("treated") * F.col("post")))


def cutoff_features(df: DataFrame, running: str, cutoff: float) -> DataFrame:
    """Centered running variable, side indicator and their interaction."""
    rc = F.col(running) - F.lit(cutoff)
    above = (F.col(running) >= F.lit(cutoff)).cast("int")
    return df.withColumns({"rc": rc, "above": above, "inter": rc * above})


def row_sum(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    return df.withColumn(out, reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in cols]))


def mark_missing(df: DataFrame, cols: list[str], out: str = "data_completeness") -> DataFrame:
    """``<col>_status`` of present/missing plus the share of present fields."""
    status = {f"{c}_status": F.when(F.col(c).isNull(), "missing").otherwise("present") for c in cols}
    present = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])
    return df.withColumns(status).withColumn(out, present / F.lit(len(cols)))
