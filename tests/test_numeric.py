"""Tails against published table values; quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectloom.functions import quantiles as q
from effectloom.functions import tails as t
from effectloom.operators.churn import min_sample


@pytest.mark.parametrize("got,want", [
    (t.t_two_sided(2.228, 10), 0.05), (t.t_two_sided(12.706, 1), 0.05), (t.t_two_sided(2.0, 60), 0.0500),
    (t.f_sf(4.103, 2, 10), 0.05), (t.f_sf(3.49, 3, 12), 0.05), (t.chi2_sf(3.841, 1), 0.05), (t.chi2_sf(18.307, 10), 0.05),
    (2 * t.normal_sf(1.959964), 0.05)])
def test_table_values(got, want):
    assert got == pytest.approx(want, abs=3e-4)


def test_quantile_inverses():
    assert t.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert t.t_quantile_two_sided(0.05, 10) == pytest.approx(2.228139, abs=1e-5)
    assert t.t_two_sided(t.t_quantile_two_sided(0.01, 7), 7) == pytest.approx(0.01, abs=1e-10)


def test_sample_size_is_textbook():
    assert min_sample(0.5) == 1562  # 50% base rate, five points, alpha .05, power .8


@pytest.mark.parametrize("shape", ["uniform", "lognormal", "one_heavy_value", "constant"])
def test_exact_quantiles_by_passes(spark, shape):
    rng = np.random.default_rng(7)
    v = {"uniform": rng.uniform(-5, 5, 3001), "lognormal": rng.lognormal(0, 3, 3000),
         "one_heavy_value": np.where(rng.uniform(size=3000) < 0.4, 2.5, rng.normal(size=3000)), "constant": np.full(50, 3.0)}[shape]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    probs = [0.0, 0.2, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = q.exact_quantiles(df, {"v": probs}, cells=16, listed=8, grid=32)["v"]
    assert got == pytest.approx(list(np.quantile(v, probs)), rel=1e-12)
    assert q.exact_quantiles(df, {"v": probs})["v"] == pytest.approx(got, rel=1e-12)


def test_quantiles_of_empty_column(spark):
    df = spark.range(5).select(F.lit(None).cast("double").alias("v"))
    assert q.exact_quantiles(df, {"v": [0.5]})["v"] == [None]


def test_quantiles_of_extreme_values(spark):
    import math

    import numpy as np

    from effectloom.functions.quantiles import exact_quantiles, order_statistics
    rng = np.random.default_rng(5)
    wide = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), [1.7e308, -1.7e308] * 3])
    tiny = rng.integers(0, 50, 306) * 5e-324
    odd = np.concatenate([rng.normal(size=300), [math.inf, math.inf, -math.inf, math.nan, math.nan, 1e300]])
    rows = [(float(a), float(b), float(c), None if i % 7 else float(a)) for i, (a, b, c) in enumerate(zip(wide, tiny, odd))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for col, kept in (("a", wide), ("b", tiny), ("c", odd[~np.isnan(odd)]), ("d", wide[::7])):
        kept = np.sort(kept)
        ranks = [0, 1, len(kept) // 3, len(kept) - 2, len(kept) - 1]
        assert order_statistics(df, col, ranks, cells=8, listed=4, grid=16) == [kept[r] for r in ranks]
    got = exact_quantiles(df, {"b": [0.5], "c": [0.0, 0.25, 1.0], "d": [0.5]}, cells=8, listed=4, grid=16)
    c = odd[~np.isnan(odd)]
    assert got["c"][0] == -math.inf and got["c"][2] == math.inf and got["c"][1] == np.quantile(c, 0.25)
    assert got["b"] == [np.quantile(tiny, 0.5)]


def test_quantiles_with_a_wrong_sketch(spark):
    """A bracket that misses its rank is widened until it holds it."""
    v = np.random.default_rng(4).normal(size=3000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    wrong = {"v": q.Sketch(3000, sorted(float(x) for x in v + 0.7)[::30])}
    for listed in (10, 50_000):
        assert q.exact_quantiles(df, {"v": [0.1, 0.5, 0.51, 0.9]}, wrong, listed=listed)["v"] == pytest.approx(list(np.quantile(v, [0.1, 0.5, 0.51, 0.9])), rel=1e-12)
