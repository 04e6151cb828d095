"""Matching without replacement against the exact assignment of a small line."""

import numpy as np
import pytest

from effectloom.operators import psm
from effectloom.operators.assignment import one_to_one_match


def least_total(t, c):
    """Exact assignment of sorted points: every one of the fewer gets a partner, in order."""
    t, c = sorted(t), sorted(c)
    if len(t) > len(c):
        t, c = c, t
    best = np.zeros(len(c) + 1)
    for i, x in enumerate(t):
        row = np.full(len(c) + 1, np.inf)
        for j in range(i + 1, len(c) + 1):
            row[j] = min(row[j - 1], best[j - 1] + abs(x - c[j - 1]))
        best = row
    return best[-1]


@pytest.mark.parametrize("share,coarse,slice_rows", [(0.2, 1000, 10_000), (0.5, 1000, 37), (0.5, 8, 20), (0.8, 50, 37), (0.45, 10 ** 6, 25)])
@pytest.mark.parametrize("shift", [0.0, 0.4])
def test_least_total_distance(spark, share, coarse, slice_rows, shift):
    rng = np.random.default_rng(int(share * 100) + coarse)
    arm = (rng.uniform(size=300) < share).astype(int)
    s = np.round(rng.uniform(size=300) + shift * arm, 6)
    s = np.round(s * coarse) / coarse
    df = spark.createDataFrame([(i, int(a), float(x)) for i, (a, x) in enumerate(zip(arm, s))], "id long, t int, s double")
    got = one_to_one_match(df, "id", "t", "s", slice_rows).collect()
    assert len(got) == min(arm.sum(), (1 - arm).sum())
    assert len({r["treated_key"] for r in got}) == len({r["control_key"] for r in got}) == len(got)
    assert all(arm[r["treated_key"]] == 1 and arm[r["control_key"]] == 0 for r in got)
    assert all(r["distance"] == abs(s[r["treated_key"]] - s[r["control_key"]]) for r in got)
    assert sum(r["distance"] for r in got) == pytest.approx(least_total(s[arm == 1], s[arm == 0]), abs=1e-6)


def test_one_side_alternation_and_odd_rows(spark):
    # all treated below all controls: nested, however long the run
    df = spark.createDataFrame([(i, int(i < 50), float(i)) for i in range(120)], "id long, t int, s double")
    got = one_to_one_match(df, "id", "t", "s", 16).collect()
    assert {r["control_key"] for r in got} == set(range(50, 100)) and sum(r["distance"] for r in got) == 2500
    # strict alternation is one hot level
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(201)], "id long, t int, s double")
    got = one_to_one_match(df, "id", "t", "s", 16).collect()
    assert len(got) == 100 and all(r["distance"] == 1 for r in got)
    odd = spark.createDataFrame([(1, 1, 0.5), (2, 0, None), (3, None, 0.5), (4, 0, float("nan")), (None, 0, 0.5)], "id long, t int, s double")
    assert one_to_one_match(odd, "id", "t", "s").count() == 0
    assert one_to_one_match(odd.limit(0), "id", "t", "s").count() == 0


def test_estimate_without_replacement(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=600)
    t = (rng.uniform(size=600) < 1 / (1 + np.exp(1.2 - x))).astype(int)
    y = 2.0 * t + x + rng.normal(0, 0.1, 600)
    df = spark.createDataFrame([(i, float(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(x, t, y))], "id long, x double, t int, y double")
    pairs, _, _ = psm.propensity_score_matching(df, "id", "y", "t", ["x"], replace=False)
    r = psm.att_table(pairs, "y").first()
    assert r["n"] == t.sum() and pairs.select("control_key").distinct().count() == r["n"]
    assert r["ate"] == pytest.approx(2.0, abs=0.6)
