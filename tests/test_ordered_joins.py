"""Ordered operators and matching against brute force, with hot keys and ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from effectloom.operators import joins as jn
from effectloom.operators import ordered as od
from effectloom.operators import profiling as pf


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    # user 0 holds half of all rows; times repeat
    return [(i, 0 if rng.uniform() < 0.5 else int(rng.integers(1, 9)), float(rng.integers(0, 150)),
             None if rng.uniform() < 0.3 else int(rng.integers(0, 50))) for i in range(600)]


@pytest.mark.parametrize("direction", ["back", "ahead"])
@pytest.mark.parametrize("include", [True, False])
@pytest.mark.parametrize("slice_rows", [10_000, 17])
def test_carry(spark, rows, direction, include, slice_rows):
    df = spark.createDataFrame(rows, "id long, u long, t double, v long")
    out = od.carry(df, ["u"], ["t", "id"], {"got": F.col("v")}, direction, include, slice_rows)
    got = {r["id"]: r["got"] for r in out.collect()}
    p = pd.DataFrame(rows, columns=["id", "u", "t", "v"]).sort_values(["u", "t", "id"])
    s = p.groupby("u")["v"]
    filled = s.ffill() if direction == "back" else s.bfill()
    if not include:
        filled = filled.groupby(p["u"]).shift(1 if direction == "back" else -1)
    want = {i: None if pd.isna(x) else int(x) for i, x in zip(p["id"], filled)}
    assert got == want


@pytest.mark.parametrize("slice_rows", [10_000, 17])
def test_running_sum_and_sessions(spark, rows, slice_rows):
    df = spark.createDataFrame(rows, "id long, u long, t double, v long").withColumn("ts", F.timestamp_seconds(F.col("t") * 60))
    out = od.running_sum(df, ["u"], ["t", "id"], F.coalesce("v", F.lit(0)), "cum", slice_rows)
    p = pd.DataFrame(rows, columns=["id", "u", "t", "v"]).sort_values(["u", "t", "id"])
    want = dict(zip(p["id"], p["v"].fillna(0).groupby(p["u"]).cumsum()))
    assert {r["id"]: r["cum"] for r in out.collect()} == want
    sess = od.sessionize(df, "u", "ts", "id", 180, slice_rows).collect()
    p["new"] = (p.groupby("u")["t"].diff().fillna(99) >= 3).astype(int)
    assert len(sess) == p["new"].sum() and sum(r["n_events"] for r in sess) == len(p)


@pytest.mark.parametrize("spread", [1, 30])
def test_hot_key_at_one_instant_spreads(spark, spread):
    """All rows of a key carry the same time (or few times): slices follow the full order."""
    n = 3000
    df = spark.range(n).select("id", F.lit(1).alias("u"), (F.col("id") % spread).cast("double").alias("t"))
    hot = od.hot_keys(df, ["u"], 300)
    sizes = [r["n"] for r in od.with_slices(df, ["u"], ["t", "id"], hot, 300).groupBy("__slice").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == n and len(sizes) >= 9 and max(sizes) < 900
    out = od.running_sum(df, ["u"], ["t", "id"], F.lit(1), "rank", 300)
    want = {i: k + 1 for k, i in enumerate(sorted(range(n), key=lambda i: (i % spread, i)))}
    assert {r["id"]: r["rank"] for r in out.collect()} == want
    prev = od.carry(df, ["u"], ["t", "id"], {"prev": F.col("id")}, slice_rows=300)
    by_rank = {k: i for i, k in want.items()}
    assert {r["id"]: r["prev"] for r in prev.collect()} == {i: by_rank.get(k - 1) for i, k in want.items()}


@pytest.mark.parametrize("direction,strict", [("back", False), ("back", True), ("ahead", False), ("ahead", True)])
def test_asof(spark, rows, direction, strict):
    left = spark.createDataFrame([(i, u, t) for i, u, t, _ in rows], "id long, u long, t double").withColumn("lt", F.timestamp_seconds("t"))
    right_rows = sorted({(u, t) for _, u, t, v in rows if v is not None and v % 3 == 0})
    right = spark.createDataFrame([(u, t, u * 1000 + t) for u, t in right_rows], "u long, t double, w double").select("u", F.timestamp_seconds("t").alias("rt"), "w")
    out = jn.asof_join(left, right, "u", "lt", "rt", ["w"], direction, strict, slice_rows=23)
    test = {("back", False): lambda a, b: b <= a, ("back", True): lambda a, b: b < a,
            ("ahead", False): lambda a, b: b >= a, ("ahead", True): lambda a, b: b > a}[(direction, strict)]
    for r in out.collect():
        fit = [t for u, t in right_rows if u == r["u"] and test(r["t"], t)]
        want = None if not fit else r["u"] * 1000 + (max(fit) if direction == "back" else min(fit))
        assert r["w"] == want


@pytest.mark.parametrize("slices", [1, 2, 7])
@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_match_brute_force(spark, slices, seed):
    rng = np.random.default_rng(seed)
    # a third of all units share one score; scores are coarse, so distances tie
    units = [(i, int(rng.uniform() < 0.3), 0.5 if rng.uniform() < 0.33 else float(rng.integers(0, 40)) / 40) for i in range(300)]
    df = spark.createDataFrame(units, "id long, t int, s double")
    got = {r["treated_key"]: r["control_key"] for r in jn.nearest_match(df, "id", "t", "s", slices=slices).collect()}
    controls = [(k, s) for k, t, s in units if t == 0]
    want = {k: min(controls, key=lambda c: (abs(c[1] - s), c[0]))[0] for k, t, s in units if t == 1}
    assert got == want


def test_nearest_match_one_sided(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.1), (3, 1, 0.05)], "id long, t int, s double")
    got = {r["treated_key"]: r["control_key"] for r in jn.nearest_match(df, "id", "t", "s", slices=3).collect()}
    assert got == {1: 2, 3: 2}


def test_lookup_members_brackets(spark):
    df = spark.createDataFrame([(1, "a"), (2, "z")], "id long, k string")
    dim = spark.createDataFrame([("a", 5.0)], "k string, v double")
    assert {r["id"]: r["v"] for r in jn.lookup(df, dim, "k", {"v": -1.0}).collect()} == {1: 5.0, 2: -1.0}
    amounts = spark.createDataFrame([(60_000.0,), (250_000.0,)], "x double")
    steps = [(0, 50_000, 0.6), (50_000, 100_000, 0.65), (100_000, None, 0.7)]
    assert [r["y"] for r in amounts.select(jn.bracket_sum(F.col("x"), steps).alias("y")).collect()] == pytest.approx(
        [30_000 + 6_500, 30_000 + 32_500 + 105_000])


def test_order_does_not_matter(spark, rows):
    df = spark.createDataFrame(rows, "id long, u long, t double, v long")
    one = pf.correlations(df.repartition(1), ["t", "v"]).first()["r"]
    many = pf.correlations(df.repartition(7, "id"), ["t", "v"]).first()["r"]
    assert one == pytest.approx(many, abs=1e-12)


def test_median_period_and_histogram(spark):
    df = spark.range(100).select((F.col("id") % 11).alias("p"), F.col("id").cast("double").alias("v"))
    assert od.median_period(df, "p") == 5
    h = pf.histogram(df, "v", 10).collect()
    assert sum(r["n"] for r in h) == 100 and max(r["bin"] for r in h) == 9


def test_lapse_states_know_only_the_past(spark):
    from datetime import date

    from effectloom.operators import policy as po
    due = date(2024, 1, 1)
    sched = spark.createDataFrame([(k, due, 100.0) for k in range(6)], "policy_id int, due_date date, due_amount double")
    paid = spark.createDataFrame([(0, due, date(2024, 1, 31)), (1, due, date(2024, 3, 5)), (2, due, date(2024, 7, 1)), (3, due, date(2026, 5, 1))],
                                 "policy_id int, due_date date, paid_date date")

    def states(day):
        return {r["policy_id"]: r["state"] for r in po.lapse_state(sched, paid, day).collect()}
    assert states("2023-12-31") == {k: "due" for k in range(6)}
    assert states("2024-01-30") == {k: "grace" for k in range(6)}  # no payment has been made yet
    assert states("2024-03-01") == {0: "paid"} | {k: "grace" for k in range(1, 6)}  # the last day of grace
    assert states("2024-03-02") == {0: "paid"} | {k: "lapsed" for k in range(1, 6)}
    assert states("2024-03-05")[1] == "reinstated" and states("2024-06-30")[2] == "lapsed" and states("2024-07-01")[2] == "reinstated"
    assert states("2026-03-01")[5] == "lapsed" and states("2026-03-02")[5] == "terminated"
    assert states("2026-06-01")[3] == "terminated"  # paid after the window


def test_schedule_runs_as_long_as_the_policy(spark):
    from datetime import date

    from effectloom.operators import policy as po
    p = spark.createDataFrame([(1, date(2010, 1, 1), "annual", 100.0)], "policy_id int, effective_date date, pay_freq string, premium double")
    assert po.payment_schedule(p, "2017-06-30").count() == 8


def test_short_slices_cost_no_tasks(spark):
    """The number of tasks follows the rows and the shuffle's partitions, not the number of slices."""
    n = 4000
    df = spark.range(n).select("id", (F.col("id") % 3).alias("u"), (F.col("id") % 40).cast("double").alias("t"))
    out = od.with_slices(df, ["u"], ["t", "id"], od.hot_keys(df, ["u"], 10), 10)
    cells = out.withColumn("task", F.shiftright("__slice", 33)).groupBy("task", "__slice").agg(F.count("*").alias("n")).collect()
    assert len({r["task"] for r in cells}) <= 4 and len(cells) >= 400 and max(r["n"] for r in cells) == 10
    prev = od.carry(df, ["u"], ["t", "id"], {"prev": F.col("id")}, slice_rows=10).filter("prev IS NOT NULL")
    order = sorted(range(n), key=lambda i: (i % 3, i % 40, i))
    assert {r["id"]: r["prev"] for r in prev.collect()} == {b: a for a, b in zip(order, order[1:]) if a % 3 == b % 3}
