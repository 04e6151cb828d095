"""Estimators against numpy formulas and planted effects."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from effectloom.operators import dag, did, dml, gram, iv, panel, psm, rdd
from effectloom.operators import churn as ch
from effectloom.operators import selection as sel


def frame(spark, **cols):
    names = list(cols)
    return spark.createDataFrame(pd.DataFrame({c: cols[c] for c in names}))


def test_ols_matches_lstsq(spark):
    rng = np.random.default_rng(0)
    n = 500
    a, b, c = rng.normal(1e6, 3, n), rng.normal(size=n), rng.uniform(size=n)  # large offset: conditioning
    y = 3 + 0.5 * a - 2 * b + c + rng.normal(size=n)
    fit = gram.ols(frame(spark, a=a, b=b, c=c, y=y), "y", ["a", "b", "c"])
    x = np.column_stack([np.ones(n), a - a.mean(), b, c])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    cov = e @ e / (n - 4) * np.linalg.inv(x.T @ x)
    assert fit.coef == pytest.approx(beta[1:], rel=1e-7)
    assert fit.se == pytest.approx(np.sqrt(np.diag(cov))[1:], rel=1e-7)
    r2 = 1 - e @ e / ((y - y.mean()) @ (y - y.mean()))
    assert fit.r2 == pytest.approx(r2) and fit.f_value == pytest.approx(r2 / 3 / ((1 - r2) / (n - 4)), rel=1e-6)


@pytest.fixture(scope="module")
def panel_data():
    rng = np.random.default_rng(1)
    g = np.repeat(np.arange(40), rng.integers(3, 9, 40))
    alpha = rng.normal(0, 3, 40)[g]
    x, z = alpha + rng.normal(size=len(g)), rng.normal(size=len(g))
    return g, x, z, 2 * x - z + 4 * alpha + rng.normal(size=len(g))


def test_fixed_effects_and_clusters(spark, panel_data):
    g, x, z, y = panel_data
    res = panel.panel_regression(frame(spark, g=g, x=x, z=z, y=y), "g", "y", ["x", "z"])
    d = lambda v: v - pd.Series(v).groupby(g).transform("mean").to_numpy()
    X, Y = np.column_stack([d(x), d(z)]), d(y)
    beta = np.linalg.solve(X.T @ X, X.T @ Y)
    e = Y - X @ beta
    s = pd.DataFrame(X * e[:, None]).groupby(g).sum().to_numpy()
    inv = np.linalg.inv(X.T @ X)
    n, k, G = len(y), 2, 40
    assert res.fe.coef == pytest.approx(beta, rel=1e-9)
    counted = panel.panel_regression(frame(spark, g=g, x=x, z=z, y=y), "g", "y", ["x", "z"], count_effects=True)
    for fit, df in ((res.fe, n - k), (counted.fe, n - G - k)):
        assert fit.se == pytest.approx(np.sqrt(np.diag(inv @ (s.T @ s) @ inv) * n / df), rel=1e-9)
    assert abs(panel.pooled_ols(frame(spark, g=g, x=x, z=z, y=y), "y", ["x", "z"]).coef[0] - 2) > 1  # biased without effects
    assert res.hausman > 10 and res.hausman_p < 0.01  # effects correlate with x


def test_random_effects_matches_quasi_demeaning(spark, panel_data):
    g, x, z, y = panel_data
    res = panel.panel_regression(frame(spark, g=g, x=x, z=z, y=y), "g", "y", ["x", "z"])
    t = pd.Series(y).groupby(g).transform("size").to_numpy()
    th = 1 - np.sqrt(res.sigma2_e / (res.sigma2_e + t * res.sigma2_u))
    q = lambda v: v - th * pd.Series(v).groupby(g).transform("mean").to_numpy()
    X = np.column_stack([1 - th, q(x), q(z)])
    beta, *_ = np.linalg.lstsq(X, q(y), rcond=None)
    e = q(y) - X @ beta
    assert res.re.coef == pytest.approx(beta[1:], rel=1e-8)
    assert res.re.se == pytest.approx(np.sqrt(np.diag(e @ e / (len(y) - 3) * np.linalg.inv(X.T @ X)))[1:], rel=1e-8)


def test_absorbed_regressor_is_named(spark):
    df = spark.range(60).select((F.col("id") % 6).alias("g"), ((F.col("id") % 6) * 2.0).alias("w"), F.col("id").cast("double").alias("y"))
    with pytest.raises(ValueError, match="constant within"):
        panel.panel_regression(df, "g", "y", ["w"])


def test_did_recovers_interaction(spark):
    df = spark.range(4000).select((F.col("id") % 50).alias("firm_id"), (F.col("id") % 10).alias("year"),
                                  (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 - 0.5).alias("e"))
    df = df.withColumn("t", (F.col("firm_id") < 20).cast("int"))
    df = df.withColumn("y", 1 + 2 * F.col("t") + 0.3 * (F.col("year") >= 5).cast("int") + 1.5 * F.col("t") * (F.col("year") >= 5).cast("int") + F.col("e"))
    fit = did.did(df, "y", "t", "year")
    assert dict(zip(fit.terms, fit.coef))["treat_post"] == pytest.approx(1.5, abs=0.05)
    half = did.did_frame(df.drop("t"), None, "year", "firm_id")
    assert half.filter("treated = 1").select("firm_id").distinct().count() == 25
    es = {r["period"]: r["coef"] for r in did.event_study(df.withColumn("period", F.col("year") - 5), "period", "t", "y", -1).collect()}
    assert es[0] == pytest.approx(1.5, abs=0.1) and abs(es[-3]) < 0.1


def test_text_entities_split_in_half(spark):
    names = sorted({f"E{i % 7}{'x' * (i % 3)}{i}" for i in range(41)} | {"E", "E1", "E1x"})
    df = spark.createDataFrame([(n,) for n in names for _ in range(2)], "firm string")
    ids = df.distinct()
    assert [did.text_order_statistic(ids, "firm", r) for r in (0, 5, len(names) // 2, len(names) - 1)] == [
        names[r] for r in (0, 5, len(names) // 2, len(names) - 1)]
    got = {r["firm"] for r in did.half_of_entities(df, "firm").filter("treated = 1").collect()}
    assert got == set(names[:len(names) // 2])


def test_two_stage_removes_bias(spark):
    rng = np.random.default_rng(4)
    n = 4000
    z, x, u = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    t = z + 0.5 * x + u + rng.normal(size=n)
    y = 1.5 * t + x + 3 * u + rng.normal(size=n)
    df = frame(spark, z=z, x=x, t=t, y=y)
    assert iv.select_instrument(df, "t", ["x", "z"]) == "z"
    second, fs, partial = iv.two_stage(df, "y", "t", "z", ["x"])
    Z, X = np.column_stack([np.ones(n), z, x]), np.column_stack([np.ones(n), t, x])
    xh = Z @ np.linalg.lstsq(Z, X, rcond=None)[0]
    beta = np.linalg.solve(xh.T @ X, xh.T @ y)
    e = y - X @ beta
    inv = np.linalg.inv(xh.T @ xh)
    robust = np.sqrt(np.diag(inv @ (xh.T * e ** 2 @ xh) @ inv))
    assert second.coef == pytest.approx(beta[1:], rel=1e-8) and second.se == pytest.approx(robust[1:], rel=1e-8)
    assert abs(second.coef[0] - 1.5) < 0.1 < abs(gram.ols(df, "y", ["t", "x"]).coef[0] - 1.5)
    assert partial > 10 and fs.f_value > 10


def test_rdd_jump_and_density(spark):
    rng = np.random.default_rng(6)
    r = rng.uniform(-1, 1, 6000)
    df = frame(spark, r=r, y=2 * r + 3 * (r >= 0) + rng.normal(0, 0.2, 6000))
    res = rdd.rdd(df, "y", "r", 0.0)
    assert dict(zip(res.fit.terms, res.fit.coef))["above"] == pytest.approx(3, abs=0.05)
    assert not rdd.density_chi2(df, "r", 0.0).first()["concern"]
    assert rdd.density_chi2(df, "r", 0.5).first()["concern"]


def test_psm_balances_and_recovers(spark):
    rng = np.random.default_rng(8)
    n = 4000
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    t = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.8 * x1 - 0.5 * x2)))).astype(int)
    df = frame(spark, id=np.arange(n), t=t, x1=x1, x2=x2, y=2.0 * t + 3 * x1 - x2 + rng.normal(0, 0.3, n))
    pairs, scored, xs = psm.propensity_score_matching(df, "id", "y", "t", ["x1", "x2"])
    pairs = pairs.persist()
    est = psm.att(pairs, "y", "t").first()
    assert est["ate"] == pytest.approx(2.0, abs=0.15) and est["n"] == t.sum()
    for b in psm.balance(scored, pairs, "__treated", xs).collect():
        assert b["smd_before"] > 0.2 and b["smd_after"] < 0.1 and b["improved"]


def test_propensity_is_penalized_logistic(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=300)
    t = (rng.uniform(size=300) < 1 / (1 + np.exp(-x))).astype(int)
    z = (x - x.mean()) / x.std(ddof=1)
    w, b = 0.0, 0.0
    for _ in range(100):  # Newton steps on mean loss + w^2/(2n)
        p = 1 / (1 + np.exp(-(w * z + b)))
        g = np.array([((p - t) * z).sum() + w, (p - t).sum()])
        h = np.array([[(p * (1 - p) * z * z).sum() + 1, (p * (1 - p) * z).sum()], [(p * (1 - p) * z).sum(), (p * (1 - p)).sum()]])
        w, b = np.array([w, b]) - np.linalg.solve(h, g)
    got = {r["id"]: r["score"] for r in psm.propensity(frame(spark, id=np.arange(300), t=t, x=x), "t", ["x"]).collect()}
    want = 1 / (1 + np.exp(-(w * z + b)))
    assert max(abs(got[i] - want[i]) for i in range(300)) < 1e-3


@pytest.fixture(scope="module")
def dml_data(spark):
    rng = np.random.default_rng(10)
    n = 6000
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    t = 0.7 * x1 + rng.normal(size=n)
    return frame(spark, id=np.arange(n), t=t, x1=x1, x2=x2, y=(1 + 0.5 * x1) * t + 2 * x2 + x1 + rng.normal(size=n)).persist()


def test_dml_effects(spark, dml_data):
    res = dml.linear_residuals(dml.with_folds(dml_data, "id"), "y", "t", ["x1", "x2"])
    cate = dml.linear_cate(res, ["x1"])
    assert cate.coef == pytest.approx([1.0, 0.5], abs=0.1)
    est = dml.dml_estimate(res, "y", "t").first()
    assert est["ate"] == pytest.approx(1.0, abs=0.15) and est["significant"]
    out, imp = dml.forest_cate(res, ["x1", "x2"], "id", trees=40)
    weights = {r["feature"]: r["importance"] for r in imp.collect()}
    assert weights["x1"] > weights["x2"]
    assert out.agg(F.corr("cate", "x1")).first()[0] > 0.7


def test_boosted_nuisance(spark):
    df = spark.range(1500).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("x"), (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2))).cast("int").alias("t"))
    df = df.withColumn("y", F.col("x") ** 2 * 4 + 1.25 * F.col("t"))
    res = dml.boosted_residuals(dml.with_folds(df, "id"), "y", "t", ["x"], trees=8)
    assert dml.residual_effect(res).first()["ate"] == pytest.approx(1.25, abs=0.15)


def test_honest_forest_intervals(spark):
    """A step in the effect: found, with intervals that hold it nine times in ten; the same rows in other partitions give the same effects."""
    rng = np.random.default_rng(5)
    n = 6000
    x, z, t = rng.uniform(size=n), rng.uniform(size=n), rng.normal(size=n)
    effect = np.where(x > 0.5, 3.0, 1.0)
    res = frame(spark, id=np.arange(n), x=x, z=z, res_t=t, res_y=effect * t + rng.normal(size=n), truth=effect)
    out, imp = dml.forest_cate(res, ["x", "z"], "id", trees=200, depth=4)
    far = out.filter(F.abs(F.col("x") - 0.5) > 0.05)
    got = far.agg(F.avg(((F.col("cate_lower") <= F.col("truth")) & (F.col("truth") <= F.col("cate_upper"))).cast("double")).alias("held"),
                  F.sqrt(F.avg((F.col("cate") - F.col("truth")) ** 2)).alias("error"), F.avg("cate_se").alias("se")).first()
    assert got["held"] > 0.9 and got["error"] < 0.15 and got["se"] < 0.2
    assert {r["feature"]: r["importance"] for r in imp.collect()}["x"] > 0.9
    again, _ = dml.forest_cate(res.repartition(3), ["x", "z"], "id", trees=200, depth=4)
    assert again.agg(F.sum("cate")).first()[0] == pytest.approx(out.agg(F.sum("cate")).first()[0], rel=1e-3)  # up to the sketch of the bins
    odd = spark.createDataFrame([(1, None, 1.0, 1.0, 1.0)], "id long, x double, z double, res_t double, res_y double")
    assert dml.forest_cate(res.select(*odd.columns).unionByName(odd), ["x", "z"], "id", trees=4)[0].filter("cate IS NULL").count() == 1


def test_boosting_equals_plain_numpy(spark):
    """All folds and both models, several replayed rounds, against a direct version on the same bins."""
    from effectloom.operators import histtrees as ht
    rng = np.random.default_rng(9)
    n, rate, trees, depth = 900, 0.3, 7, 2
    x = rng.integers(0, 9, size=(n, 2)).astype(float)
    y = x[:, 0] * 2 + (x[:, 1] > 4) * 3 + rng.normal(size=n)
    t = (rng.uniform(size=n) < 1 / (1 + np.exp(3 - x[:, 1]))).astype(float)
    fold = np.arange(n) % 3

    def fit(v, keep, logistic):
        start = np.log(v[keep].mean() / (1 - v[keep].mean())) if logistic else v[keep].mean()
        score = np.full(n, start)
        for _ in range(trees):
            mean = 1 / (1 + np.exp(-score)) if logistic else score
            g, h = v - mean, mean * (1 - mean) if logistic else np.ones(n)

            def grow(rows, level):
                some = rows & keep
                best = None
                for f in range(2):
                    for c in sorted(set(x[:, f]))[:-1]:
                        l, r = some & (x[:, f] <= c), some & (x[:, f] > c)
                        if l.any() and r.any():
                            gain = g[l].sum() ** 2 / l.sum() + g[r].sum() ** 2 / r.sum() - g[some].sum() ** 2 / some.sum()
                            if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, f, c)
                if level == depth or best is None:
                    score[rows] += rate * (g[some].sum() / h[some].sum() if some.any() else 0)
                else:
                    grow(rows & (x[:, best[1]] <= best[2]), level + 1)
                    grow(rows & (x[:, best[1]] > best[2]), level + 1)
            grow(np.ones(n, bool), 0)
        return 1 / (1 + np.exp(-score)) if logistic else score

    df = frame(spark, id=np.arange(n), fold=fold, a=x[:, 0], b=x[:, 1], y=y, t=t)
    got = dml.boosted_residuals(df, "y", "t", ["a", "b"], trees=trees, depth=depth, rate=rate).orderBy("id").toPandas()
    for f in range(3):
        own = fold == f
        assert got["res_y"].to_numpy()[own] == pytest.approx((y - fit(y, ~own, False))[own], abs=1e-6)
        assert got["res_t"].to_numpy()[own] == pytest.approx((t - fit(t, ~own, True))[own], abs=1e-6)
    assert ht.quantile_cuts(df, ["a"], 64)[0].tolist() == sorted(set(x[:, 0]))[:-1]


def graph(spark, edges, apart):
    e = spark.createDataFrame([(*sorted(p), 0.5) for p in edges], "a string, b string, r double")
    s = spark.createDataFrame([(*sorted(p), g) for p, g in apart.items()], "a string, b string, given string")
    return {(r["src"], r["dst"]): r["kind"] for r in dag.orient(e, s).collect()}


def test_orientation_rules(spark):
    d = "directed"
    # a collider, then the rule of the open chain
    assert graph(spark, ["ac", "bc", "cd"], {"ab": "", "ad": "c", "bd": "c"}) == {("a", "c"): d, ("b", "c"): d, ("c", "d"): d}
    # the rule of the path: c -> d, d -> e, so c -> e
    assert graph(spark, ["ac", "bc", "cd", "de", "ce"], {"ab": "", "ad": "c", "bd": "c", "ae": "c", "be": "c"})[("c", "e")] == d
    # two parents of d that are not adjacent, both joined to a: a -> d
    assert graph(spark, ["ab", "ac", "ad", "bd", "cd"], {"bc": "a"}) == {("a", "b"): "undirected", ("a", "c"): "undirected", ("a", "d"): d, ("b", "d"): d, ("c", "d"): d}
    # a chain without collider stays undirected; two v-structures against each other are a conflict
    assert set(graph(spark, ["ab", "bc"], {"ac": "b"}).values()) == {"undirected"}
    assert graph(spark, ["ab", "bc", "cd"], {"ac": "", "bd": "", "ad": ""})[("b", "c")] == "conflict"


def test_lingam_weights(spark):
    """A planted graph: its coefficients come back, pairs without an edge have none."""
    rng = np.random.default_rng(13)
    n = 4000
    e = rng.uniform(-1, 1, size=(4, n))
    a = e[0]
    b = 0.8 * a + e[1]
    c = -1.5 * b + e[2]
    d = 0.6 * a + 2 * c + e[3]
    got = {(r["src"], r["dst"]): r["weight"] for r in dag.lingam_edges(frame(spark, d=d, b=b, c=c, a=a), ["d", "b", "c", "a"]).collect()}
    assert got.keys() == {("a", "b"), ("b", "c"), ("a", "d"), ("c", "d")}
    assert [got[k] for k in (("a", "b"), ("b", "c"), ("a", "d"), ("c", "d"))] == pytest.approx([0.8, -1.5, 0.6, 2.0], abs=0.08)
    m = np.cov(np.stack([a, b, c, d])) * n
    assert dag.adaptive_lasso(m, n, 3, [0, 1, 2])[1] == 0


def test_pc_chain_and_collider(spark):
    rng = np.random.default_rng(11)
    n = 4000
    a = rng.normal(size=n)
    b = a + rng.normal(size=n)
    c = b + rng.normal(size=n)
    d = rng.normal(size=n)
    e = c + d + rng.normal(size=n)
    edges, seps = dag.pc_skeleton(frame(spark, a=a, b=b, c=c, d=d, e=e), ["a", "b", "c", "d", "e"], alpha=0.001)
    assert {(r["a"], r["b"]) for r in edges.collect()} == {("a", "b"), ("b", "c"), ("c", "e"), ("d", "e")}
    kinds = {(r["src"], r["dst"]): r["kind"] for r in dag.orient(edges, seps).collect()}
    assert kinds[("c", "e")] == "directed" and kinds[("d", "e")] == "directed" and kinds[("a", "b")] == "undirected"


def test_lingam_order(spark):
    rng = np.random.default_rng(12)
    n = 5000
    a = rng.uniform(-1, 1, n)
    b = 2 * a + rng.uniform(-1, 1, n)
    c = b - a + rng.uniform(-1, 1, n)
    order = [r["variable"] for r in dag.lingam_order(frame(spark, c=c, a=a, b=b), ["c", "a", "b"]).orderBy("position").collect()]
    assert order == ["a", "b", "c"]


def test_bootstrap_stability(spark):
    rng = np.random.default_rng(13)
    a = rng.normal(size=800)
    df = frame(spark, id=np.arange(800), a=a, b=a + 0.2 * rng.normal(size=800), c=rng.normal(size=800))
    got = {(r["a"], r["b"]): r["stability"] for r in dag.bootstrap_edges(df, "id", ["a", "b", "c"], 30).collect()}
    assert got[("a", "b")] == 1.0 and got[("a", "c")] == 0.0
    assert dag.bootstrap_edges(df.repartition(5), "id", ["a", "b", "c"], 30).filter("a = 'a' and b = 'b'").first()["mean_r"] == pytest.approx(
        dag.bootstrap_edges(df, "id", ["a", "b", "c"], 30).filter("a = 'a' and b = 'b'").first()["mean_r"])


def test_run_methods_isolates_failures(spark):
    rng = np.random.default_rng(14)
    n = 600
    x = rng.normal(size=n)
    t = (x + rng.normal(size=n) > 0).astype(int)
    df = frame(spark, id=np.arange(n), year=np.arange(n) % 6, t=t, x=x, y=t + x)
    out, errors = sel.run_methods(df, sel.CausalRequest("y", "t", ["x"], key="id", time="year"),
                                  ["diff_in_diff", "double_ml", "propensity_score", "rdd", "instrumental_variable", "nope"])
    assert {r["method"] for r in out.collect()} >= {"diff_in_diff", "double_ml", "propensity_score", "rdd"}
    assert errors["nope"] == "not registered"
    m = sel.effect_matrix(out.filter("method in ('double_ml', 'propensity_score')")).first()
    assert m["double_ml_ate"] == pytest.approx(1.0, abs=0.3)


def test_ab_test_p_values(spark):
    rows = [("control", 1, 1.0)] * 40 + [("control", 0, 2.0)] * 160 + [("treatment", 1, 2.2)] * 80 + [("treatment", 0, 1.0)] * 120
    r = ch.ab_test(spark.createDataFrame(rows, "arm string, c int, m double"), "arm", "c", "m").first()
    assert r["chi2"] == pytest.approx(400 * (80 * 160 - 40 * 120) ** 2 / (200 * 200 * 120 * 280))
    assert r["decision"] == "promote" and r["p_conversion"] < 1e-4 and 0 < r["p_metric"] < 1


def test_no_variable_is_left_out(spark):
    rng = np.random.default_rng(21)
    n = 500
    xs = {f"v{i:02d}": rng.normal(size=n) for i in range(17)}
    chain = xs["v00"] + rng.normal(size=n) * 0.3
    df = frame(spark, id=np.arange(n), g=np.arange(n) % 50, y=sum(xs.values()) + rng.normal(size=n) * 0.01, **(xs | {"v16": chain}))
    cols = sorted(xs)
    edges = {(r["a"], r["b"]) for r in dag.correlation_edges(df, cols, 0.6).collect()}
    assert ("v00", "v16") in edges
    assert ("v00", "v16") in {(r["a"], r["b"]) for r in dag.pc_skeleton(df, cols)[0].collect()}
    fit = panel.panel_regression(df, "g", "y", cols[:12]).fe
    assert fit.terms == cols[:12]
    assert psm.confounders(df, "y", "v00", cols) == cols[1:]
    assert iv.instrument_candidates(df, "v00", cols[1:]).count() == 16
    assert iv.two_stage(df, "y", "v00", "v16", cols[1:9])[0].terms == ["v00", *cols[1:9]]


def test_deeper_conditioning_sets(spark):
    rng = np.random.default_rng(22)
    n = 4000
    a, b, c, d = rng.normal(size=(4, n))
    x, y = a + b + c + d + rng.normal(size=n), a + b + c + d + rng.normal(size=n)
    df = frame(spark, a=a, b=b, c=c, d=d, x=x, y=y)
    full, cut = dag.pc_skeleton(df, ["a", "b", "c", "d", "x", "y"]), dag.pc_skeleton(df, ["a", "b", "c", "d", "x", "y"], max_depth=2)
    assert ("x", "y") in {(r["a"], r["b"]) for r in cut[0].collect()} and ("x", "y") not in {(r["a"], r["b"]) for r in full[0].collect()}


def test_one_request_all_methods_by_alias(spark):
    """The first example of the README, on a cohort with a text key and a text cause."""
    rng = np.random.default_rng(23)
    n = 900
    age, burden = rng.normal(40, 10, n), rng.normal(size=n)
    income = (age / 10 + burden + rng.normal(size=n) > 4).astype(int)
    df = frame(spark, user_id=[f"u{i:05d}" for i in range(n)], gap=2.0 * income + 0.1 * age + rng.normal(size=n), income=income, age=age, burden=burden,
               city=["x", "y", "z"] * 300, year=np.arange(n) % 6)
    req = sel.CausalRequest("gap", "income", ["age", "burden", "city"], key="user_id", time="year", running="age", effects=True)
    run = sel.run_all(df, req, ["DML", "psm", "did", "2sls", "panel", "rdd", "dag", "nope"])
    assert run.errors == {"nope": "not registered"}
    got = {r["method"]: r["ate"] for r in run.estimates.collect()}
    assert len(got) == 6 and got["double_ml"] == pytest.approx(2.0, abs=0.3)
    assert {r["name"] for r in run.diagnostics.collect()} >= {"partial_f", "density_chi2", "pre_trend_slope", "smd_before:age", "smd_after:age"} and run.edges.count() > 0
    assert {r["covariate"]: r["improved"] for r in run.balance.collect()} == {"age": True, "burden": True}
    effects = run.effects.agg(F.count("effect").alias("n"), F.avg("effect").alias("mean"), F.count_distinct("key").alias("keys")).first()
    assert effects["n"] == effects["keys"] == n and effects["mean"] == pytest.approx(2.0, abs=0.3)
    assert run.importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_clustered_errors_do_not_count_nested_effects(spark):
    g = np.repeat(np.arange(8), 5)
    rng = np.random.default_rng(24)
    x, y = rng.normal(size=40), rng.normal(size=40)
    df = frame(spark, g=g, x=x, y=y)
    xd = x - np.array([x[g == k].mean() for k in g])
    yd = y - np.array([y[g == k].mean() for k in g])
    b = xd @ yd / (xd @ xd)
    meat = sum((xd[g == k] @ (yd - b * xd)[g == k]) ** 2 for k in range(8))
    assert panel.panel_regression(df, "g", "y", ["x"]).fe.se[0] == pytest.approx(np.sqrt(meat * 40 / 39) / (xd @ xd))
    assert panel.panel_regression(df, "g", "y", ["x"], count_effects=True).fe.se[0] == pytest.approx(np.sqrt(meat * 40 / 31) / (xd @ xd))


def test_wide_moments_equal_numpy(spark):
    """400 columns, large offsets, rows with a missing value left out, tasks without rows."""
    rng = np.random.default_rng(31)
    x = rng.normal(size=(300, 400)) @ rng.normal(size=(400, 400)) + 1e6
    rows = [[float(v) for v in r] for r in x] + [[None] + [0.0] * 399]
    df = spark.createDataFrame(rows, ", ".join(f"x{i} double" for i in range(400))).repartition(130)
    m = gram.moments(df, df.columns)
    assert m.n == 300 and m.mean == pytest.approx(x.mean(0), rel=1e-12)
    want = np.cov(x.T) * 299
    assert np.abs(m.cross - want).max() < 1e-9 * np.abs(want).max()
    assert gram.moments(df.limit(0), df.columns).n == 0


def test_bootstrap_computes_its_rows_once(spark):
    """The rows come through a counted step: once, not once a pass of replicates; moments equal those of the drawn weights."""
    from math import exp
    n, seen = 400, spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    plain = spark.range(n).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5 + F.col("id") % 7).cast("double").alias("b")).localCheckpoint()
    got = dag.bootstrap_edges(plain.mapInArrow(counted, plain.schema), "id", ["a", "b"], 20).first()
    assert seen.value == n
    p = plain.select("a", "b", *[F.pmod(F.xxhash64("id", F.lit(t)), F.lit(2 ** 40)).alias(f"u{t}") for t in range(1, 21)]).toPandas()
    edges, cum, q = [], 0.0, exp(-1)
    for k in range(1, 30):
        cum += q
        edges.append(cum)
        q /= k
    rs = []
    for t in range(1, 21):
        w = np.array([sum(e <= (u + 0.5) / 2 ** 40 for e in edges if e < 1) for u in p[f"u{t}"]])
        c = np.cov(p["a"], p["b"], fweights=w)
        rs.append(c[0, 1] / np.sqrt(c[0, 0] * c[1, 1]))
    assert got["mean_r"] == pytest.approx(np.mean(rs)) and got["stability"] == np.mean(np.abs(rs) > 0.3)
