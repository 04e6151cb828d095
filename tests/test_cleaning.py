"""Readers, typing, imputation and the full cleaning pass on dirty input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectloom.operators import clean as cl
from effectloom.operators import typing as ty
from effectloom.sources import assemble as asm
from effectloom.sources import readers, sinks


@pytest.mark.parametrize("enc,sep", [("utf-8", ","), ("gbk", ";"), ("utf-8", "\t"), ("latin-1", "|")])
def test_csv_sniffing(spark, tmp_path, enc, sep):
    text = "caf\xe9" if enc == "latin-1" else "北京"
    lines = [sep.join(["id", "city", "x"])] + [sep.join([str(i), text + " " if enc == "latin-1" else text, "1.5"]) for i in range(20)]
    path = tmp_path / "t.csv"
    path.write_bytes("\n".join(lines).encode(enc))
    found, delim = readers.sniff_csv(spark, str(path))
    assert delim == sep
    df = readers.read_csv(spark, str(path))
    assert df.count() == 20 and df.columns == ["id", "city", "x"]
    if enc != "latin-1":
        assert found == enc and df.first()["city"] == text


def test_reader_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, str(tmp_path / "none.csv"))
    (tmp_path / "a.xyz").write_text("1")
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "a.xyz"))
    with pytest.raises(FileNotFoundError):
        readers.resolve_paths(spark, [str(tmp_path)])


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 1}\n{"x": 2}\n{"x": 3}\n')
    assert readers.read_table(spark, str(tmp_path / "a.json")).count() == 2
    assert readers.read_table(spark, str(tmp_path / "b.json")).count() == 3
    assert len(readers.resolve_paths(spark, [str(tmp_path / "*.json"), str(tmp_path)])) == 4


def test_merge_suffixes(spark):
    a = spark.createDataFrame([(1, "x")], "PolicyID long, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z")], "PolicyID long, v string")
    assert asm.merge_strategy({"a": a, "b": b})[0] == "concat"
    m = asm.assemble({"a": a, "b": b}, "merge")
    assert sorted(m.columns) == ["PolicyID", "v", "v_1"] and m.count() == 2


def test_read_through_cache_expires(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def build():
        calls.append(1)
        return spark.createDataFrame([(len(calls),)], "v int")
    assert sinks.read_through(spark, path, build, "2024-01-01").first()["v"] == 1
    assert sinks.read_through(spark, path, build, "2024-03-31").first()["v"] == 1
    assert sinks.read_through(spark, path, build, "2024-06-01").first()["v"] == 2
    assert len(calls) == 2


def test_types_and_modes(spark):
    df = spark.createDataFrame([(i, str(i) if i % 7 else None, "2024-01-%02d" % (i % 28 + 1), ["b", "a"][i % 2], i % 2) for i in range(100)],
                               "id long, num string, day string, cat string, bit int")
    df = df.withColumn("cat3", F.concat("cat", (F.col("id") % 3).cast("string")))
    kinds = ty.semantic_types(ty.column_meta(df))
    assert kinds == {"id": "continuous", "num": "continuous", "day": "datetime", "cat": "binary", "bit": "binary", "cat3": "categorical"}
    assert cl.column_modes(df, ["cat"]) == {"cat": "a"}  # tie goes to the smaller value


def test_numeric_mode_tie_is_numeric(spark):
    df = spark.createDataFrame([(10,), (9,), (10,), (9,), (None,)], "x int")
    assert cl.column_modes(df, ["x"]) == {"x": "9"}
    assert sorted(r["x"] for r in cl.impute_mode(df, ["x"]).collect()) == [9, 9, 9, 10, 10]


def test_clean_pass(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, 200).tolist()
    v[0], v[1] = 500.0, None
    rows = [(i, x, None if i < 150 else 1.0, "k%d" % (i % 4) if i % 9 else None) for i, x in enumerate(v)] + [(5, v[5], None, "k1")]
    df = spark.createDataFrame(rows, "id long, v double, sparse double, cat string")
    res = cl.clean(df)
    rep = {r["column"]: r for r in res.report.collect()}
    assert res.data.count() == 200 and "sparse" not in res.data.columns
    assert rep["sparse"]["dropped"] and rep["v"]["n_imputed"] == 1 and rep["v"]["imputed_by"] == "median"
    assert rep["cat"]["n_imputed"] == 23 and rep["v"]["n_outliers"] >= 1
    filled = np.array([x if x is not None else np.median([y for y in v if y is not None]) for x in v])
    q1, q3 = np.quantile(filled, [0.25, 0.75])
    assert res.data.agg(F.max("v")).first()[0] == pytest.approx(q3 + 1.5 * (q3 - q1))
    assert res.data.filter("cat is null or v is null").count() == 0


def test_iterative_imputation_recovers_linear_relation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    z = rng.normal(size=400)
    y = 2 * x - z + 1
    rows = [(i, float(a), None if i % 5 == 0 else float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, z))]
    out = cl.iterative_impute(spark.createDataFrame(rows, "id long, x double, y double, z double"), ["x", "y", "z"])
    got = {r["id"]: r["y"] for r in out.collect()}
    assert max(abs(got[i] - y[i]) for i in range(0, 400, 5)) < 1e-3


def _plain_ridge(x, y):
    """Bayesian ridge on rows, precisions by repeated evidence updates (own derivation by direct inverses)."""
    n, k = x.shape
    xc, yc = x - x.mean(0), y - y.mean()
    noise, slopes, last = 1 / (yc.var() + np.finfo(float).eps), 1.0, None
    w = np.linalg.solve(xc.T @ xc + slopes / noise * np.eye(k), xc.T @ yc)
    for turn in range(300):
        cov = np.linalg.inv(slopes * np.eye(k) + noise * xc.T @ xc)
        free = k - slopes * np.trace(cov)
        slopes = (free + 2e-6) / (w @ w + 2e-6)
        noise = (n - free + 2e-6) / (((yc - xc @ w) ** 2).sum() + 2e-6)
        last, w = w, np.linalg.solve(xc.T @ xc + slopes / noise * np.eye(k), xc.T @ yc)
        if turn and np.abs(last - w).sum() < 1e-3:
            break
    return w, y.mean() - x.mean(0) @ w


def _plain_chain(data, rounds):
    data = data.copy()
    gone = np.isnan(data)
    order = [j for j in np.argsort(gone.sum(0), kind="stable") if gone[:, j].any()]
    data = np.where(gone, np.nanmean(data, 0), data)
    last = {}
    for _ in range(rounds):
        change = 0.0
        for j in order:
            rest = [o for o in range(data.shape[1]) if o != j]
            w, b = _plain_ridge(data[~gone[:, j]][:, rest], data[~gone[:, j], j])
            data[gone[:, j], j] = data[gone[:, j]][:, rest] @ w + b
            now = np.array([*w, b])
            change = max(change, np.max(np.abs(now - last[j]) / (np.abs(now) + 1e-12)) if j in last else 1.0)
            last[j] = now
        if change < 1e-3:
            break
    return data


@pytest.mark.parametrize("max_patterns", [1024, 2])  # by maps per pattern of holes, and by aggregates over the rows
@pytest.mark.parametrize("rounds", [1, 4])
def test_chained_imputation_equals_plain_rows(spark, max_patterns, rounds):
    rng = np.random.default_rng(8)
    a = rng.normal(size=300)
    data = np.stack([a, a * 2 + rng.normal(size=300), rng.normal(5, 1, 300) - a, rng.normal(size=300)], 1)
    data[rng.uniform(size=data.shape) < [0.2, 0.1, 0.3, 0.0]] = np.nan
    rows = [(i, *[None if np.isnan(v) and i % 2 else float(v) for v in r], None) for i, r in enumerate(data)]  # nulls and NaN
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, empty double")
    out = cl.iterative_impute(df, ["a", "b", "c", "d", "empty"], rounds, max_patterns=max_patterns)
    assert out.columns == df.columns and out.filter("empty is not null").count() == 0
    got = np.array([[r[c] for c in "abcd"] for r in out.orderBy("id").collect()])
    assert got == pytest.approx(_plain_chain(data, rounds), abs=1e-7)


def test_chained_imputation_odd_tables(spark):
    schema = "id long, a double, b double"
    assert cl.iterative_impute(spark.createDataFrame([], schema), ["a", "b"]).count() == 0
    one = cl.iterative_impute(spark.createDataFrame([(1, None, 2.0), (2, 3.0, None)], schema), ["a", "b"]).collect()
    assert {r["id"]: (r["a"], r["b"]) for r in one} == {1: (3.0, 2.0), 2: (3.0, 2.0)}
    alone = cl.iterative_impute(spark.createDataFrame([(1, None, None), (2, 3.0, None), (3, 5.0, None)], schema), ["a"]).collect()
    assert {r["id"]: r["a"] for r in alone} == {1: 4.0, 2: 3.0, 3: 5.0}


def test_zscore_bounds(spark):
    v = [float(i) for i in range(30)] + [300.0]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    clip, flag = cl.zscore_bounds(df, ["v"], 2.0)
    assert clip["v"][1] == pytest.approx(np.mean(v) + 2 * np.std(v, ddof=1))
    assert flag["v"][1] == pytest.approx(np.mean(v) + 2 * np.std(v))
