import numpy as np
from pyspark.sql import functions as F

from effectloom.llm.neighbours import learn, nearest, search
from effectloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def brute(rows, every=100, k=10):
    good = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for at, (i, v) in enumerate(good):
        if i % every == 0:
            scored = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for b, (j, w) in enumerate(good) if b != at)
            out.setdefault(i, []).append(scored[:k])
    return out


def recall(got, want):
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    hit = total = 0
    assert set(mine) == set(want)
    for q, lists in want.items():
        best = lists[0]
        have = [mine[q][k] for k in sorted(mine[q])]
        assert len(have) == len(best) and have == sorted(have)
        hit += len({j for _, j in have} & {j for _, j in best})
        total += len(best)
    return hit / total


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op9_nearest"](spark, SF).collect()
    assert recall(got, brute(rows)) >= 0.95
    vec = {i: np.array(v, float) for i, v in rows}
    assert all(abs(r.score - np.linalg.norm(vec[r.query_id] - vec[r.vec_id])) < 1e-12 for r in got)


def test_short_queries_copies_and_blocks(spark):
    rng = np.random.default_rng(0)
    far = [(100 * i, (rng.normal(size=8) * 50).tolist()) for i in range(1, 4)]
    near = [(1000 + i, (np.ones(8) + rng.normal(size=8) * 0.01).tolist()) for i in range(700)]
    same = [(2001 + i, [1.0] * 8) for i in range(300)]
    rows = far + near + same
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = nearest(df, block=300, query_block=2, bits=64).collect()
    assert recall(got, brute(rows)) >= 0.99


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [1.0, 2.5]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, []), (8, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("x")).withColumn("id", F.lit(1))
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in nearest(df).collect())
    a, b = round(8 ** 0.5, 6), round((4 + 2.25) ** 0.5, 6)
    assert got == sorted([(0, 1, 100, 0.0), (0, 2, 100, 0.5), (0, 3, 8, a), (100, 1, 0, 0.0), (100, 2, 100, 0.5), (100, 3, 8, a), (100, 1, 0, 0.5), (100, 2, 100, 0.5), (100, 3, 8, b)])
    assert nearest(df.limit(0)).collect() == [] and nearest(df.filter("vec_id IN (0)")).collect() == []


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 16))
    codes = learn(x, 64, 10, 0.9)
    c = codes(x)
    for radius in (0, 7, 15, 20):
        got = search(np.array([-1]), np.array([0]), x[:1], np.arange(500), np.arange(500), x, codes, radius, 1000)
        assert set(got["vec_id"]) == set(np.nonzero(np.bitwise_count(c ^ c[0]).sum(1) <= radius)[0].tolist())
