import numpy as np
from pyspark.sql import functions as F

from effectloom.llm.kdtree import Cells, ShardTree, bounds, products, top_products
from effectloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def brute(rows, every=20, k=20, scale=64):
    good = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows]
    x = np.array([v for _, v in good], object)
    out = []
    for at, (i, v) in enumerate(good):
        if i % every == 0:
            score = x @ np.array(v, object)
            best = sorted((-score[b], good[b][0]) for b in range(len(good)) if b != at)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def result(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert result(QUERIES["op11_top_products"](spark, SF)) == brute(rows)


def test_many_shards_copies_and_ties(spark):
    """A third of the rows is one vector: its cell is many shards, and ties go to the smaller id."""
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(400)] + [(1000 + i, [0.5] * 6) for i in range(200)] + [(5000 + i, [0.0] * 6) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for cells, shard_rows, leaf, block, k in ((8, 40, 4, 7, 20), (1, 1000, 16, 1000, 3), (64, 25, 1, 50, 700)):
        assert result(top_products(df, k=k, cells=cells, shard_rows=shard_rows, leaf=leaf, query_block=block)) == brute(rows, k=k)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 3, size=(200, 5)) for c in (-90, 0, 70)]).astype(np.int64)
    q = rng.integers(-50, 50, size=(40, 5))
    tree = ShardTree(x, 16)
    for node in range(len(tree.left)):
        inside = products(q, tree.x[tree.begin[node]:tree.end[node]])
        assert (inside.max(1) <= bounds(q, tree.low[[node]], tree.high[[node]])[:, 0]).all()
    ids = np.arange(len(x))
    want = np.argsort(-products(q, x), axis=1, kind="stable")[:, :3]
    got = tree.search(q, np.full(40, np.iinfo(np.int64).min), 3, np.full(40, -1), ids)
    assert (np.array(got) == want).all()
    third = np.take_along_axis(products(q, x), want, 1)[:, 2]
    assert all(set(w) <= set(g) for w, g in zip(want.tolist(), map(list, tree.search(q, third, 3, np.full(40, -1), ids))))
    assert all(not len(p) for p in tree.search(q, products(q, x).max(1) + 1, 3, np.full(40, -1), ids))
    cells = Cells(x, 8)
    assert len(np.unique(cells.of(x))) == cells.count == 8


def test_large_numbers_stay_exact():
    q, x = np.array([[2 ** 25 + 1, 2 ** 25 - 1]]), np.array([[2 ** 25 + 3, 2 ** 25 + 1], [2 ** 25 + 3, 2 ** 25 + 2]])
    assert products(q, x).tolist() == [[int(sum(int(a) * int(b) for a, b in zip(q[0], r))) for r in x]]


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.5]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, []), (8, [-3.0, 4.01]), (9, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("x")).withColumn("id", F.lit(1)).withColumn("cell", F.lit(2))
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 2 and all(c is not None and np.isfinite(c) and abs(c) < 1e6 for c in v)]
    assert result(top_products(df)) == brute(good)
    assert top_products(df.limit(0)).collect() == [] and top_products(df.filter("vec_id IN (0)")).collect() == []
