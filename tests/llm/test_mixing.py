import re
from collections import defaultdict

from pyspark.sql import functions as F

from effectloom.llm.mixing import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, share, cap):
    """Share by weight, cap, reshare the excess among those below their cap, until none is above."""
    left, open_, target = share * sum(sizes.values()), dict(weights), {}
    while open_:
        total = sum(open_.values())
        over = [s for s in open_ if left * open_[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * w / total for s, w in open_.items()}
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ = {s: w for s, w in open_.items() if s not in over}
    return target


def test_against_brute_force(spark):
    docs = [(i, f"s{i % 7}" if i % 11 else None, None if i % 13 == 0 else "w " * (i * i % 97)) for i in range(400)] + [(7, "s0", "again b"), (7, "s0", "again b"), (None, "é", "x\ty\nz")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = mix(df.withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))).collect()
    sizes = defaultdict(int)
    for _, s, t in docs:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted([s for s in sizes if s is not None]) + [None]
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5, 2.0)
    assert len(got) == len(docs)
    source = {d: s for d, s, _ in docs}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(7)).collect()))


def test_edges(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in mix(df).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mix(df.limit(0)).collect() == []
