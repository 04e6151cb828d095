import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from effectloom.llm.components import stars
from effectloom.llm.queries import QUERIES
from effectloom.llm.simhash import grid, links, near_duplicates, spanning_links, unary_counts

SF = "/root/testdata/sf0.01"


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    """{position: positions it reaches} by comparing all pairs."""
    fp = np.array(prints, np.uint64)
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in np.nonzero(np.bitwise_count(fp[i + 1:] ^ fp[i]) <= radius)[0].tolist():
            a, b = find(i), find(i + 1 + j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fp))]


def as_long(x):
    return x - (1 << 64) if x >> 63 else x


def check(got, docs):
    prints = [fingerprint(t) for _, t in docs]
    root = components(prints)
    least = {}
    for (d, _), r in zip(docs, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = [(d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(docs, prints, root)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(QUERIES["op4_simhash"](spark, SF).collect(), docs)


def test_odd_rows(spark):
    docs = [(5, None), (3, ""), (9, "one two"), (8, "One TWO"), (7, "É é"), (7, "É é"), (None, "one two"), (4, "a b c d e " * 9000), (2, "\x1ca\x0bb\tc  d"), (1, "x" * 70000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("id", F.lit(0))
    check(near_duplicates(df).collect(), docs)
    assert near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [3, 2048])
def test_links_connect_what_all_pairs_connect(spark, block):
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    fp = set(rng.integers(0, 1 << 62, 300, dtype=np.uint64).tolist())
    for s in seeds.tolist():
        for _ in range(30):
            fp.add(int(s) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 9))))
    fp = sorted(x & (1 << 64) - 1 for x in fp)
    df = spark.createDataFrame([(as_long(x),) for x in fp], "fp long")
    tree = {r.node: r.root for r in stars(links(df, 4, block)).collect()}
    mine = [tree.get(k, k) for k in map(as_long, fp)]
    want = components(fp)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_embedding_is_a_lower_bound_and_grids_cover_it():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = a.copy()
    for k in range(2000):
        for bit in rng.integers(0, 64, k % 7):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    exact, low = np.bitwise_count(a ^ b), np.bitwise_count(unary_counts(a) ^ unary_counts(b))
    assert (low <= exact).all()
    for n in (10, 10**5, 10**8, 10**11):
        masks = np.array(grid(n, 4), np.uint64)
        share = ((unary_counts(a)[:, None] ^ unary_counts(b)[:, None]) & masks[None]) == 0
        assert share.any(1)[low <= 4].all()
    assert spanning_links(np.zeros(3, np.int64), np.array([0, 1, 3], np.uint64), 1) == [(0, 1), (1, 2)]


def test_chain_and_star_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 2000 + i) for i in range(300)] + [(5000, 5000)]
    tree = {r.node: r.root for r in stars(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert tree == {i: 0 for i in range(1, 201)} | {2000 + i: 1000 for i in range(300)}
