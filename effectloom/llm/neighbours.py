"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

A bounded sample (a parameter) gives the principal axes, rotations that bring the
projected vectors close to the corners of the cube (iterative quantisation), and
the Hamming radius that holds the wanted share of the sample's own nearest
neighbours; neighbours in all rows are nearer than in the sample, so the radius
errs to the safe side.  Every row is indexed: its code is cut into 16-bit
substrings, and each substring has a table of its values.  If two codes of m
substrings differ in at most r bits, some substring differs in at most r // m,
so probing the values within that distance in every table finds every code
within r.  Those are checked on the whole code and reranked by their exact
distance on the original vectors.

Queries and rows are dealt into blocks; a task holds one block of each, and
partial results (k per query and block) are merged by rank.  A query with fewer
than k rows within the radius is searched again without it, so none comes back
short.  Copies of one vector share their distance and are told apart by id.

Vectors that are null, zero, or hold null or non-finite numbers, rows without
id, and vectors of another length than the commonest take no part.  Repeated
ids keep their rows: a query skips only its own row.  An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

PIECE = 16
OUT = "query_row long, query_id long, vec_id long, score double"


@dataclass
class Codes:
    """mean, axes (dims x kept) and rotations (kept x kept) that turn vectors into codes of `bits` bits."""
    mean: np.ndarray
    axes: np.ndarray
    rotations: list[np.ndarray]
    bits: int
    radius: int = 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        flat = (x - self.mean) @ self.axes
        on = np.concatenate([flat @ r for r in self.rotations], 1)[:, :self.bits] > 0
        return np.packbits(on, axis=1).view(np.uint16)


def learn(sample: np.ndarray, bits: int, k: int, share: float, rounds: int = 30, seed: int = 7) -> Codes:
    """Codes fitted to the sample; without enough rows to judge, the radius is all bits."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    flat = centred @ axes
    kept = flat.shape[1]
    rotations = []
    for _ in range(ceil(bits / kept)):
        r = np.linalg.qr(rng.normal(size=(kept, kept)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(flat @ r > 0, 1.0, -1.0).T @ flat)
            r = (u @ vt).T
        rotations.append(r)
    codes = Codes(mean, axes, rotations, bits, bits)
    if len(sample) > 20 * k:
        some = rng.permutation(len(sample))[:300]
        c, spread = codes(sample), []
        for i in some.tolist():
            d = ((sample - sample[i]) ** 2).sum(1)
            d[i] = np.inf
            near = np.argpartition(d, k)[:k]
            spread.append(np.bitwise_count(c[near] ^ c[i]).sum(1))
        codes.radius = int(np.quantile(np.concatenate(spread), share))
    return codes


def search(qrow, qid, q, row, vid, x, codes: Codes, radius: int, k: int) -> pd.DataFrame:
    """The k nearest of a block's rows for each query, among codes within the radius."""
    qc, xc = codes(q), codes(x)
    pieces = xc.shape[1]
    reach = radius // pieces
    tables = []
    for j in range(pieces):
        order = np.argsort(xc[:, j], kind="stable")
        values, first = np.unique(xc[order, j], return_index=True)
        tables.append((order, values, np.append(first, len(order))))
    out = []
    for i in range(len(q)):
        hit = np.zeros(len(x), bool)
        for j, (order, values, first) in enumerate(tables):
            near = np.bitwise_count(values ^ qc[i, j]) <= reach
            hit[order[np.repeat(near, np.diff(first))]] = True
        hit &= row != qrow[i]
        at = np.nonzero(hit)[0]
        at = at[np.bitwise_count(xc[at] ^ qc[i]).sum(1) <= radius]
        score = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
        best = np.lexsort((vid[at], score))[:k]
        out.append(pd.DataFrame({"query_row": qrow[i], "query_id": qid[i], "vec_id": vid[at[best]], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, id, vec) of the vectors that take part, vec in doubles."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    base = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter(
        F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(finite & F.exists("vec", lambda v: v != 0))
    return staged(base.select(F.monotonically_increasing_id().alias("row"), "id", "vec"), "vectors")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, bits: int = 256, share: float = 0.98, sample_rows: int = 10_000,
            block: int = 8192, query_block: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of each query.

    Queries are the rows whose id is divisible by `every`.  share: the part of
    the sample's true neighbours that the radius must hold.
    """
    spark = vectors.sparkSession
    base = usable(vectors, id_col, vec_col)
    sizes = base.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base, n = base.filter(F.size("vec") == sizes["dims"]), sizes["count"]
    part = min(1.0, sample_rows / n)
    sample = base.filter(F.pmod(F.xxhash64("row", "id"), F.lit(1_000_000)) < int(part * 1_000_000)).orderBy("row").select("vec").toPandas()["vec"]
    codes = learn(np.stack(sample.to_list()) if len(sample) else np.zeros((1, sizes["dims"])), bits, k, share)
    shared = spark.sparkContext.broadcast(codes)  # bounded by the length of a vector
    queries = base.filter(F.col("id") % every == 0)
    n_queries = queries.count()
    blocks, query_blocks = ceil(n / block), max(1, ceil(n_queries / query_block))

    def deal(df: DataFrame, own: int, others: int, mine: str, other: str) -> DataFrame:
        return df.select("row", "id", "vec", F.pmod(F.xxhash64("row"), F.lit(own)).cast("int").alias(mine),
                         F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def found(some: DataFrame, radius: int) -> DataFrame:
        def one(key, qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
            if not len(qs) or not len(xs):
                return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})
            return search(qs["row"].to_numpy(), qs["id"].to_numpy(), np.stack(qs["vec"].to_list()), xs["row"].to_numpy(), xs["id"].to_numpy(),
                          np.stack(xs["vec"].to_list()), shared.value, radius, k)

        left = deal(some, query_blocks, blocks, "qb", "xb").groupBy("qb", "xb")
        right = deal(base, blocks, query_blocks, "xb", "qb").groupBy("qb", "xb")
        rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
        return staged(left.cogroup(right).applyInPandas(one, OUT).withColumn("rank", rank).filter(F.col("rank") <= k), "nearest")

    first = found(queries, codes.radius)
    full = first.groupBy("query_row").count().filter(F.col("count") >= min(k, n - 1)).select(F.col("query_row").alias("row"))
    short = queries.join(full, "row", "left_anti")
    out = first
    if codes.radius < bits and not short.isEmpty():
        again = staged(short, "short-queries")
        out = first.join(again.select(F.col("row").alias("query_row")), "query_row", "left_anti").unionByName(found(again, bits))
    return out.select("query_id", "rank", "vec_id", "score")
