"""Exact top-k inner products by KD-trees, one a shard.

A bounded sample (`sample_rows`) gives the upper part of the tree: median splits
along the widest axis, at most `cells` cells.  Every row is put into its cell,
and a cell's rows are dealt by hash into shards of about `shard_rows`, so a
cell full of copies is many shards.  A shard builds its own tree by median splits
down to `leaf` rows; every node has the tight box of its rows.

The largest inner product of a query q with any point of a box is the sum over
axes of max(q * low, q * high): a bound that no row below exceeds.  A query first
searches one shard of its own cell, so its k-th score there bounds its final k-th
score from below.  That score goes along to the other shards: those whose cell
box cannot reach it are not visited, and a visited shard starts with it.  Inside a
shard each query keeps its open nodes and takes the one with the highest bound
first; it ends when that bound is below its k-th score (equal scores may still
win by id).  Many queries advance at once, and rows are scored a leaf at a time.

Components are floored multiples and scores exact integers.  Vectors that are
null, hold null, non-finite or (after scaling) components of 2^26 or more, rows
without id, and vectors of another length than the commonest take no part; zero
vectors do.  Repeated ids keep their rows: a query skips only its own row.  An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

OUT = "query_row long, query_id long, row long, vec_id long, score long"
FOUND = OUT.replace(" long", "").split(", ")
RESULT = "query_id long, rank int, vec_id long, score long"
HUGE = 1 << 26
LOW = np.iinfo(np.int64).min


def usable(vectors: DataFrame, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """(row, id, vec) of the vectors that take part, vec floored multiples."""
    raw = F.col(vec_col).cast("array<double>")
    plain = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < float(HUGE)))
    base = vectors.select(F.col(id_col).cast("long").alias("id"), raw.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(plain)
    return staged(base.select(F.monotonically_increasing_id().alias("row"), "id", F.transform("vec", lambda v: F.floor(v * scale)).alias("vec")), "vectors")


def widest_split(x: np.ndarray) -> tuple[int, np.ndarray] | None:
    """Axis of the widest spread and which rows are left of its median; none if all rows are equal."""
    low, high = x.min(0), x.max(0)
    axis = int((high - low).argmax()) if x.shape[1] else 0
    if not x.shape[1] or high[axis] == low[axis]:
        return None
    at = x[:, axis]
    middle = np.partition(at, len(at) // 2)[len(at) // 2]
    left = at < middle
    return axis, left if left.any() else at <= middle


class Cells:
    """Upper part of the tree: axis and cut of each inner node, children after their parents."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.count = 0
        self.root = self.grow(sample, max(1, cells))

    def grow(self, x: np.ndarray, room: int) -> int:
        """Place of the inner node, or -1 - cell."""
        split = widest_split(x) if room > 1 and len(x) > 1 else None
        if split is None:
            self.count += 1
            return -self.count
        axis, left = split
        cut = int(x[left, axis].max())
        at = len(self.nodes)
        self.nodes.append((axis, cut, 0, 0))
        self.nodes[at] = (axis, cut, self.grow(x[left], room // 2), self.grow(x[~left], room - room // 2))
        return at

    def of(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root)
        for node, (axis, cut, low, high) in enumerate(self.nodes):
            here = np.nonzero(at == node)[0]
            at[here] = np.where(x[here, axis] <= cut, low, high)
        return -1 - at


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact q @ x.T: in doubles where no sum can pass 2^53, else in integers."""
    top = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(float) @ x.astype(float).T).astype(np.int64) if top < 1 << 53 else q @ x.T


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest inner product of each query with any point of each box."""
    return products(np.maximum(q, 0), high) + products(np.minimum(q, 0), low)


class ShardTree:
    """KD-tree of a shard's rows: boxes, children and row ranges of the nodes, rows in tree order."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        self.left, self.right, self.begin, self.end, low, high = [], [], [], [], [], []
        todo = [(0, len(x), None)]
        while todo:
            a, b, parent = todo.pop()
            some = x[self.order[a:b]]
            node = len(self.left)
            if parent is not None:
                (self.left if self.left[parent] < 0 else self.right)[parent] = node
            low.append(some.min(0))
            high.append(some.max(0))
            for column, value in ((self.left, -1), (self.right, -1), (self.begin, a), (self.end, b)):
                column.append(value)
            split = widest_split(some) if b - a > leaf else None
            if split is not None:
                own = self.order[a:b]
                self.order[a:b] = np.concatenate([own[split[1]], own[~split[1]]])
                middle = a + int(split[1].sum())
                todo += [(middle, b, node), (a, middle, node)]
        self.low, self.high = np.array(low), np.array(high)
        self.x = x[self.order]

    def search(self, q: np.ndarray, floor: np.ndarray, k: int, skip: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        """Places of up to k best rows of each query, best first, none below its floor.

        skip: the place of the query's own row, or -1.  ids break ties.
        """
        n, ids = len(q), ids[self.order]
        self_at = np.full(len(self.order) + 1, -1)
        self_at[self.order] = np.arange(len(self.order))
        own = self_at[skip]
        value = np.full((n, k), LOW)
        place = np.full((n, k), -1)
        frontier = np.full((n, len(self.left)), LOW)
        frontier[:, 0] = bounds(q, self.low[:1], self.high[:1])[:, 0]
        live = np.arange(n)
        while len(live):
            node = frontier[live].argmax(1)
            best = frontier[live, node]
            go = (best > LOW) & (best >= np.maximum(value[live, -1], floor[live]))
            live, node = live[go], node[go]
            frontier[live, node] = LOW
            for at in np.unique(node).tolist():
                some = live[node == at]
                if self.left[at] >= 0:
                    two = [self.left[at], self.right[at]]
                    frontier[np.ix_(some, two)] = bounds(q[some], self.low[two], self.high[two])
                    continue
                a, b = self.begin[at], self.end[at]
                score = products(q[some], self.x[a:b])
                score[own[some, None] == np.arange(a, b)] = LOW
                v = np.concatenate([value[some], score], 1)
                p = np.concatenate([place[some], np.broadcast_to(np.arange(a, b), score.shape)], 1)
                best_first = np.lexsort((np.where(p < 0, np.iinfo(np.int64).max, ids[p]), -v.astype(float) if abs(v[v > LOW]).max(initial=0) < 1 << 53 else ~v), axis=1)[:, :k]
                value[some], place[some] = np.take_along_axis(v, best_first, 1), np.take_along_axis(p, best_first, 1)
        return [self.order[p[(v > LOW) & (v >= f)]] for p, v, f in zip(place, value, floor)]


def boxes(base: DataFrame, cells: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Tight boxes of the cells; (cells, dims) numbers reach the driver."""
    found = base.select("cell", F.posexplode("vec").alias("axis", "v")).groupBy("cell", "axis").agg(F.min("v").alias("low"), F.max("v").alias("high")).toPandas()
    low, high = np.zeros((cells, dims), np.int64), np.full((cells, dims), -1)
    low[found["cell"], found["axis"]], high[found["cell"], found["axis"]] = found["low"], found["high"]
    return low, high


def merged(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, cells: int = 64, shard_rows: int = 16384, leaf: int = 256,
                 query_block: int = 1024, sample_rows: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest inner product for every row whose id is divisible by `every`; ties to the smaller id."""
    spark: SparkSession = vectors.sparkSession
    base = usable(vectors, scale, id_col, vec_col)
    sizes = base.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None:
        return spark.createDataFrame([], RESULT)
    dims, n = sizes["dims"], sizes["count"]
    base = base.filter(F.size("vec") == dims)
    # the rows of smallest hash: bounded at any size of the table
    sample = base.orderBy(F.xxhash64("row", "id"), "row").limit(sample_rows).select("vec").toPandas()["vec"]
    tree = Cells(np.stack(sample.to_list()).reshape(len(sample), dims), min(cells, ceil(n / shard_rows)))
    shared = spark.sparkContext.broadcast(tree)  # at most `cells` nodes

    @F.pandas_udf("int")
    def cell_of(vec: pd.Series) -> pd.Series:
        return pd.Series(shared.value.of(np.stack(vec.to_list()).reshape(len(vec), dims)))

    placed = staged(base.withColumn("cell", cell_of("vec")), "cells")
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most `cells` rows
    dealt = [ceil(counts.get(c, 0) / shard_rows) for c in range(tree.count)]
    shards = F.element_at(F.array(*[F.lit(max(1, d)) for d in dealt]), F.col("cell") + 1)
    held = staged(placed.withColumn("shard", F.pmod(F.xxhash64("row"), shards).cast("int")), "shards")
    box = spark.sparkContext.broadcast(boxes(held, tree.count, dims))
    queries = held.filter(F.col("id") % every == 0)
    blocks = max(1, ceil(queries.count() / query_block))
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int").alias("block")

    def searched(asked: DataFrame) -> DataFrame:
        """asked: (row, id, vec, floor, cell, shard, block)."""
        def one(key, qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
            if not len(qs) or not len(xs):
                return pd.DataFrame({c: [] for c in FOUND})
            x, q = (np.stack(vec.to_list()).reshape(len(vec), dims).astype(np.int64) for vec in (xs["at_vec"], qs["vec"]))
            ids, number = xs["at_id"].to_numpy(), xs["at_row"].to_numpy()
            at = {r: i for i, r in enumerate(number.tolist())}
            skip = np.array([at.get(r, -1) for r in qs["row"].tolist()])
            tree, out = ShardTree(x, leaf), []
            step = max(1, (1 << 22) // len(tree.left))
            for i in range(0, len(q), step):
                out += tree.search(q[i:i + step], qs["floor"].to_numpy()[i:i + step], k, skip[i:i + step], ids)
            of, best = np.repeat(np.arange(len(q)), [len(p) for p in out]), np.concatenate(out).astype(int)
            return pd.DataFrame({"query_row": qs["row"].to_numpy()[of], "query_id": qs["id"].to_numpy()[of], "row": number[best], "vec_id": ids[best], "score": (q[of] * x[best]).sum(1)})

        # every block of queries meets a shard's rows once; a shard that no query of a block asks for is not sent
        wanted = asked.select("cell", "shard", "block").distinct()
        rows = held.select("cell", "shard", "row", "id", "vec").join(wanted, ["cell", "shard"])
        rows = rows.select(*[F.col(c).alias(f"at_{c}") for c in rows.columns])
        pairs = asked.groupBy("cell", "shard", "block").cogroup(rows.groupBy("at_cell", "at_shard", "at_block"))
        return staged(merged(pairs.applyInPandas(one, OUT), k), "found")

    first = searched(queries.select("row", "id", "vec", F.lit(LOW).cast("long").alias("floor"), "cell", "shard", part))
    floors = first.filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("floor"))
    known = queries.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(LOW).cast("long")))

    @F.pandas_udf("array<int>")
    def reachable(vec: pd.Series, floor: pd.Series) -> pd.Series:
        low, high = box.value
        reach = bounds(np.stack(vec.to_list()).reshape(len(vec), dims).astype(np.int64), low, high) >= floor.to_numpy()[:, None]
        return pd.Series([np.nonzero(r)[0].tolist() for r in reach])

    others = known.withColumnsRenamed({"cell": "own_cell", "shard": "own_shard"}).withColumn("cell", F.explode(reachable("vec", "floor"))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), shards - 1))).filter("cell != own_cell OR shard != own_shard")
    rest = searched(others.select("row", "id", "vec", "floor", "cell", "shard", part))
    return merged(first.drop("rank").unionByName(rest.drop("rank")), k).select("query_id", "rank", "vec_id", "score")


TOP_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vec FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS other, list_inner_product(q.vec, c.vec)::BIGINT AS score FROM v q JOIN v c ON q.r != c.r WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""
