"""Causal-graph screening on a distributed correlation matrix."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import normal_quantile
from ..sources.workspace import written
from .gram import moments
from .profiling import correlations


def correlation_edges(df: DataFrame, cols: list[str], cutoff: float = 0.3) -> DataFrame:
    """Undirected screen: pairs with |r| above the cutoff."""
    return correlations(df, cols).filter(F.abs("r") > cutoff)


def pc_skeleton(df: DataFrame, cols: list[str], alpha: float = 0.05, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, separations): Fisher-z tests given ever larger sets of neighbours.

    Only the correlation pass touches rows; the tests read the k x k matrix.
    Each depth tests against the adjacency of the depth before (order-independent
    variant) and the search ends where no node has enough neighbours left, or at
    ``max_depth`` if one is given.
    """
    work = df.select(*cols).na.drop()
    n, crit = work.count(), normal_quantile(1 - alpha / 2)
    r = np.eye(len(cols))
    at = {c: i for i, c in enumerate(cols)}
    for row in correlations(work, cols).collect():
        if row["r"] is not None:
            r[at[row["a"]], at[row["b"]]] = r[at[row["b"]], at[row["a"]]] = row["r"]

    def dependent(i: int, j: int, given: tuple[int, ...]) -> bool:
        sub = np.linalg.pinv(r[np.ix_((i, j, *given), (i, j, *given))])
        part = min(max(-sub[0, 1] / math.sqrt(sub[0, 0] * sub[1, 1]), -0.9999999999), 0.9999999999)
        return abs(math.atanh(part)) * math.sqrt(max(n - len(given) - 3, 0)) > crit

    edges = {(at[a], at[b]) for a, b in combinations(sorted(cols), 2)}
    cut: dict[tuple[int, int], str] = {}
    depth = 0
    while max_depth is None or depth <= max_depth:
        near = {i: {y if x == i else x for x, y in edges if i in (x, y)} for i in range(len(cols))}
        if depth and all(len(v) - 1 < depth for v in near.values()):
            break
        gone = {}
        for i, j in edges:
            sets = {c for x, y in ((i, j), (j, i)) for c in combinations(sorted(near[x] - {y}), depth)}
            apart = [",".join(sorted(cols[k] for k in c)) for c in sets if not dependent(i, j, c)]
            if apart:
                gone[i, j] = min(apart)
        edges -= gone.keys()
        cut |= gone
        depth += 1
    spark = df.sparkSession
    found = spark.createDataFrame([(cols[i], cols[j], float(r[i, j])) for i, j in sorted(edges)], "a string, b string, r double")
    return found, spark.createDataFrame([(cols[i], cols[j], g) for (i, j), g in sorted(cut.items())], "a string, b string, given string")


def v_structures(edges: DataFrame, separations: DataFrame) -> DataFrame:
    """a -> via <- b for unshielded pairs whose separating set omits ``via``."""
    from .joins import common_neighbours
    open_pairs = common_neighbours(edges).join(edges.select("a", "b"), ["a", "b"], "left_anti")
    return (open_pairs.join(separations, ["a", "b"])
            .filter(~F.array_contains(F.split("given", ","), F.col("via"))).select("a", "b", "via"))


def orient(edges: DataFrame, separations: DataFrame) -> DataFrame:
    """(src, dst, weight, kind): v-structures, then the rules that avoid new ones and cycles, until nothing changes.

    With x and y joined by an undirected edge, x -> y follows from
    a head w -> x where w and y are not adjacent, from a path x -> w -> y, and from
    two non-adjacent c, d that point to y and are joined to x by undirected edges.
    All rules of a round see the same graph; if a round asks for both directions,
    the one from the smaller name is taken.  An edge that two v-structures orient
    against each other is a conflict and orients nothing else.
    """
    weight = {(r["a"], r["b"]): r["r"] for r in edges.collect()}  # at most one row per pair of variables
    near: dict[str, set[str]] = {}
    for a, b in weight:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    heads = {(x, r["via"]) for r in v_structures(edges, separations).collect() for x in (r["a"], r["b"])}
    conflict = {(a, b) for a, b in heads if (b, a) in heads}
    arrows = heads - conflict

    def follows(x: str, y: str, open_edges: set[tuple[str, str]]) -> bool:
        if any((w, x) in arrows and y not in near[w] for w in near[x] - {y}) or any((x, w) in arrows and (w, y) in arrows for w in near[x]):
            return True
        pointing = sorted(c for c in near[x] if (c, y) in arrows and (x, c) in open_edges)
        return any(d not in near[c] for c, d in combinations(pointing, 2))

    while True:
        open_edges = {(x, y) for a, b in weight for x, y in ((a, b), (b, a)) if not {(x, y), (y, x)} & (arrows | conflict)}
        new = {(x, y) for x, y in open_edges if follows(x, y, open_edges)}
        if not new:
            break
        arrows |= {(x, y) for x, y in new if (y, x) not in new or x < y}
    rows = []
    for (a, b), w in sorted(weight.items()):
        kind = "conflict" if (a, b) in conflict else "directed" if {(a, b), (b, a)} & arrows else "undirected"
        rows.append((b, a, w, kind) if (b, a) in arrows else (a, b, w, kind))
    return edges.sparkSession.createDataFrame(rows, "src string, dst string, weight double, kind string")


def lingam_order(df: DataFrame, cols: list[str]) -> DataFrame:
    """Causal order (position, variable) for linear non-Gaussian data.

    Round by round the most exogenous variable is taken out.  Current residuals
    are linear combinations of the original columns, so every round is a single
    aggregate of entropy terms over the original rows.
    """
    base = df.select(*cols).na.drop()
    m = moments(base, cols)
    cov0 = m.cross / m.n
    combo = {c: np.eye(len(cols))[i] for i, c in enumerate(cols)}
    centered = [F.col(c) - F.lit(float(mu)) for c, mu in zip(cols, m.mean)]
    k1, k2, gamma = 79.047, 7.4129, 0.37457  # maximum-entropy approximation constants

    def mix(w: np.ndarray):
        out = F.lit(0.0)
        for v, c in zip(w, centered):
            if v:
                out = out + F.lit(float(v)) * c
        return out

    def terms(w: np.ndarray, tag: str):
        sd = math.sqrt(max(float(w @ cov0 @ w), 1e-300))
        u = mix(w / sd)
        # log cosh u in a form that does not overflow
        a = F.abs(u)
        return [F.avg(a + F.log1p(F.exp(-2 * a)) - math.log(2.0)).alias(f"{tag}_lc"),
                F.avg(u * F.exp(-u * u / 2)).alias(f"{tag}_ue")]

    def entropy(row, tag: str) -> float:
        return ((1 + math.log(2 * math.pi)) / 2 - k1 * (row[f"{tag}_lc"] - gamma) ** 2 - k2 * row[f"{tag}_ue"] ** 2)

    order: list[str] = []
    while len(combo) > 1:
        names = list(combo)
        exprs = []
        for i, a in enumerate(names):
            exprs += terms(combo[a], f"v{i}")
            for j, b in enumerate(names):
                if i != j:
                    va = combo[a]
                    slope = float(combo[b] @ cov0 @ va) / float(va @ cov0 @ va)
                    exprs += terms(combo[b] - slope * va, f"r{j}_{i}")
        row = base.agg(*exprs).first()
        score = {}
        for i, a in enumerate(names):
            total = 0.0
            for j in range(len(names)):
                if i != j:
                    diff = (entropy(row, f"v{j}") + entropy(row, f"r{i}_{j}")) - (entropy(row, f"v{i}") + entropy(row, f"r{j}_{i}"))
                    total += min(0.0, diff) ** 2
            score[a] = total
        root = min(names, key=lambda c: (score[c], c))
        order.append(root)
        vr = combo.pop(root)
        combo = {c: w - float(w @ cov0 @ vr) / float(vr @ cov0 @ vr) * vr for c, w in combo.items()}
    order += list(combo)
    return df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(order)], "position int, variable string")


def adaptive_lasso(cross: np.ndarray, n: float, target: int, given: list[int], steps: int = 100, sweeps: int = 1000) -> np.ndarray:
    """Coefficients of target on the given columns from centered cross products.

    Columns are scaled by their least-squares coefficients, so weak ones are
    penalised most; coordinate descent follows the penalty down a grid, and the
    point of least information criterion (n log n weight per coefficient) is kept.
    """
    sd = np.sqrt(np.maximum(np.diag(cross) / n, 1e-300))
    r = cross / n / np.outer(sd, sd)
    xx, xy = r[np.ix_(given, given)], r[given, target]
    first = np.linalg.lstsq(xx, xy, rcond=None)[0]
    scale = np.abs(first)
    q, c = xx * np.outer(scale, scale), xy * scale
    noise = max((1 - xy @ first) * n / max(n - len(given) - 1, 1), 1e-300)
    top, beta = np.abs(c).max(initial=0), np.zeros(len(given))
    best, choice = None, beta
    for penalty in [*(top * np.logspace(0, -6, steps)), 0.0] if top > 0 else []:
        for _ in range(sweeps):
            moved = 0.0
            for j in range(len(given)):
                if q[j, j] <= 0:
                    continue
                rest = c[j] - q[j] @ beta + q[j, j] * beta[j]
                new = np.sign(rest) * max(abs(rest) - penalty, 0) / q[j, j]
                moved, beta[j] = max(moved, abs(new - beta[j])), new
            if moved < 1e-10:
                break
        criterion = n * (1 - 2 * c @ beta + beta @ q @ beta) / noise + math.log(n) * np.count_nonzero(beta)
        if best is None or criterion < best - 1e-12:
            best, choice = criterion, beta.copy()
    return choice * scale * sd[target] / sd[given]


def lingam_edges(df: DataFrame, cols: list[str]) -> DataFrame:
    """(src, dst, weight): each variable on those before it in the causal order, by adaptive lasso on the moments."""
    order = [r["variable"] for r in lingam_order(df, cols).orderBy("position").collect()]
    m = moments(df.select(*cols).na.drop(), cols)
    at = [cols.index(c) for c in order]
    rows = [(order[i], order[k], float(w)) for k in range(1, len(order)) for i, w in enumerate(adaptive_lasso(m.cross, m.n, at[k], at[:k])) if w != 0]
    return df.sparkSession.createDataFrame(rows, "src string, dst string, weight double")


def bootstrap_edges(df: DataFrame, key: str, cols: list[str], replicates: int = 50, cutoff: float = 0.3, together: int = 5) -> DataFrame:
    """Share of Poisson(1) replicates in which each pair passes the screen.

    The weight of a row in a replicate is drawn from a hash of (key, replicate),
    so retries repeat it.  Rows are not expanded: they are written down once with the
    columns used, and a pass adds up the weighted moments of `together` replicates,
    a product of the batch's weights and its moments; Spark sums those of all tasks.
    """
    cum, p, k, edges = 0.0, math.exp(-1), 0, []
    while cum < 1 - 2.0 ** -41:  # finer than the draw
        cum += p
        edges.append(cum)
        k += 1
        p /= k

    base = written(df.select(key, *cols).na.drop(), "replicates")
    mean = base.agg(*[F.avg(c).alias(c) for c in cols]).first()
    centred = [(F.col(c) - F.lit(float(mean[c] or 0.0))).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]
    products = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    terms = 1 + len(cols) + len(products)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    rows = []
    for first in range(1, replicates + 1, together):
        reps = range(first, min(first + together, replicates + 1))

        def partial(batches, reps=reps):
            total = np.zeros((len(reps), terms))
            for b in batches:
                x = [b.column(i).to_numpy() for i in range(len(cols))]
                moments_ = np.stack([np.ones(b.num_rows), *x, *(x[i] * x[j] for i, j in products)], 1)
                draws = np.stack([b.column(len(cols) + i).to_numpy() for i in range(len(reps))])
                # as many events as limits lie at or below the draw
                total += np.searchsorted(edges, (draws + 0.5) / 2.0 ** 40, "right").astype(float) @ moments_
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(reps, np.int32), terms)), pa.array(np.tile(np.arange(terms, dtype=np.int32), len(reps))),
                                              pa.array(total.ravel())], names=["rep", "term", "v"])

        draws = [F.pmod(F.xxhash64(F.col(key), F.lit(t)), F.lit(2 ** 40)).alias(f"u{t}") for t in reps]
        got = base.select(*centred, *draws).mapInArrow(partial, "rep int, term int, v double").groupBy("rep", "term").agg(F.sum("v").alias("v"))
        one = {(r["rep"], r["term"]): r["v"] for r in got.collect()}
        for t in reps:
            for a, b in pairs:
                i, j, n = cols.index(a), cols.index(b), one.get((t, 0))
                if not n:
                    continue
                cov, va, vb = (one[t, 1 + len(cols) + products.index((min(x, y), max(x, y)))] - one[t, 1 + x] * one[t, 1 + y] / n for x, y in ((i, j), (i, i), (j, j)))
                rows.append((t, a, b, cov / math.sqrt(va * vb) if va > 0 and vb > 0 else None))
    long = df.sparkSession.createDataFrame(rows, "rep int, a string, b string, r double")
    return long.groupBy("a", "b").agg(F.avg((F.abs("r") > cutoff).cast("int")).alias("stability"), F.avg("r").alias("mean_r"))
