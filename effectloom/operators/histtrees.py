"""Trees over binned features, grown level by level from histograms that Spark adds up.

A feature is cut at up to `bins` - 1 of its quantiles, so a row is one byte per
feature.  A pass over the rows sums gradient statistics per (tree, node, feature,
bin); the sums of all rows, a bounded number, reach the driver, which chooses the
splits.  One pass serves all trees that grow at the same time: every fold and
both nuisance models of a boosting round, or a group of trees of a forest.

`boost` fits gradient boosting on the complement of every fold.  `honest_forest`
grows trees whose splits come from one half of a subsample and whose leaf effects
come from the other half.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import erfc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import written

STATS = 3
CELLS = 1 << 20  # histogram cells of one pass that may reach the driver


def quantile_cuts(df: DataFrame, xs: list[str], bins: int = 64) -> list[np.ndarray]:
    """Upper limits of all bins but the last, per feature; one aggregate of quantile sketches."""
    if not 2 <= bins <= 256:
        raise ValueError("a bin is one byte: 2 to 256 bins")
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(x).cast("double"), probs, 10_000).alias(f"q{i}") for i, x in enumerate(xs)],
                 *[F.max(F.col(x).cast("double")).alias(f"m{i}") for i, x in enumerate(xs)]).first()
    return [np.array(sorted({v for v in row[f"q{i}"] or [] if v < row[f"m{i}"]}), float) for i in range(len(xs))]


def in_bins(values: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, np.asarray(v, float), "left") for v, c in zip(values, cuts)], 1).astype(np.uint8)


def bins_column(xs: list[str], cuts: list[np.ndarray]) -> Column:
    @F.pandas_udf("binary")
    def make(*cols: pd.Series) -> pd.Series:
        return pd.Series([r.tobytes() for r in in_bins([c.to_numpy() for c in cols], cuts)])

    return make(*[F.col(x).cast("double") for x in xs])


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of a binary column whose values all have the same length."""
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32, 1, 4 * column.offset)[0] if len(column) else 0
    return np.frombuffer(data, kind, len(column) * width, first).reshape(len(column), width)


@dataclass
class Tree:
    """A complete binary tree: feature (-1: all rows go left) and cut of inner nodes, values of leaves."""
    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        self.feature = np.full((1 << self.depth) - 1, -1)
        self.cut = np.zeros((1 << self.depth) - 1, int)
        self.value = np.zeros(1 << self.depth)

    def node(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Place within its level of each row's node after so many levels."""
        flat, base = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        at = np.zeros(len(bins), np.int64)
        for level in range(self.depth if levels is None else levels):
            inner = at + (1 << level) - 1
            f = self.feature[inner]
            at = 2 * at + ((flat[base + np.maximum(f, 0)] > self.cut[inner]) & (f >= 0))
        return at


def histograms(rows: DataFrame, columns: list[str], width: int, nodes: int, trees: int, bins: int,
               stats: Callable[[pa.RecordBatch, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]]) -> np.ndarray:
    """Sums (trees, nodes, features, bins, statistics) over all rows.

    stats gives, for a batch and its bins, (tree, rows that take part, their nodes, their statistics).
    """
    size = nodes * width * bins

    def partial(batches):
        sums = np.zeros((trees, STATS, nodes, width, bins))
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(b.schema.get_field_index("bins")), np.uint8, width)
            for tree, some, node, values in stats(b, x):
                base, own = node * bins, x[some]
                for f in range(width):
                    slot = base + own[:, f]
                    for s, v in enumerate(values):
                        sums[tree, s, :, f] += np.bincount(slot, v, nodes * bins).reshape(nodes, bins)
        sums = sums.reshape(trees, STATS, size)
        tree, slot = np.nonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(tree * size + slot), *[pa.array(sums[tree, s, slot]) for s in range(STATS)]], names=["slot", "s0", "s1", "s2"])

    found = rows.select("bins", *columns).mapInArrow(partial, "slot long, s0 double, s1 double, s2 double")
    got = found.groupBy("slot").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(STATS)]).toArrow()
    out = np.zeros((trees * size, STATS))
    out[got["slot"].to_numpy()] = np.stack([got[f"s{s}"].to_numpy() for s in range(STATS)], 1)
    return out.reshape(trees, nodes, width, bins, STATS)


def best_splits(sums: np.ndarray, gain: Callable[[np.ndarray, np.ndarray], np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1, cut, gain, left sums, right sums) per (tree, node); ties to the first feature, then the lowest cut."""
    left = sums.cumsum(3)
    total = left[:, :, :1, -1:]
    right = left[..., -1:, :] - left
    g = gain(left, right)
    g[(left[..., 0] < least) | (right[..., 0] < least) | ~np.isfinite(g)] = -np.inf
    flat = g.reshape(*g.shape[:2], -1)
    best = flat.argmax(2)
    top = np.take_along_axis(flat, best[..., None], 2)[..., 0]
    feature, cut = best // sums.shape[3], best % sums.shape[3]
    ok = top > 1e-12
    i, j = np.indices(best.shape)
    l, r = left[i, j, feature, cut], right[i, j, feature, cut]
    total = total[:, :, 0, 0]
    return np.where(ok, feature, -1), cut, np.where(ok, top, 0.0), np.where(ok[..., None], l, total), np.where(ok[..., None], r, 0.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Boosted:
    """Out-of-fold models: per target and fold the first score and the trees grown without that fold."""
    cuts: list[np.ndarray]
    folds: list[int]
    start: np.ndarray
    trees: list[list[Tree]]
    logistic: tuple[bool, bool]
    rate: float

    def add(self, bins: np.ndarray, score: np.ndarray, done: int) -> np.ndarray:
        """Scores (rows, targets x folds) with the trees from number `done` on."""
        score = score.copy()
        for s, own in enumerate(self.trees):
            for tree in own[done:]:
                score[:, s] += self.rate * tree.value[tree.node(bins)]
        return score

    def mean(self, score: np.ndarray, target: int) -> np.ndarray:
        return sigmoid(score) if self.logistic[target] else score


def boost(df: DataFrame, targets: tuple[str, str], xs: list[str], fold: str = "fold", trees: int = 100, depth: int = 3, rate: float = 0.1,
          bins: int = 64, min_leaf: int = 1, logistic: tuple[bool, bool] = (False, False), replay: int = 5) -> Boosted:
    """Gradient boosting of two targets without each fold in turn, all 2 x folds models from one pass a tree level.

    Squared loss, or logistic loss with Newton leaves for a 0/1 target.  Every
    `replay` trees the scores are written beside the rows, so that a pass replays
    no more trees than that.  df has no nulls in the columns used.
    """
    cuts = quantile_cuts(df, xs, bins)
    totals = [F.sum("n").alias("n"), F.sum("v0").alias("v0"), F.sum("v1").alias("v1")]
    each = df.select(F.col(fold).cast("int").alias("fold"), F.lit(1).alias("n"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(targets)],
                     bins_column(xs, cuts).alias("bins"))
    # rows of one fold and equal bins always get one prediction, so their sums are all that a tree needs
    rows = written(each.groupBy("fold", "bins").agg(*totals), "boosting")
    sums = {r["fold"]: r for r in rows.groupBy("fold").agg(*totals).collect()}
    folds = sorted(sums)
    k, width = len(folds), len(xs)
    start = np.zeros((2, k))
    for t in range(2):
        for m, f in enumerate(folds):
            mean = sum(sums[o][f"v{t}"] for o in folds if o != f or k == 1) / sum(sums[o]["n"] for o in folds if o != f or k == 1)
            start[t, m] = np.log(np.clip(mean, 1e-12, None) / np.clip(1 - mean, 1e-12, None)) if logistic[t] else mean
    model = Boosted(cuts, folds, start.ravel(), [[] for _ in range(2 * k)], logistic, rate)
    first = model.start
    rows = rows.withColumn("score", F.lit(first.tobytes()))
    written_trees = 0

    def gain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            both = left + right
            return left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - both[..., 1] ** 2 / both[..., 0]

    def level_stats(growing: list[Tree], level: int, done: int):
        def stats(batch: pa.RecordBatch, x: np.ndarray):
            names = batch.schema.names
            score = model.add(x, matrix(batch.column(names.index("score")), float, 2 * k), done)
            own, n = (batch.column(names.index(c)).to_numpy() for c in ("fold", "n"))
            for t in range(2):
                v = batch.column(names.index(f"v{t}")).to_numpy()
                for m, f in enumerate(folds):
                    s = t * k + m
                    some = np.nonzero(own != f)[0] if k > 1 else np.arange(len(own))
                    mean = model.mean(score[some, s], t)
                    weight = n[some] * mean * (1 - mean) if logistic[t] else n[some]
                    yield s, some, growing[s].node(x[some], level), [n[some], v[some] - n[some] * mean, weight]
        return stats

    for _ in range(trees):
        growing = [Tree(depth) for _ in range(2 * k)]
        for level in range(depth):
            got = histograms(rows, ["fold", "n", "v0", "v1", "score"], width, 1 << level, 2 * k, bins, level_stats(growing, level, written_trees))
            feature, cut, _, left, right = best_splits(got, gain, min_leaf)
            inner = slice((1 << level) - 1, (2 << level) - 1)
            for s, tree in enumerate(growing):
                tree.feature[inner], tree.cut[inner] = feature[s], cut[s]
                if level == depth - 1:
                    ends = np.stack([left[s], right[s]], 1).reshape(-1, STATS)
                    tree.value = np.divide(ends[:, 1], ends[:, 2], out=np.zeros(len(ends)), where=ends[:, 2] > 1e-300)
        for own, tree in zip(model.trees, growing):
            own.append(tree)
        if len(model.trees[0]) - written_trees >= replay and len(model.trees[0]) < trees:
            done = written_trees

            @F.pandas_udf("binary")
            def scored(b: pd.Series, s: pd.Series) -> pd.Series:
                x = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), width)
                new = model.add(x, np.frombuffer(b"".join(s), float).reshape(len(b), 2 * k), done)
                return pd.Series([r.tobytes() for r in new])

            rows = written(rows.withColumn("score", scored("bins", "score")), "boosting")
            written_trees = len(model.trees[0])
    return model


def out_of_fold(df: DataFrame, model: Boosted, xs: list[str], fold: str = "fold") -> Column:
    """struct (v0, v1): each row's prediction of both targets by the models that have not seen its fold."""
    k = len(model.folds)

    @F.pandas_udf("v0 double, v1 double")
    def predict(own: pd.Series, *cols: pd.Series) -> pd.DataFrame:
        x = in_bins([c.to_numpy() for c in cols], model.cuts)
        m = np.searchsorted(model.folds, own.to_numpy())
        score = model.add(x, np.tile(model.start, (len(x), 1)), 0)
        at = np.arange(len(x))
        return pd.DataFrame({f"v{t}": model.mean(score[at, t * k + m], t) for t in range(2)})

    return predict(F.col(fold).cast("int"), *[F.col(x).cast("double") for x in xs])


@dataclass
class HonestForest:
    """Trees in groups; each leaf holds the estimation half's means of rt * ry and rt * rt."""
    xs: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree]
    top: np.ndarray     # (trees, leaves): mean of rt * ry
    base: np.ndarray    # (trees, leaves): mean of rt * rt
    count: np.ndarray   # (trees, leaves): rows of the estimation half
    gains: np.ndarray
    group: int

    def effects(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Effect of each row and its standard error from the spread of groups of trees."""
        n, g = len(bins), len(self.trees) // self.group
        a, b, used = (np.zeros((n, len(self.trees))) for _ in range(3))
        for i, tree in enumerate(self.trees):
            leaf = tree.node(bins)
            used[:, i] = self.count[i, leaf] > 0
            a[:, i], b[:, i] = self.top[i, leaf], self.base[i, leaf]
        with np.errstate(divide="ignore", invalid="ignore"):
            theta = a.sum(1) / b.sum(1)
            # moment residuals of each tree, in units of the effect
            psi = ((a - theta[:, None] * b) / (b.sum(1) / used.sum(1))[:, None]).reshape(n, g, self.group)
            alive = used.reshape(n, g, self.group)
            size = alive.sum(2)
            mean = np.where(size > 0, (psi * alive).sum(2) / np.maximum(size, 1), 0.0)
            between = (mean ** 2).sum(1) / np.maximum((size > 0).sum(1), 1)
            spread = (((psi - mean[:, :, None]) * alive) ** 2).sum(2) / np.maximum(size * (size - 1), 1)
            noise = spread.sum(1) / np.maximum((size > 1).sum(1), 1)
            # a group's variance holds the noise of its few trees; the rest is that of the half-samples.  As that
            # difference is itself uncertain and must not be negative, take the mean of its normal law above zero.
            left, error = between - noise, np.maximum(np.maximum(between, noise) * np.sqrt(2 / g), 1e-300)
            ratio = np.clip(left / error, -30, 30)
            above = 0.5 * np.array([erfc(-r / np.sqrt(2)) for r in ratio.tolist()])
            se = np.sqrt(left + error * np.exp(-ratio ** 2 / 2) / np.sqrt(2 * np.pi) / np.maximum(above, 1e-300))
        return theta, se

    def column(self) -> Column:
        """struct (cate, cate_se, cate_lower, cate_upper) of a row."""
        @F.pandas_udf("cate double, cate_se double, cate_lower double, cate_upper double")
        def predict(*cols: pd.Series) -> pd.DataFrame:
            # rows of equal bins have one effect
            bins, place = np.unique(in_bins([c.to_numpy() for c in cols], self.cuts), axis=0, return_inverse=True)
            theta, se = (v[place.ravel()] for v in self.effects(bins))
            return pd.DataFrame({"cate": theta, "cate_se": se, "cate_lower": theta - 1.96 * se, "cate_upper": theta + 1.96 * se})

        return predict(*[F.col(x).cast("double") for x in self.xs])

    def importance(self) -> np.ndarray:
        """Share of each feature in the gains of all splits."""
        total = self.gains.sum()
        return self.gains / total if total > 0 else np.full(len(self.xs), 1 / len(self.xs))

    def leaves(self, tree: int = 0) -> list[tuple]:
        """(leaf, rows, effect, path) of a tree's leaves that hold rows; path: feature, cut and side of each split."""
        t, out = self.trees[tree], []
        for leaf in np.nonzero(self.count[tree] > 0)[0].tolist():
            path, at = [], 0
            for level in range(t.depth):
                inner, right = at + (1 << level) - 1, leaf >> (t.depth - 1 - level) & 1
                if t.feature[inner] >= 0:
                    path.append((self.xs[t.feature[inner]], float(self.cuts[t.feature[inner]][t.cut[inner]]), bool(right)))
                at = 2 * at + right
            out.append((leaf, int(self.count[tree, leaf]), float(self.top[tree, leaf] / self.base[tree, leaf]), path))
        return out


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform 64-bit numbers from row hashes and a salt."""
    with np.errstate(over="ignore"):
        z = h.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def honest_forest(res: DataFrame, xs: list[str], key: Column, trees: int = 200, depth: int = 5, min_leaf: int = 20, bins: int = 64,
                  group: int = 4, share: float = 0.5, half: Column | None = None, seed: int = 42) -> HonestForest:
    """Honest causal forest on residuals res_y, res_t.

    A group of trees draws one half-sample of the rows, and each of its trees
    `share` of that (share 1: all rows for every tree); a tree's rows are dealt
    into a splitting and an estimating half (or by `half`, 1: estimates).  Draws
    are hashes of the row key, so retries repeat them.  A split maximises the sum
    over its sides of (gradient sum)^2 / rows, the gradient being that of the
    parent's moment condition.  Every split leaves min_leaf rows of the splitting
    half on both sides.
    """
    groups = max(1, trees // group)
    trees = groups * group if trees >= group else trees
    group = min(group, trees)
    clean = res.na.drop(subset=["res_y", "res_t", *xs])
    cuts = quantile_cuts(clean, xs, bins)
    rows = written(clean.select(F.xxhash64(key).alias("h"), (F.lit(-1) if half is None else half).cast("int").alias("half"), (F.col("res_t") * F.col("res_y")).alias("a"),
                                (F.col("res_t") * F.col("res_t")).alias("b"), bins_column(xs, cuts).alias("bins")), "forest")
    width, leaves = len(xs), 1 << depth
    grown = [Tree(depth) for _ in range(trees)]
    top, base, count = (np.zeros((trees, leaves)) for _ in range(3))
    gains = np.zeros(width)
    bound = int(share * 2 ** 64) if share < 1 else None
    drawn = half is None

    def members(batch: pa.RecordBatch, which: list[int], estimating: bool) -> Iterator[np.ndarray]:
        """Rows of each tree's half; each draw is made only for rows that the draws before it left, a group's own once."""
        names = batch.schema.names
        h, fixed = batch.column(names.index("h")).to_numpy(), batch.column(names.index("half")).to_numpy()
        every, last = np.arange(len(h)), None
        for tree in which:
            some = every
            if bound is not None:
                if tree // group != last:
                    last = tree // group
                    shared = np.nonzero(mixed(h, seed + 3 * last) < np.uint64(1 << 63))[0]
                    shared_h = h[shared]
                some = shared[mixed(shared_h, seed + 1_000_003 + 3 * tree) < np.uint64(bound)]
            if drawn:
                second = mixed(h[some], seed + 2_000_003 + 3 * tree) < np.uint64(1 << 63)
            else:
                second = np.where(fixed[some] >= 0, fixed[some] == 1, mixed(h[some], seed + 2_000_003 + 3 * tree) < np.uint64(1 << 63))
            yield some[second == estimating]

    def passed(which: list[int], level: int, estimating: bool):
        def stats(batch: pa.RecordBatch, x: np.ndarray):
            names = batch.schema.names
            a, b = batch.column(names.index("a")).to_numpy(), batch.column(names.index("b")).to_numpy()
            for at, some in enumerate(members(batch, which, estimating)):
                yield at, some, grown[which[at]].node(x[some], level), [np.ones(len(some)), a[some], b[some]]
        return stats

    def gain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        both = left + right
        with np.errstate(divide="ignore", invalid="ignore"):
            theta = both[..., 1] / both[..., 2]
            scale = both[..., 2] / both[..., 0]
            return sum((side[..., 1] - theta * side[..., 2]) ** 2 / side[..., 0] for side in (left, right)) / scale ** 2

    together = max(1, CELLS // (leaves * width * bins))
    for first in range(0, trees, together):
        which = list(range(first, min(first + together, trees)))
        for level in range(depth):
            got = histograms(rows, ["h", "half", "a", "b"], width, 1 << level, len(which), bins, passed(which, level, False))
            feature, cut, won, _, _ = best_splits(got, gain, min_leaf)
            inner = slice((1 << level) - 1, (2 << level) - 1)
            for at, tree in enumerate(which):
                grown[tree].feature[inner], grown[tree].cut[inner] = feature[at], cut[at]
            np.add.at(gains, feature[feature >= 0], won[feature >= 0])
        # every feature's bins add up to the same leaf sums
        ends = histograms(rows, ["h", "half", "a", "b"], width, leaves, len(which), bins, passed(which, depth, True))[:, :, 0].sum(2)
        held = ends[..., 0] > 0
        count[which] = ends[..., 0]
        top[which] = np.divide(ends[..., 1], ends[..., 0], out=np.zeros(held.shape), where=held)
        base[which] = np.divide(ends[..., 2], ends[..., 0], out=np.zeros(held.shape), where=held)
    return HonestForest(xs, cuts, grown, top, base, count, gains, group)
