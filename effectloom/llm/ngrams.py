"""Exact character n-grams as tables: counts, Kneser-Ney weights and probabilities.

An n-gram is two integers, its first and its last pair of code points
(perplexity.py).  Every distinct n-gram of the documents is a row, so the tables grow
with the corpus; they are counted, weighted and joined in Spark.  A row's
probability is a chain of orders: its own discounted share of its context, plus what
the context leaves times the next lower order.  A context has at most one row per code
point.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows, staged
from .perplexity import MASK, POINT, SHARED, Characters, Model, Table, added, class_keys, classes_of, discounts_by, gram_counts_of

TASK_GRAMS = 4_000_000
CHUNK_CHARS = 1_000_000
HELD_GRAMS = 2_000_000


def chunks(items: list, size) -> list[list]:
    out, now, total = [], [], 0
    for x in items:
        now.append(x)
        total += size(x)
        if total > CHUNK_CHARS:
            out.append(now)
            now, total = [], 0
    return out + [now] if now else out


def counted(texts: DataFrame) -> DataFrame:
    """(lang, high, low, n) over all whole texts (lang, text); tasks add up their own counts first."""
    def out(held):
        for lang, parts in held.items():
            high, low, n = added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(high), pa.array(low), pa.array(n)], names=["lang", "high", "low", "n"])

    def count(batches):
        held, size = defaultdict(list), 0
        for langs, some in rows(batches, "lang", "text"):
            for part in chunks(list(zip(langs, some)), lambda x: len(x[1])):
                by_lang = defaultdict(list)
                for lang, text in part:
                    if text:
                        by_lang[lang].append(text)
                for lang, own in by_lang.items():
                    held[lang].append(gram_counts_of(own))
                    size += len(held[lang][-1][2])
                if size > TASK_GRAMS:
                    held = defaultdict(list, {k: [added(v)] for k, v in held.items()})
                    size = sum(len(v[0][2]) for v in held.values())
                    if size > TASK_GRAMS // 2:
                        yield from out(held)
                        held, size = defaultdict(list), 0
        yield from out(held)

    return texts.mapInArrow(count, "lang string, high long, low long, n long").groupBy("lang", "high", "low").agg(F.sum("n").alias("n"))


def class_counts(grams: DataFrame) -> DataFrame:
    """(lang, gram, n): n-grams of classes, and below zero (-1 less the code point) single characters of shared classes."""
    def fold(batches):
        for b in batches:
            high, low, n = (b.column(k).to_numpy() for k in (1, 2, 3))
            code = (low & MASK) - 1
            single = np.flatnonzero(classes_of(code) >= SHARED)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([b.column(0), b.column(0).take(pa.array(single))]),
                pa.array(np.concatenate([class_keys(high, low).astype(np.int32), (-1 - code[single]).astype(np.int32)])),
                pa.array(np.concatenate([n, n[single]]))], names=["lang", "gram", "n"])

    return grams.select("lang", "high", "low", "n").mapInArrow(fold, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def weighted(grams: DataFrame, *context: str) -> DataFrame:
    """grams (lang, model, ..., n) with share, the discounted part of their context, and rest, what it leaves to the lower order."""
    times = [f"times{k}" for k in range(1, 5)]
    found = grams.groupBy("lang", "model").agg(*[F.count_if(F.col("n") == k).alias(t) for k, t in enumerate(times, 1)]).collect()  # two a language
    cuts = grams.sparkSession.createDataFrame([(r["lang"], r["model"], *discounts_by([r[t] for t in times]).tolist()) for r in found],
                                              "lang string, model string, cut1 double, cut2 double, cut3 double")
    grams = grams.join(F.broadcast(cuts), ["lang", "model"])
    n = F.col("n")
    # whole numbers are summed, so reruns agree
    left = sum(F.count_if(c) * F.max(cut) for c, cut in ((n == 1, "cut1"), (n == 2, "cut2"), (n >= 3, "cut3")))
    sums = grams.groupBy("lang", "model", *context).agg(F.sum("n").alias("total"), left.alias("left"))
    cut = F.when(n == 1, F.col("cut1")).when(n == 2, F.col("cut2")).otherwise(F.col("cut3"))
    share = F.when(n > 0, (n - cut) / F.col("total")).otherwise(0.0)
    rest = F.when(F.col("total") > 0, F.col("left") / F.col("total")).otherwise(1.0)
    return grams.join(sums, ["lang", "model", *context]).withColumns({"share": share, "rest": rest}).drop("total", "left", "cut1", "cut2", "cut3")


def chain(grams: DataFrame) -> DataFrame:
    """grams (lang, model, high, low, n, want) -> those wanted, with share and rest over orders 4 to 2: p = share + rest * p of classes.

    n is the count in the model's texts, zero where only others have the n-gram.
    Lower orders count in how many contexts they continue.
    """
    third, second = F.shiftright("low", POINT), F.col("high").bitwiseAND(F.lit(MASK))
    by = ["lang", "model"]

    def lower(table: DataFrame, label: str, **key: Column) -> DataFrame:
        return staged(table.groupBy(*by, *[c.alias(k) for k, c in key.items()]).agg(F.count_if(F.col("n") > 0).alias("n")), label)

    three = lower(grams, "order3", second=second, low=F.col("low"))
    two = lower(three, "order2", low=F.col("low"))

    def joined(table: DataFrame, below: DataFrame, *on: str) -> DataFrame:
        low = below.select(*by, *on, F.col("share").alias("low_share"), F.col("rest").alias("low_rest"))
        return table.join(low, [*by, *on]).withColumns({
            "share": F.col("share") + F.col("rest") * F.col("low_share"), "rest": F.col("rest") * F.col("low_rest")}).drop("low_share", "low_rest")

    done = weighted(two.withColumn("third", third), "third")
    done = joined(weighted(three.withColumn("third", third), "second", "third"), done, "low")
    top = weighted(grams.withColumn("third", third), "high", "third").filter("want > 0").withColumn("second", second)
    return joined(top, done, "second", "low").select(*by, "high", "low", "want", "share", "rest")


def probabilities(chained: DataFrame, models: dict[tuple[str, str], tuple[Model, Characters, Characters]]) -> DataFrame:
    """(lang, model, high, low, want, logp, class_logp): the chain ends in the models of classes, shared characters and forms, which are broadcast.

    class_logp leaves the form of a letter, digit or space aside.
    """
    shared = chained.sparkSession.sparkContext.broadcast(models)

    def end(batches):
        for b in batches:
            lang, model = b.column(0).to_pylist(), b.column(1).to_pylist()
            high, low, share, rest = (b.column(k).to_numpy() for k in (2, 3, 5, 6))
            names = defaultdict(list)
            for i, name in enumerate(zip(lang, model)):
                names[name].append(i)
            p, inner = np.zeros(len(high)), np.zeros(len(high))
            for name, some in names.items():
                classes, characters, forms = shared.value[name]
                code = (low[some] & MASK) - 1
                several = classes_of(code) >= SHARED
                inner[some] = classes.logp(class_keys(high[some], low[some])) + np.where(several, characters.logp(code), 0)
                p[some] = share[some] + rest[some] * np.exp(inner[some] + np.where(several, 0, forms.logp(code)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(np.log(p).astype(np.float32)), pa.array(inner.astype(np.float32))],
                                             names=["lang", "model", "high", "low", "want", "logp", "class_logp"])

    return chained.select("lang", "model", "high", "low", "want", "share", "rest").mapInArrow(
        end, "lang string, model string, high long, low long, want long, logp float, class_logp float")


def frequent(table: DataFrame, held: int = HELD_GRAMS) -> tuple[Table, bool]:
    """The n-grams that texts want most, at most `held` of them, and whether these are all."""
    cells = table.groupBy(F.floor(F.log2("want") * 16).alias("cell")).count().collect()  # sixteen a doubling
    least, total = None, 0
    for r in sorted(cells, key=lambda r: -r["cell"]):
        total += r["count"]
        if total > held:
            break
        least = r["cell"]
    if least is None:
        return Table([], *(np.zeros(0, np.int64) for _ in range(5))), not cells
    names = [tuple(r) for r in table.select("lang", "model").distinct().collect()]
    code = F.coalesce(*[F.when((F.col("lang") == g[0]) & (F.col("model") == g[1]), k) for k, g in enumerate(names)])
    got = table.filter(F.floor(F.log2("want") * 16) >= least).select(code.alias("code"), "high", "low", "logp", "class_logp").toArrow()
    out = Table(names, *(got[c].to_numpy() for c in ("code", "high", "low", "logp", "class_logp")))
    return out, out.held == sum(r["count"] for r in cells)
