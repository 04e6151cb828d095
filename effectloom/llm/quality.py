"""Quality rules: counted features and language-specific perplexity bands.

One pass counts the exact character n-grams of all documents by language.  Languages
with a sixty-fourth of all characters or more get a modified Kneser-Ney model of
their own, the others share one, so there are at most 65 of them.  Their n-grams are
tables without a bound; only the class models at the end of the chain, of at most
2**24 keys a fold and one entry per code point, come together, in passes of a bounded
number of keys.  Texts are dealt into two folds by their hash, each fold has models of
its own, and a second pass scores every whole text by the other fold's model: neither
a text nor its exact copies make themselves likely.  The n-grams that texts hold most
often, a bounded number, are broadcast for that pass; all others of a text leave it as
rows and are joined to the table, with the same result.  A text has two perplexities,
that of the exact n-grams and that of the class model alone: n-grams soon know junk
that comes again, classes charge its signs whatever stands before them.  It is judged by
that of both, log-linearly with even weights, and by that of the classes: the band of a
language is the median of its log-perplexities plus or minus a multiple of their median
deviation, from a histogram over all its documents that pass the base rules; documents
outside either band are rejected.

null text: as without words, so base_failed.  A null language is a language of
its own.  Null or repeated ids keep their rows; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import rows, staged, text_or_empty
from .ngrams import HELD_GRAMS, chain, chunks, class_counts, counted, frequent, probabilities
from .perplexity import MASK, SHARED, Characters, Model, classes_of

OWN_SHARE = 1 / 64
PASS_GRAMS = 8_000_000
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCORES = ["log_perplexity", "class_log_perplexity"]


def name(lang_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit(""))


def fold(text_col: str) -> Column:
    return F.pmod(F.xxhash64(text_or_empty(text_col)), F.lit(2)).cast("string")


def by_language(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, text); lang is the fold, then nothing for null, else '=' and the value."""
    return docs.select(F.concat(fold(text_col), name(lang_col)).alias("lang"), text_or_empty(text_col).alias("text"))


def gram_counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, gram, n) of classes and single characters of shared classes over all whole texts."""
    return class_counts(counted(by_language(docs, lang_col, text_col)))


def features(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        end = 0  # words before it are counted
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def models_of(counts: DataFrame, letters: DataFrame, langs: list[str]) -> dict[tuple[str, str], tuple[Model, Characters, Characters]]:
    """Models of classes, of characters of shared classes and of forms in the others per language and fold of a pass; the pass bounds what comes to the driver."""
    out = {}
    for lang in langs:
        for k in "01":
            mine = (F.col("lang") == lang) & (F.col("fold") == k)
            part = counts.filter(mine).select("gram", "n").toArrow()
            if part.num_rows:
                gram, n = part["gram"].to_numpy(), part["n"].to_numpy()
                single = gram < 0
                whole = letters.filter(mine).select("letter", "n").toArrow()
                code, times = whole["letter"].to_numpy() - 1, whole["n"].to_numpy()
                form = classes_of(code) < SHARED
                out[lang, k] = Model(gram[~single].astype(np.uint32), n[~single]), Characters(-1 - gram[single], n[single]), Characters(code[form], times[form])
    return out


def gram_table(docs: DataFrame, lang_col: str, text_col: str) -> tuple[DataFrame, list[str], list[str]]:
    """Log-probability of every n-gram in the model that scores its texts; languages with a model of their own; those with texts in one fold only."""
    split = [F.substring("lang", 1, 1).alias("fold"), F.expr("substring(lang, 2)").alias("lang")]
    raw = staged(counted(by_language(docs, lang_col, text_col)), "grams")
    # one n-gram a character; at most 64 languages can have that share
    total = raw.agg(F.sum("n")).first()[0] or 0
    own = sorted(r["lang"] for r in raw.select(*split, "n").groupBy("lang").agg(F.sum("n").alias("n")).filter(F.col("n") >= total * OWN_SHARE).collect())
    pooled = F.when(F.col("lang").isin(own), F.col("lang")).otherwise(F.lit("?")).alias("lang")
    exact = staged(raw.select(*split, "high", "low", "n").select(pooled, "fold", "high", "low", "n").groupBy("lang", "fold", "high", "low").agg(F.sum("n").alias("n")), "exact")
    counts = staged(class_counts(raw).select(*split, "gram", "n").select(pooled, "fold", "gram", "n").groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n")), "model")
    letters = staged(exact.groupBy("lang", "fold", F.col("low").bitwiseAND(F.lit(MASK)).alias("letter")).agg(F.sum("n").alias("n")), "letters")
    sizes = counts.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("folds")).collect()
    lone = [r["lang"] for r in sizes if r["folds"] == 1]
    model = model_of(lone)
    # an n-gram counts in its own fold's model and is wanted from the one that scores its texts
    both = F.explode(F.array(F.struct(F.col("fold").alias("model"), "n", F.lit(0).cast("long").alias("want")), F.struct(model.alias("model"), F.lit(0).cast("long").alias("n"), F.col("n").alias("want"))))
    grams = exact.select("lang", "high", "low", both.alias("x")).select("lang", "high", "low", "x.*").groupBy("lang", "model", "high", "low").agg(F.sum("n").alias("n"), F.sum("want").alias("want"))
    chained = staged(chain(staged(grams, "order4")), "chain")
    passes, held = [[]], 0
    for r in sorted(sizes, key=lambda r: r["lang"]):
        if held + r["n"] > PASS_GRAMS:
            passes, held = [*passes, []], 0
        passes[-1].append(r["lang"])
        held += r["n"]
    out = None
    for langs in passes:
        part = probabilities(chained.filter(F.col("lang").isin(langs)), models_of(counts, letters, langs))
        out = part if out is None else out.unionByName(part)
    return staged(out, "probabilities"), own, lone


def model_of(lone: list[str]) -> Column:
    """The other fold's model; its own where a language has texts in one fold only."""
    return F.when(F.col("lang").isin(lone), F.col("fold")).otherwise((1 - F.col("fold").cast("int")).cast("string"))


def scored(docs: DataFrame, id_col: str, lang_col: str, text_col: str, held: int = HELD_GRAMS) -> DataFrame:
    """(id, lang, features, log_perplexity, class_log_perplexity); lang is the model's name."""
    grams, own, lone = gram_table(docs, lang_col, text_col)
    table, whole = frequent(grams, held)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.select(id_col).schema[0].dataType
    arrow = to_arrow_type(kind)
    lang = F.when(name(lang_col).isin(own), name(lang_col)).otherwise(F.lit("?"))
    todo = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), fold(text_col).alias("fold"), text_or_empty(text_col).alias("text")).select("id", "lang", model_of(lone).alias("model"), "text")
    others = pa.list_(pa.struct([("high", pa.int64()), ("low", pa.int64()), ("times", pa.int64())]))

    def score(batches):
        table, places = shared.value, None
        for ids, langs, models, texts in rows(batches, "id", "lang", "model", "text"):
            places = table.places() if places is None else places
            total, length = np.zeros((len(texts), 2)), np.zeros(len(texts), np.int64)
            rest = [None] * len(texts)
            for part in chunks(list(range(len(texts))), lambda i: len(texts[i])):
                by_model = defaultdict(list)
                for i in part:
                    if texts[i]:
                        by_model[langs[i], models[i]].append(i)
                for group, some in by_model.items():
                    total[some], length[some], (of, *missed) = table.score(group, [texts[i] for i in some], places)
                    if len(of):
                        cut = np.searchsorted(of, np.arange(len(some) + 1))
                        found = pa.StructArray.from_arrays([pa.array(x) for x in missed], names=["high", "low", "times"])
                        for k, i in enumerate(some):
                            rest[i] = found[cut[k]:cut[k + 1]]
            filled = [x for x in rest if x is not None]
            ends = np.cumsum([0, *(0 if x is None else len(x) for x in rest)]).astype(np.int32)
            values = pa.concat_arrays(filled) if filled else pa.array([], others.value_type)
            cols = zip(*map(features, texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow), pa.array(langs, pa.string()), pa.array(models, pa.string()), *(pa.array(c, pa.int64()) for c in cols),
                 pa.array(total[:, 0].copy()), pa.array(total[:, 1].copy()), pa.array(length), pa.ListArray.from_arrays(pa.array(ends), values)],
                names=["id", "lang", "model", *NAMES, "logp", "class_logp", "length", "others"])

    out = todo.mapInArrow(score, f"id {kind.simpleString()}, lang string, model string, {', '.join(f'{n} long' for n in NAMES)}, logp double, class_logp double, length long, "
                                 "others array<struct<high: long, low: long, times: long>>")
    sums = ["logp", "class_logp"]
    if not whole:
        out = staged(out.withColumn("row", F.monotonically_increasing_id()), "texts")
        # an n-gram that is not broadcast is in few texts, so no key is hot here
        rest = out.select("row", "lang", "model", F.inline("others")).join(grams.select("lang", "model", "high", "low", *[F.col(c).alias(f"one_{c}") for c in sums]), ["lang", "model", "high", "low"])
        rest = rest.groupBy("row").agg(*[F.sum(F.col(f"one_{c}").cast("double") * F.col("times")).alias(f"more_{c}") for c in sums])
        out = out.join(rest, "row", "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0.0)) for c in sums})
    return out.select("id", "lang", *NAMES, *[F.when(F.col("length") > 0, -F.col(c) / F.col("length")).alias(n) for c, n in zip(sums, SCORES)])


def bands(table: DataFrame, score: str, spread: float, least: float) -> dict[str, tuple[float, float]]:
    """Lower and upper score by language, from a histogram of thousandths."""
    cells = table.filter(~F.col("base_failed") & F.col(score).isNotNull()).groupBy("lang", F.round(F.col(score) * 1000).cast("int").alias("cell")).count()
    by_lang = defaultdict(list)
    for r in cells.collect():  # at most 65 languages of a few thousand cells
        by_lang[r["lang"]].append((r["cell"], r["count"]))

    def median(pairs):
        pairs, seen = sorted(pairs), 0
        for value, n in pairs:
            seen += n
            if 2 * seen >= sum(n for _, n in pairs):
                return value
        return 0

    out = {}
    for lang, pairs in by_lang.items():
        middle = median(pairs)
        wide = max(least, spread * 1.4826 * median([(abs(v - middle), n) for v, n in pairs]) / 1000)
        out[lang] = (middle / 1000 - wide, middle / 1000 + wide)
    return out


def quality(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, spread: float = 6.0, least: float = 0.05,
            id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, class_perplexity."""
    found = scored(docs, id_col, lang_col, text_col)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    both = (F.col("log_perplexity") + F.col("class_log_perplexity")) / 2
    table = staged(found.withColumns({"base_failed": failed, "log_both": both}), "scores")
    inside = F.lit(True)
    for score in ("log_both", "class_log_perplexity"):
        within = F.lit(True)
        for lang, (low, high) in bands(table, score, spread, least).items():
            within = F.when(F.col("lang") == lang, F.col(score).between(low, high)).otherwise(within)
        inside = inside & F.coalesce(within, F.lit(True))
    return table.select(F.col("id").alias(id_col), *NAMES, "base_failed", (~F.col("base_failed") & inside).alias("kept"),
                        F.exp("log_perplexity").alias("perplexity"), F.exp("class_log_perplexity").alias("class_perplexity"))
