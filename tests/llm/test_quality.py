import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from effectloom.llm.ngrams import chain, counted
from effectloom.llm.perplexity import (MASK, Characters, Model, Table, class_table, classes, classes_of, code_points, discounts, gram_counts_of,
                                       keys, letters_of, shared_characters)
from effectloom.llm.quality import features, fold, gram_counts, quality, scored
from effectloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_features():
    texts = ["", " ", "a a a a", "a b c a b c d a b c", "x\n\n x\nx\nx y\nx", "é#*|\t<b>\x0b\x1c c d", "a b c d " * 40]
    assert [features(t) for t in texts] == [brute(t) for t in texts]


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op5_quality"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    good = [r.kept for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(good) >= 0.97 * len(good)


def test_model_is_a_distribution_and_falls_back():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcde .")) for _ in range(200)) for _ in range(20)]
    gram, n = np.unique(keys(texts)[0], return_counts=True)
    model = Model(gram, n)
    for start in ("abc", "zzz", "a中!"):
        a, b, c = classes(start).astype(np.uint32).tolist()
        context = np.uint32(a << 18 | b << 12 | c << 6)
        assert abs(np.exp(model.logp(context | np.arange(64, dtype=np.uint32)).astype(float)).sum() - 1) < 1e-4
    counts = Counter(x for t in texts for x in keys([t])[0].tolist())
    assert dict(zip(gram.tolist(), n.tolist())) == counts
    assert class_table().max() < 64 and class_table().min() >= 1


def test_spark_counts_equal_python(spark):
    docs = [(1, "en", "abc abd"), (2, None, "abc"), (3, "en", "abc"), (4, "en", None), (5, "fr", "")]
    want = defaultdict(int)
    for _, lang, t in docs:
        for k in keys([t])[0].tolist() if t else []:
            want["" if lang is None else "=" + lang, k] += 1
    got = gram_counts(spark.createDataFrame(docs, "doc_id long, lang string, text string"), "lang", "text").collect()
    have = defaultdict(int)
    for r in got:
        assert r.lang[0] in "01"
        have[r.lang[1:], r.gram] += r.n
    assert have == want


def test_junk_is_rejected_and_odd_rows_have_results(spark):
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en' AND n_chars BETWEEN 500 AND 4000").limit(150).collect()]
    rng = np.random.default_rng(4)
    junk = " ".join("".join(rng.choice(list("q7x$zj0%k^w9")) for _ in range(7)) for _ in range(200))
    docs = [(i, "en", t) for i, t in enumerate(good)] + [(1000, "en", junk), (1001, "en", None), (1002, None, ""), (1003, None, "漢字 " * 60), (None, "xx", good[0]), (0, "en", good[0])]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumn("id", F.lit("clash")).withColumn("n", F.lit(0))
    got = quality(df).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got}
    assert not by_id[1000].base_failed and not by_id[1000].kept
    assert by_id[1001].base_failed and by_id[1001].perplexity is None and by_id[1002].base_failed and by_id[1003].n_repeat_words == 60
    assert quality(df.limit(0)).collect() == []


def test_characters_of_a_shared_class_are_told_apart(spark):
    """Letters of other scripts that share a class have probabilities of their own: the texts of the last row were all one to the classes."""
    letters = [chr(0x430 + k) for k in range(32)] + [chr(0x4E00 + 7 * k) for k in range(60)]
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(letters + [" "] * 20, 400)) + "!" for _ in range(80)]
    other = {c: chr(0x6000 + 23 * k + (ord(c) - 0x6000) % 23) for k, c in enumerate(letters)}
    swapped = "".join(other.get(c, c) for c in texts[0])
    assert (classes(swapped) == classes(texts[0])).all() and not set(swapped) & set(letters)
    df = spark.createDataFrame([(i, "zz", t) for i, t in enumerate([*texts, swapped])], "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in quality(df).collect()}
    assert got[80].perplexity > 5 * got[0].perplexity
    got = quality(df, min_words=1, max_repeat_percent=100).collect()
    assert all(r.kept == (r.doc_id < 80) for r in got)


def test_characters_are_a_distribution_within_each_class():
    texts = ["абв漢字, (x)! \U0001F600 ?" * 9, "где [y]. 漢 ¿"]
    at, codes = shared_characters(texts)
    assert "".join(map(chr, codes)) == "".join(c for c in "".join(texts) if classes(c)[0] >= 30)
    assert ["".join(texts)[i] for i in at] == list(map(chr, codes))
    table = Characters(*np.unique(codes, return_counts=True))
    every = np.arange(0x110000, dtype=np.uint32)
    of = classes_of(every)
    total = np.bincount(of, np.exp(table.logp(every).astype(float)), 64)
    assert np.allclose(total[30:][np.bincount(of, minlength=64)[30:] > 0], 1, atol=1e-4)
    many, few, none = table.logp(np.array([ord("漢"), 0x1F600, 0x5DDD], np.uint32))
    assert many > none and few > none


def test_counts_hold_every_shared_character(spark):
    docs = [(1, "en", "漢字 漢!"), (2, "en", "漢\U0001F600?")]
    got = gram_counts(spark.createDataFrame(docs, "doc_id long, lang string, text string"), "lang", "text").filter("gram < 0").collect()
    have = Counter()
    for r in got:
        have[chr(-1 - r.gram)] += r.n
    assert have == Counter("漢字漢!漢\U0001F600?")


def plain_grams(texts):
    """Four code points (plus one, zero before the start) by their count."""
    out = Counter()
    for t in texts:
        x = [0, 0, 0, *(code_points(t) + 1).tolist()]
        out.update(tuple(x[i:i + 4]) for i in range(len(x) - 3))
    return out


def plain_model(texts):
    """Interpolated modified Kneser-Ney over exact characters on top of the class model, in dictionaries."""
    levels = [plain_grams(texts)]
    while len(next(iter(levels[0]))) > 2:
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    weights = []
    for level in levels:
        d = [0, *discounts(np.array(list(level.values())))]
        total, left = Counter(), Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3)]
        weights.append((level, d, total, left))
    gram, n = np.unique(keys(texts)[0], return_counts=True)
    base = Model(gram, n)
    singles = Characters(*np.unique(shared_characters(texts)[1], return_counts=True))
    every = code_points("".join(texts))
    forms = Characters(*np.unique(every[classes_of(every) < 30], return_counts=True))

    def logp(g):
        of = [0 if x == 0 else int(classes_of(np.array([x - 1]))[0]) for x in g]
        inner = float(base.logp(np.array([of[0] << 18 | of[1] << 12 | of[2] << 6 | of[3]], np.uint32))[0])
        form = float((singles if of[3] >= 30 else forms).logp(np.array([g[3] - 1]))[0])
        inner += form if of[3] >= 30 else 0
        p = np.exp(inner + (0 if of[3] >= 30 else form))
        for k, (level, d, total, left) in enumerate(weights, 2):
            own = g[4 - k:]
            if total[own[:-1]]:
                p = (level[own] - d[min(level[own], 3)] + left[own[:-1]] * p) / total[own[:-1]]
        return np.log(p), inner
    return logp


def odd_texts():
    rng = np.random.default_rng(9)
    letters = list("aAàÀbBeéEst ., \n|%漢字абв\U0001F600\U0001F601\x00\U0010FFFF")
    return ["".join(rng.choice(letters, int(rng.integers(1, 300)))) for _ in range(60)] + ["", "a", "a", "\x00"]


def test_scores_equal_a_plain_model_whatever_is_broadcast(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)] + [(100, "xx", "lone fold"), (101, "xx", None)], "doc_id long, lang string, text string")
    folds = {r.doc_id: r.f for r in df.select("doc_id", fold("text").alias("f")).collect()}
    models = {f: plain_model([t for i, t in enumerate(texts) if t and folds[i] == f]) for f in "01"}
    for held in (2_000_000, 700, 0):
        got = {r.id: r for r in scored(df.filter("lang = 'en'"), "doc_id", "lang", "text", held).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            if not t:
                assert got[i].log_perplexity is None and got[i].class_log_perplexity is None
                continue
            each = [(n, models["10"[int(folds[i])]](g)) for g, n in plain_grams([t]).items()]
            for k, have in enumerate((got[i].log_perplexity, got[i].class_log_perplexity)):
                assert abs(have + sum(n * x[k] for n, x in each) / len(t)) < 1e-4
    lone = {r.id: r for r in scored(df, "doc_id", "lang", "text").collect()}
    assert lone[100].log_perplexity > 0 and lone[101].log_perplexity is None
    assert scored(df.limit(0), "doc_id", "lang", "text").collect() == []


def test_chain_leaves_a_distribution(spark):
    """Shares of a context's n-grams and what is left add up to one, seen or not."""
    texts = [t for t in odd_texts() if t]
    df = spark.createDataFrame([("=en", t) for t in texts], "lang string, text string")
    grams = counted(df)
    assert {tuple(int(x) for x in g): n for g, n in ((np.ravel(letters_of(np.array([r.high]), np.array([r.low]))), r.n) for r in grams.collect())} == plain_grams(texts)
    letters = sorted({g[3] for g in plain_grams(texts)})
    some = [0, 0, texts[0] and ord(texts[0][0]) + 1], [1, 2, 3]
    wanted = [("=en", a << 21 | b, c << 21 | d) for a, b, c in some for d in letters]
    both = grams.selectExpr("lang", "'0' model", "high", "low", "n", "0L want").unionByName(
        spark.createDataFrame(wanted, "lang string, high long, low long").selectExpr("lang", "'0' model", "high", "low", "0L n", "1L want"))
    got = chain(both.groupBy("lang", "model", "high", "low").agg(F.sum("n").alias("n"), F.sum("want").alias("want"))).collect()
    for a, b, c in some:
        own = [r for r in got if r.high == a << 21 | b and r.low >> 21 == c]
        assert len(own) == len(letters) and len({round(r.rest, 12) for r in own}) == 1
        assert abs(sum(r.share for r in own) + own[0].rest - 1) < 1e-9


def test_any_number_of_characters():
    every = "".join(chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000)
    texts = [every[:120_000], every[100_000:200_000], "abc abc"]
    high, low, n = gram_counts_of(texts)
    have = dict(zip(zip(*(x.tolist() for x in letters_of(high, low))), n.tolist()))
    assert have == plain_grams(texts)
    value = -np.arange(len(n), dtype=np.float32)
    table = Table([("a", "0")], np.zeros(len(n), np.int64), high, low, value)
    assert len(table.alphabet) == 65535 and 0 < table.held < len(n) and table.alphabet.max() <= MASK
    for group in (("a", "0"), ("b", "0")):
        total, lengths, (of, more_high, more_low, times) = table.score(group, texts, table.places())
        assert lengths.tolist() == [len(t) for t in texts]
        at = {g: v for g, v in zip(zip(high.tolist(), low.tolist()), value.tolist())}
        rest = defaultdict(float)
        for i, h, x, k in zip(of.tolist(), more_high.tolist(), more_low.tolist(), times.tolist()):
            rest[i] += at[h, x] * k
        want = [sum(at[a << 21 | b, c << 21 | d] * k for (a, b, c, d), k in plain_grams([t]).items()) for t in texts]
        assert np.allclose(total[:, 0] + [rest[i] for i in range(3)], want)
        assert group[0] == "a" or (total == 0).all()
