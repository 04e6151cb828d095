"""Each stage against a plain Python version on its own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as P
from pyspark.sql import functions as F
from test_quality import brute as features
from test_simhash import components, fingerprint

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages_and_run(spark, tmp_path):
    from tokenizers import Tokenizer

    from effectloom.llm.common import tokenizer_path
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), []
    docs = docs.withColumn("n_chars", F.col("n_chars"))
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        held = rows(docs)
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out = rows(docs)
        if name == "quality_rules":
            clear = [r for r in held if not (features(r[1])[0] < 50 or 100 * features(r[1])[4] > 50 * features(r[1])[0])]
            assert set(out) <= set(clear) and len(out) >= 0.9 * len(clear)
        elif name == "near_dedup":
            root = components([fingerprint(r[1]) for r in held])
            groups = defaultdict(list)
            for r, g in zip(held, root):
                groups[g].append(r)
            assert len(out) == len(groups) and {min(g)[0] for g in groups.values()} == {r[0] for r in out}
        elif name == "secret_scans":
            was = {r[0]: r[1] for r in held}
            assert [r[0] for r in sorted(out)] == sorted(was)
            for r in out:
                assert r[4] == len(r[1]) and not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r[1])
                assert r[1] == was[r[0]] or "[secret]" in r[1]
        else:
            sizes = Counter()
            for r in held:
                sizes[r[3]] += len(WORD.findall(r[1]))
            took = Counter()
            for r in out:
                took[r[3]] += len(WORD.findall(r[1]))
            assert abs(sum(took.values()) - 1.5 * sum(sizes.values())) < 0.1 * sum(sizes.values())
            assert max(Counter(r[0] for r in out).values()) <= 2
    packed = P.run(spark, SF).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    lengths = {r[0]: len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows(docs)}
    times = Counter(r[0] for r in rows(docs))
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == {d: n * times[d] for d, n in lengths.items()}


def test_empty_and_odd_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None, 0), (1, "", "en", "a", 0), (None, "w " * 60, "en", "a", 120), (2, "x y z " * 100, "en", None, 600)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in P.STAGES:
            assert stage(spark, df, SF).count() >= 0


def test_quality_rules_tell_characters_of_a_class_apart(spark):
    """A text of characters that only share their classes with those of its language goes."""
    import numpy as np
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(chr(0x4E00 + 7 * k) for k in rng.integers(0, 60, 3)) for _ in range(80)) for _ in range(61)]
    odd = "".join(c if c == " " else chr(ord(c) + 23 * 80) for c in texts.pop())
    docs = spark.createDataFrame([(i, t, "zz", "s", len(t)) for i, t in enumerate([*texts, odd])], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.quality_rules(spark, docs, SF).collect()) == list(range(60))


def test_quality_rules_tell_the_order_of_characters_of_one_class(spark):
    """Words of letters of one class: with their letters in another order the text is the same to the classes, but goes."""
    import numpy as np
    rng = np.random.default_rng(11)
    letters = np.array([chr(0x4E00 + 23 * k) for k in range(60)])
    words = ["".join(w) for w in rng.permutation(letters).reshape(20, 3)]
    texts = [" ".join(rng.choice(words, 150)) for _ in range(61)]
    last = texts.pop()
    mixed = iter(rng.permutation(list(last.replace(" ", ""))))
    odd = "".join(c if c == " " else next(mixed) for c in last)
    docs = spark.createDataFrame([(i, t, "zz", "s", len(t)) for i, t in enumerate([*texts, last, odd])], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.quality_rules(spark, docs, SF).collect()) == list(range(61))
