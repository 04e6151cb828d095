import random

import pytest
from pyspark.sql import functions as F

from effectloom.llm.common import tokenizer_path
from effectloom.llm.queries import QUERIES
from effectloom.llm.token_counts import PartCounts, PieceCounter, token_counts

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))


def want(rows, library, limit=4096):
    ids = library.encode([t or "" for _, t in rows], num_threads=1)
    return sorted(((d, len((t or "").encode()), len(i), len(i) > limit) for (d, t), i in zip(rows, ids)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect()), key=str)


def test_whole_table(spark, library):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        assert result(QUERIES["op10_token_counts"](spark, sf)) == want(rows, library)


def test_strings_equal_the_library(library):
    rng = random.Random(8)
    alphabets = ("ab' \n\t.1é漢 s▁", "aeinrst  ", "<s></s><unk>  ​　", "éßŉ𝒳ªﬁ①ｱ́ m", "0123456789,. -", "\x00\x01\x7f a﻿")
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 40))) for a in alphabets for _ in range(1500)]
    counter = PieceCounter(tokenizer_path(MODEL))
    assert [counter(t) for t in texts] == [len(i) for i in library.encode(texts, num_threads=1)]


def test_merges_by_hand():
    """Lowest rank first, leftmost of equal ones; characters outside the vocabulary are bytes."""
    ranks = {p: i for i, p in enumerate(["ab", "bc", "abc", "aa", "a", "b", "c"])}
    counts = PartCounts(ranks)
    assert [counts.count(t) for t in ("abc", "bcab", "aaa", "aaaa", "abab", "a", "")] == [1, 2, 2, 2, 2, 1, 0]
    assert counts.count("é") == 2 and counts.count("aéb") == 4
    small = PartCounts(ranks, limit=2)  # the cache only changes speed
    assert [small[t] for t in ("abc", "bcab", "aaa", "abc")] == [1, 2, 2, 1]


def test_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, " "), (None, "no id"), (4, "word " * 5000), (5, "</s><s> <unk>"), (6, "a" * 200_000), (7, "same"), (7, "same"), (8, "ab cd " * 170_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("n_tokens", F.lit(1))
    assert result(token_counts(df)) == want(rows, library)
    assert token_counts(df, limit=0).filter("over_limit").count() == 8
    assert token_counts(df.limit(0)).collect() == []
