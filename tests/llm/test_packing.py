import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectloom.llm.common import tokenizer_path
from effectloom.llm.packing import TokenBytes, best_fit, pack, plan
from effectloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def check(rows, docs, tokenizer, length=1024):
    """Every document's ids come back whole; sequences are gapless and within the length."""
    want = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t in docs}
    got, seqs = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(got) == set(want)
    for d, ids in want.items():
        at = 0
        for k, r in enumerate(sorted(got[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == length)
            assert zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for places in seqs.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(seqs), -(-sum(map(len, want.values())) // length)


def test_whole_table(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, least = check(QUERIES["op6_pack"](spark, SF).collect(), docs, tokenizer)
    assert used <= least * 1.02 + 1


def test_odd_rows(spark, tokenizer):
    docs = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, " the  end\n\n x "), (5, "word " * 5000), (6, " x\t y"), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("key", F.lit(0))
    check(pack(df).collect(), docs, tokenizer)
    assert pack(df.limit(0)).count() == 0
    twice = pack(df.union(df)).collect()
    assert len(twice) == 2 * len(pack(df).collect()) and len({(r.sequence_id, r.offset) for r in twice}) == len(twice)


def test_token_bytes_equal_the_library(tokenizer):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab' \n\t.1é漢 s") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice("abé漢ªßŉ 𝒳m,.") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [" " * 1_500_000 + "x", "\n" * 1_200_000, "é" * 300_000, "-" * 100_000, "it's <|endoftext|>'ll" * 3, "a" * 200_000]
    mine = TokenBytes(tokenizer_path("byte_bpe_50k.json"))(texts)
    assert mine == [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_plan_holds_every_piece():
    rng = np.random.default_rng(3)
    for counts in (rng.integers(0, 50, 1025), rng.integers(0, 2, 1025), np.eye(1, 1025, 513, dtype=int)[0] * 1000):
        counts[0] = 0
        for packed in (plan(counts, 1024), best_fit(counts, 1024)):
            held = np.zeros(1025, int)
            for lengths, n in packed:
                assert sum(lengths) <= 1024 and n > 0
                for v in lengths:
                    held[v] += n
            assert (held == counts).all()
        assert sum(n for _, n in plan(counts, 1024)) <= sum(n for _, n in best_fit(counts, 1024)) + 1
