import random
import zlib
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from effectloom.llm.periodic import SquareCatcher, periodic_runs, planted, run_digests, runs_of
from effectloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    """Every period on its own: stretches of equal words q apart; equal stretches keep the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(doc_id, text):
    words = plant(doc_id, (text or "").encode().split())
    runs = brute(words)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest())


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [digest(r.doc_id, r.text) for r in rows]
    assert order(QUERIES["op12_periodic_runs"](spark, SF).collect()) == order(want)
    assert sum(w[1] > 0 for w in want) >= 15


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 7)), max_size=7), st.integers(5, 14))
def test_equals_brute_force(parts, least):
    words = list("".join(x * n for x, n in parts))
    assert runs_of(words, least) == brute(words, least)


def test_structured_words():
    rng = random.Random(5)
    for words in (fibonacci(700), "a" * 500, "a" * 150 + "b" + "a" * 150 + "b" + "a" * 90, "ab" * 100 + "a" + "ab" * 60 + "ba" * 40,
                  "".join(bin(i).count("1") % 2 and "x" or "y" for i in range(512)), "".join(rng.choices("ab", k=900)),
                  ("".join(rng.choices("abcd", k=37)) * 9 + "z") * 3):
        assert runs_of(list(words), 5) == brute(list(words), 5)
        assert runs_of(list(words)) == brute(list(words))


def test_runs_are_reported_online():
    """A run closes with the word that breaks it, whatever follows."""
    catcher, text = SquareCatcher(), [0, 1, 2, 3, 4] * 4 + [9] + [5, 6] * 8 + [7]
    from array import array
    for at, w in enumerate(text):
        catcher.extend(array("I", [w]))
        assert sorted(catcher.runs) == [r for r in [(0, 20), (21, 37)] if r[1] <= at]
    assert catcher.finish() == [(0, 20, 5), (21, 16, 2)] == brute(text)


def test_long_texts_stay_fast():
    words = [i % 50_000 for i in range(400_000)]
    assert runs_of(words) == [(0, 400_000, 50_000)]
    assert runs_of([0] * 100_000) == [(0, 100_000, 1)]
    assert runs_of(([0] * 4000 + [1]) * 2) == [(0, 4000, 1), (0, 8002, 4001), (4001, 4000, 1)]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 30), (5, "x " * 50_000), (6, "Ä ß " * 9 + "q"), (6, "Ä ß " * 9 + "q"), (7, "a b " * 13), (8, "a b c")]
    rows += [(i, "a b c d e f g h i j k l m n o p q r s t u v w x y z") for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("x")).withColumn("key", F.lit(1)).withColumn("check", F.lit(2))
    assert order(run_digests(periodic_runs(planted(df))).collect()) == order([digest(*r) for r in rows if r[0] != 5] + [(
        5, 1, 0, 50_000, 1, 50_000_000, sha256(b"0,50000,1\n").hexdigest(), sha256(b"x").hexdigest())])
    assert run_digests(periodic_runs(planted(df.limit(0)))).collect() == []
