import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from effectloom.llm.queries import QUERIES
from effectloom.llm.spelling import near_words, one_edit_pairs, planted_runs, roots, variants

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else (a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:])


def runs_of(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return out


def brute(counts, min_length=6, min_count=5, ratio=5):
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    shapes, near = defaultdict(set), defaultdict(set)  # by deleted letter: another way to the same pairs
    for w in words:
        for s in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            shapes[s].add(w)
    for some in shapes.values():
        for a in some:
            near[a].update(b for b in some if one_edit(a, b))
    form = {}
    for w, n in words.items():
        best = min(((-words[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n else None
    out = set()
    for w, n in words.items():
        top = w
        while form[top]:
            top = form[top]
        out.add((w, form[w], top, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def result(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_whole_table(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        assert result(QUERIES["op13_spelling"](spark, sf)) == brute(runs_of(rows))


def test_index_finds_every_pair():
    rng = random.Random(1)
    for letters, sizes in (("ab", (1, 6)), ("abcé", (2, 9)), ("xy", (60, 70))):
        words = sorted({"".join(rng.choices(letters, k=rng.randint(*sizes))) for _ in range(300)})
        words = sorted({*words, *(w[:3] + w[4:] for w in words[:50] if len(w) > 4)})
        a, b = one_edit_pairs(words, cells=64)
        assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if one_edit(x, y)}


def test_crowded_keys_are_cut(spark):
    """Half of the words share one first half: its windows are halved until small, and no pair is lost."""
    rng = random.Random(2)
    words = {"spelling" + "".join(rng.choices("abc", k=rng.randint(6, 9))) for _ in range(400)} | {"".join(rng.choices("abcd", k=8)) for _ in range(400)}
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    for limit, chunk in ((4096, 4096), (5, 16), (1, 1)):
        got = [(r.word, r.near, r.near_n) for r in near_words(df, limit, chunk).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b, len(b)) for a in words for b in words if one_edit(a, b)}


def test_roots_follow_long_chains(spark):
    chain = [(str(i), str(i + 1)) for i in range(21)] + [("21", None), ("x", None)]
    got = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {str(i): "21" for i in range(22)} | {"x": "x"}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Grüßen grüßen Überall"), (3, "grüßen " * 30 + "grußen " * 5), (3, "grüßen " * 30), (4, "b" * 30_000 + " " + "b" * 29_999)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("id", F.lit("y"))
    got = result(variants(planted_runs(df)))
    assert got == brute(runs_of(rows))
    assert any(w == "grußen" and form == "grüßen" for w, form, *_ in got) and any(len(w) > 29_000 and near == 1 for w, _, _, _, near, _ in got)
    assert variants(planted_runs(df.limit(0))).collect() == []
