import re
from collections import defaultdict

from pyspark.sql import functions as F

from effectloom.llm.queries import QUERIES
from effectloom.llm.substrings import repeated_units, without_repeats

SF = "/root/testdata/sf0.001"


def brute(docs, least=20):
    """{(id, position, begin, end): rank of the earliest equal unit} of units in stretches of repeats with enough words."""
    seen, units = defaultdict(list), []
    for at, (i, t) in enumerate(docs):
        own = []
        for m in re.finditer(r"(?:[^\n.!?]|[.!?](?! ))+(?:[.!?](?= ))?|[.!?](?= )", t or ""):
            words = m[0].split()
            if words:
                begin = m.start() + (m[0][:1] == " " and m.start() > 0 and t[m.start() - 1] in ".!?")
                rank = (i is None, i or 0, len(own), at, begin, m.end())
                seen[" ".join(words).lower()].append(rank)
                own.append((rank, " ".join(words).lower(), len(words), (i, at, begin, m.end())))
        units.append(own)
    first = {u: min(ranks) for u, ranks in seen.items()}
    out = {}
    for own in units:
        stretch = []
        for unit in [*own, None]:
            if unit and unit[0] != first[unit[1]]:
                stretch.append(unit)
                continue
            if sum(n for _, _, n, _ in stretch) >= least:
                out |= {place: first[u] for _, u, _, place in stretch}
            stretch = []
    return out


def test_whole_table_and_cut_texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in rows.collect()]
    want = brute(docs)
    got = QUERIES["op1_substrings"](spark, SF).collect()
    assert {(r.doc_id, r.begin, r.end, r.kept_doc_id, r.kept_begin) for r in got} == {(i, b, e, first[1], first[4]) for (i, _, b, e), first in want.items()}
    assert len(got) == len(want) > 0
    text = dict(docs)
    for r in without_repeats(rows).collect():
        whole, at, kept = text[r.doc_id], 0, []
        for s in r.removed:
            kept.append(whole[at:s.begin])
            at = s.end
        assert r.text == "".join(kept) + whole[at:]
        assert {(s.begin, s.end) for s in r.removed} == {(b, e) for i, _, b, e in want if i == r.doc_id}


def test_passage_inside_other_lines_and_odd_rows(spark):
    passage = "Alpha beta gamma delta epsilon zeta eta. Theta iota kappa lambda mu nu xi omicron. Pi rho sigma tau upsilon phi chi psi omega."
    docs = [(3, f"one two {passage} three four\nfive"), (1, f"x {passage}\n\nshort line here"), (2, "short line here"), (None, passage.upper()), (4, None), (5, ""),
            (6, "a b c d e f\na  b c d E f"), (6, "a b c d e f"), (7, "word " * 20000),
            (8, "short line here\nno\n" + "yes it is\n\n" * 9), (9, "short line here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("high", F.lit(1))
    got = repeated_units(df).collect()
    # a line that recurs alone stays; so do short repeats within a text, but not eight in a row of three words
    assert {(r.doc_id, r.kept_doc_id) for r in got} == {(8, 8)}
    assert {(r.doc_id, r.kept_doc_id) for r in repeated_units(df, 16).collect()} == {(3, 1), (None, 1), (8, 8)}
    assert [r.stretch_words for r in got if r.doc_id == 8] == [24] * 8
    assert {(r.doc_id, r.kept_doc_id) for r in repeated_units(df, 6).collect()} == {(3, 1), (None, 1), (6, 6), (8, 8)}
    text = dict(docs)
    assert [text[3][r.begin:r.end] for r in sorted(repeated_units(df, 6).collect(), key=lambda r: r.begin) if r.doc_id == 3][0].startswith("Theta iota")
    assert repeated_units(df.limit(0)).collect() == [] and without_repeats(df).count() == len(docs)
