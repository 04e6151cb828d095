"""SimHash near-duplicates by a segment-popcount embedding.

A document's fingerprint is 64 bits over the hashes of its word shingles.  Equal
fingerprints are merged first.  A fingerprint is cut into 32 segments of two
bits, and each segment is replaced by its bit count.  The Manhattan distance of
two count vectors is never above the Hamming distance of the fingerprints, so a
range join on it loses no link.

The join uses overlapping grids.  The segments are dealt into g bands; a pair
within Manhattan distance r differs in at most r bands, so it shares the cell of
some choice of g - r bands.  Counts are stored in unary (0, 1, 11), so the
distance of two vectors is the bit count of their XOR and a cell is a mask.
Pairs of a cell are compared by distance, then by the exact fingerprints.  g is
picked from the number of fingerprints to keep cells small; the result is the
same for any g.  A cell with more than `block`
fingerprints is cut into blocks, and every pair of blocks is a group of its own:
no task holds more than two blocks, and a group reports a spanning forest of its
links, never all pairs.

null text: as empty; a text without words has fingerprint zero and is linked
like any other.  Null or repeated ids keep their rows; a component's id is the
smallest id that is not null.  An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import rows, staged
from .components import stars

SEGMENTS = 32
EVEN = 0x5555555555555555
CHUNK_BYTES = 4_000_000
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words_of(data: bytes):
    """Lists of words of ASCII-lower-cased text, cut between words about every CHUNK_BYTES."""
    at = 0
    while at < len(data):
        cut = SPACE.search(data, at + CHUNK_BYTES) if at + CHUNK_BYTES < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end].lower().split()
        at = end


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes, repeats included."""
    ones, n, last = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in words_of(text.encode("utf-8", "surrogatepass")):
        words = last + words
        if len(words) >= shingle:
            parts = zip(*(words[i:] for i in range(shingle)))
            hashes = np.array([digest(x, seed) for x in map(b" ".join, parts)], np.uint64)
            ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
            n += len(hashes)
        last = words[-(shingle - 1):] if shingle > 1 else []
    if not n:
        return digest(b" ".join(last), seed) if last else 0
    return int(np.packbits(ones * 2 > n).view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per document, fp as a signed 64-bit number."""
    kind = docs.select(id_col).schema[0].dataType
    arrow = to_arrow_type(kind)

    def make(batches):
        for ids, texts in rows(batches, "key", "text"):
            fp = np.array([fingerprint(t or "", shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(fp)], names=["id", "fp"])

    return docs.selectExpr(f"`{id_col}` AS key", f"`{text_col}` AS text").mapInArrow(make, f"id {kind.simpleString()}, fp long")


def grid(n: int, radius: int, block: int = 2048) -> list[int]:
    """Masks of the band choices of one grid for n fingerprints.

    The fewest bands for which a cell is expected to hold at most a block of
    random fingerprints: copies of rows stay few, and comparisons per row bounded.
    """
    g = next((g for g in range(radius + 1, radius + 8) if n * 0.375 ** (SEGMENTS * (g - radius) / g) <= block), radius + 8)
    cuts = [SEGMENTS * i // g for i in range(g + 1)]
    bands = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(bands, g - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def unary_counts(fp: np.ndarray) -> np.ndarray:
    """Bit count of every two-bit segment, in unary within the segment."""
    even = np.uint64(EVEN)
    high = (fp >> np.uint64(1)) & even
    return ((fp & even) | high) | ((fp & even & high) << np.uint64(1))


def spanning_links(group: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within runs of equal group: a forest that connects what the exact links connect."""
    n = len(fp)
    counts, root = unary_counts(fp), np.arange(n)
    out = []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at, step = np.arange(n - 1), 1
    while len(at):
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]  # a run that is too short now stays so
        near = at[np.bitwise_count(counts[at] ^ counts[at + step]) <= radius]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= radius]
        for i in near[root[near] != root[near + step]].tolist():
            a, b = find(i), find(i + step)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, i + step))
        while (root[root] != root).any():
            root = root[root]
        step += 1
    return out


def links(distinct: DataFrame, radius: int = 4, block: int = 2048) -> DataFrame:
    """(a, b) fingerprints that connect all fingerprints within the radius; distinct has (fp)."""
    masks = grid(distinct.count(), radius, block)
    low = F.col("fp").bitwiseAND(F.lit(EVEN))
    high = F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(EVEN))
    counts = low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    cells = distinct.select("fp", counts.alias("counts")).select("fp", F.posexplode(F.transform(
        F.array(*[F.lit(signed(m)) for m in masks]), lambda m: m.bitwiseAND(F.col("counts")))).alias("grid", "cell"))
    crowd = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    together = (cells.join(crowd, ["grid", "cell"]).select("grid", "cell", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
                .select("fp", F.xxhash64("grid", "cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("pair")))

    def compare(batches):
        group = fp = np.empty(0, np.int64)
        for b in batches:
            group = np.concatenate([group, b.column(0).to_numpy()])
            fp = np.concatenate([fp, b.column(1).to_numpy()])
            done = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last run may go on
            if done:
                yield linked(group[:done], fp[:done])
                group, fp = group[done:], fp[done:]
        if len(group):
            yield linked(group, fp)

    def linked(group, fp):
        found = np.array(spanning_links(group, fp.view(np.uint64), radius), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fp[found[:, 0]]), pa.array(fp[found[:, 1]])], names=["a", "b"])

    # two groups that share a hash are compared as one: more pairs, the same links
    return together.select("pair", "fp").repartition("pair").sortWithinPartitions("pair").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id, n_copies (rows with this fingerprint)."""
    prints = staged(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_copies")), "distinct-fingerprints")
    tree = stars(links(distinct.select("fp"), radius))
    member = distinct.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = staged(member.join(named, "root").select("fp", "component_id", "n_copies"), "classes")
    return prints.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")
