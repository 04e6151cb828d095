"""Best-fit packing of token pieces by non-negative least squares.

Tasks tokenise whole documents and cut those longer than a sequence into pieces.
Only the histogram of piece lengths (at most one row per length) reaches the
driver.  There patterns of up to three pieces that fill a sequence exactly are
enumerated, their repeat counts are fitted to the histogram by non-negative
least squares and rounded, and what remains is packed best-fit decreasing, again
on counts.  Tasks then number the pieces of each length and read their sequence
and offset from the plan, whose size is bounded by the number of patterns.

null text: as empty, a piece with the closing id alone.  Null or repeated ids
are kept row by row; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import rows, staged, tokenizer_path

CHUNK_CHARS = 1_000_000
BUCKETS = 256
# Fixed value: the pre-token pattern of byte-level files.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenBytes:
    """Ids of whole texts as unsigned little-endian 32-bit numbers.

    Pairs of a byte-level file merge in order of their ids, so its vocabulary
    serves as ranks for a faster encoder of the same kind.  Texts that hold
    special strings, and those whose white space is too long for its pattern
    search, go to the file's own tokenizer.
    """

    def __init__(self, path: str):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are written as the machine's 32-bit little-endian numbers")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(c): b for b, c in {**{b: 256 + n for n, b in enumerate(sorted(set(range(256)).difference(plain)))}, **{b: b for b in plain}}.items()}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(chars[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.special = re.compile("|".join(map(re.escape, sorted(special)))).search if special else lambda text: None

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]

    def one(self, text: str) -> bytes:
        if not self.special(text):
            try:
                return self.fast(text).tobytes()
            except ValueError:  # the pattern search ran out of stack
                pass
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def token_bytes(name: str) -> TokenBytes:
    return TokenBytes(tokenizer_path(name))


def token_pieces(docs: DataFrame, length: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece; all but the first of a document are full."""
    key = docs.select(id_col).schema[0].dataType
    key_arrow, tail = to_arrow_type(key), np.array([end_id], dtype="<u4").tobytes()

    def chunks(texts):
        begin = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > CHUNK_CHARS:
                yield begin, i + 1
                begin, size = i + 1, 0
        yield begin, len(texts)

    def cut(batches):
        encode = token_bytes(tokenizer)
        for ids, texts in rows(batches, "key", "text"):
            texts = [t or "" for t in texts]
            for a, b in chunks(texts):
                out = []
                for key, data in zip(ids[a:b], encode(texts[a:b])):
                    data += tail
                    n, at, piece = len(data) // 4, 0, 0
                    while at < n:
                        size = length if (n - at) % length == 0 else (n - at) % length
                        out.append((key, piece, at, size, zlib.crc32(data[4 * at:4 * (at + size)])))
                        at, piece = at + size, piece + 1
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], key_arrow), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                        names=["key", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr(f"`{id_col}` AS key", f"`{text_col}` AS text").mapInArrow(
        cut, f"key {key.simpleString()}, piece int, start long, length long, ids_crc32 long")


def patterns(present: np.ndarray, length: int) -> np.ndarray:
    """Rows of up to three of the present lengths, largest first, that fill a sequence; 0 pads."""
    out = [np.array([[length, 0, 0]])] if length in present else []
    has = np.zeros(length + 1, bool)
    has[present] = True
    small = present[present < length]
    a, b = np.meshgrid(small, small, indexing="ij")
    c = length - a - b
    for ok in ((c == 0) & (a >= b), (c > 0) & (a >= b) & (b >= c) & has[np.clip(c, 0, length)]):
        out.append(np.stack([a[ok], b[ok], np.maximum(c[ok], 0)], 1))
    return np.concatenate(out).astype(np.int64)


def fit(pattern: np.ndarray, counts: np.ndarray, weight: np.ndarray, rounds: int = 800) -> np.ndarray:
    """Repeats x >= 0 that minimise |weight (A x - counts)|, by accelerated projected gradients.

    counts and weight are indexed by length; column p of A counts the lengths of pattern p.
    """
    square = weight ** 2
    square[0] = 0.0  # padding

    def used(x):
        return np.bincount(pattern.ravel(), np.repeat(x, 3), minlength=len(counts))

    # the largest eigenvalue of A'WA is at most 3 * the largest weighted number of patterns that share a length
    step = 1.0 / (3.0 * max(1e-9, np.bincount(pattern.ravel(), square[pattern].ravel()).max()))
    x = y = np.zeros(len(pattern))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * ((used(y) - counts) * square)[pattern].sum(1))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def best_fit(counts: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (lengths, repeats) of sequences that hold all of them."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {length: []}
    for size in np.nonzero(counts)[0][::-1].tolist():
        todo = int(counts[size])
        for room in sorted(r for r in bins if r >= size):
            if not todo:
                break
            most, stay, moved = room // size, [], []
            for held, n in bins[room]:
                whole = min(n, todo // most)
                if whole:
                    moved.append((held + (size,) * most, whole))
                    todo, n = todo - whole * most, n - whole
                if n and todo:
                    moved.append((held + (size,) * todo, 1))
                    todo, n = 0, n - 1
                if n:
                    stay.append((held, n))
            bins[room] = stay
            for held, n in moved:
                bins.setdefault(length - sum(held), []).append((held, n))
        per = length // size
        for held, n in (((size,) * per, todo // per), ((size,) * (todo % per), 1)):
            if held and n:
                bins.setdefault(length - sum(held), []).append((held, n))
    return [x for group in bins.values() for x in group]


def plan(counts: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): every counted piece in exactly one place.

    Fitted twice, all lengths alike and by length (long pieces have fewer
    partners); the plan with fewer sequences is taken.
    """
    pattern = patterns(np.nonzero(counts)[0], length)
    plans = [rounded(pattern, fit(pattern, counts.astype(float), weight), counts, length)
             for weight in (np.ones(length + 1), np.arange(length + 1) / length)] if len(pattern) else [best_fit(counts, length)]
    return min(plans, key=lambda p: sum(n for _, n in p))


def rounded(pattern: np.ndarray, x: np.ndarray, counts: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Repeats rounded down, most repeated first, and the residuals packed best-fit."""
    left, repeat = counts.astype(np.int64), np.floor(x).astype(np.int64)
    out: list[tuple[tuple[int, ...], int]] = []
    for p in np.nonzero(repeat)[0][np.argsort(-repeat[repeat > 0], kind="stable")].tolist():
        held = tuple(v for v in pattern[p].tolist() if v)
        n = min(int(repeat[p]), *(int(left[v]) // held.count(v) for v in set(held)))
        if n > 0:
            out.append((held, n))
            for v in held:
                left[v] -= n
    return out + best_fit(left, length)


def runs(packed: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """The plan by length and number within the length: where each run of pieces goes."""
    cursor: dict[int, int] = {}
    found, sequence = [], 0
    for held, n in packed:
        at, places = 0, {}
        for v in held:
            places.setdefault(v, []).append(at)
            at += v
        for v, offsets in places.items():
            found.append((v, cursor.get(v, 0), sequence, offsets))
            cursor[v] = cursor.get(v, 0) + n * len(offsets)
        sequence += n
    found.sort(key=lambda r: r[:2])
    slots = [len(r[3]) for r in found]
    return (np.array([r[0] << 44 | r[1] for r in found], np.int64), np.array([r[2] for r in found], np.int64), np.array(slots, np.int64),
            np.cumsum([0, *slots])[:-1], np.array([o for r in found for o in r[3]], np.int64))


def pack(docs: DataFrame, length: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = staged(token_pieces(docs, length, tokenizer, end_id, id_col, text_col), "pieces").withColumn(
        "bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(BUCKETS)).cast("int"))
    groups = staged(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(length + 1, np.int64)
    for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        counts[r["length"]] = r["n"]
    table = spark.sparkContext.broadcast(runs(plan(counts, length)))  # bounded by the patterns, not by the data
    before = groups.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    number = Window.partitionBy("length", "bucket").orderBy("key", "piece", "start", "ids_crc32")
    numbered = (pieces.withColumn("nth", F.row_number().over(number) - 1)
                .join(before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["length", "bucket"])
                .select("key", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("nth")))
    key = pieces.schema["key"].dataType

    def place(batches):
        first, sequence, slots, at, offsets = table.value
        for b in batches:
            size, nth = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            k = size << 44 | nth
            run = np.searchsorted(first, k, side="right") - 1
            into = k - first[run]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sequence[run] + into // slots[run]), pa.array(offsets[at[run] + into % slots[run]])],
                names=[id_col, *b.schema.names[1:5], "sequence_id", "offset"])

    return numbered.mapInArrow(place, f"`{id_col}` {key.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
