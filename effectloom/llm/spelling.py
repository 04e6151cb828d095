"""Spelling variants: words one edit apart, found by a bit-sliced position index.

The vocabulary is counted over all texts.  For a set of words the index keeps,
for every (position, letter), the set of words with that letter there as bits of
64-bit integers.  A query word is read letter by letter; after each letter the
word-parallel recurrences hold the words that agree without error and those that
agree after one replacement, one extra or one missing letter (the last two look
at the index one position behind or ahead).  Many queries advance at once.

Only words that can be one edit apart meet.  The edit lies in a window of the
shorter word, and all outside the window is equal, so window and rest are a key.
A window is cut in two halves as long as its key holds more than `limit` words;
a window of one letter leaves at most one or two letters open, so the words of
its key are bounded by the alphabet.  Keys are dealt by hash, and a task reads
them in runs of `chunk` words.

A word's form is its near word of largest count (ties: smallest), if that count
is at least `ratio` times its own; its root is found by pointer doubling, as
counts grow along forms and no cycle exists.

null texts: no words.  Empty texts, repeated rows and null ids count like any
other text; an empty table gives an empty result.  Very long words cost time in
proportion to their length.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NEAR = "word string, near string, near_n long"


def planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199) -> DataFrame:
    """(word): every letter run in lower case, one letter deleted where `every` divides the checksum of id and run; a null id deletes nothing."""
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(
        F.translate(F.col(text_col), UPPER, UPPER.lower()), F.lit(RUN), F.lit(0))).alias("run"))
    check = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod(check, F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(check % every == 0, cut).otherwise(F.col("run")).alias("word"))


class PositionIndex:
    """(position, letter) bitsets of a list of distinct words."""

    def __init__(self, words: list[str]):
        self.n, self.width = len(words), -(-len(words) // 64)
        self.length = np.array([len(w) for w in words])
        self.depth = int(self.length.max(initial=0))
        self.points = np.zeros((self.n, self.depth), np.uint32)
        self.points[np.arange(self.depth) < self.length[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        self.letters = np.unique(self.points)
        codes = np.searchsorted(self.letters, self.points)
        self.bits = np.zeros((self.depth, len(self.letters), self.width), np.uint64)
        for at in range(self.depth):
            self.bits[at] = self.pack(codes[:, at] == np.arange(len(self.letters))[:, None])
        self.none = np.zeros((1, self.width), np.uint64)

    def pack(self, flags: np.ndarray) -> np.ndarray:
        room = np.zeros((*flags.shape[:-1], self.width * 64), bool)
        room[..., :self.n] = flags
        return np.packbits(room, axis=-1, bitorder="little").view(np.uint64)

    def of_length(self, n: int) -> np.ndarray:
        return self.pack(self.length == n)

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) places of all pairs one edit apart; asked: places of words of one length."""
        points = self.points[asked]
        n = int(self.length[asked[0]])
        codes = np.searchsorted(self.letters, points)
        equal = np.broadcast_to(~self.none, (len(asked), self.width))
        replaced = extra = np.zeros_like(equal)
        missing = equal
        for at in range(n):
            here = self.bits[at][codes[:, at]]
            ahead = self.bits[at + 1][codes[:, at]] if at + 1 < self.depth else self.none
            back = self.bits[at - 1][codes[:, at]] if at else self.none
            replaced = replaced & here | equal & ~here
            extra = extra & back | equal
            equal = equal & here
            missing = missing & ahead | equal
        found = replaced & self.of_length(n) | extra & self.of_length(n - 1) | missing & self.of_length(n + 1)
        q, v = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, :self.n])
        return asked[q], v


def one_edit_pairs(words: list[str], cells: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Places of all ordered pairs of distinct words that are one edit apart."""
    index = PositionIndex(words)
    step = max(1, cells // max(1, index.width))
    out = [(np.empty(0, int), np.empty(0, int))]
    for n in np.unique(index.length):
        own = np.nonzero(index.length == n)[0]
        out += [index.near(own[i:i + step]) for i in range(0, len(own), step)]
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def keyed(rows: DataFrame) -> DataFrame:
    """rows (word, n, short, at, open) with the hash of all that is outside the window [at, at + open)."""
    rest = F.substring(F.col("word"), F.col("at") + F.col("open") + F.length("word") - F.col("short") + 1, F.length("word"))
    return rows.withColumn("key", F.xxhash64("short", "at", "open", F.substring(F.col("word"), F.lit(1), F.col("at")), rest))


def halved(rows: DataFrame) -> DataFrame:
    """Each window as its two halves."""
    half = F.floor(F.col("open") / 2).cast("int")

    def part(at: Column, size: Column) -> Column:
        return F.struct(at.alias("at"), size.alias("open"))

    both = F.explode(F.array(part(F.col("at"), half), part(F.col("at") + half, F.col("open") - half)))
    return keyed(rows.select("word", "n", "short", both.alias("part")).select("word", "n", "short", "part.at", "part.open"))


def groups(vocabulary: DataFrame, limit: int) -> DataFrame:
    """(short, key, word, n): any two words one edit apart share a key of at most limit words, or of a one-letter window."""
    size = F.length("word")
    whole = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("short")).select(
        "word", "n", "short", F.lit(0).alias("at"), F.col("short").alias("open")).filter("open > 1")
    rows, ready = staged(halved(whole), "windows"), None
    while True:
        crowd = staged(rows.groupBy("key").count().filter(F.col("count") > limit).select("key"), "crowded-windows")
        last = crowd.isEmpty()
        done = rows if last else rows.filter("open = 1").unionByName(rows.filter("open > 1").join(crowd, "key", "left_anti").select(*rows.columns))
        ready = done if ready is None else ready.unionByName(done)
        if last:
            return ready.select("short", "key", "word", "n")
        rows = staged(halved(rows.filter("open > 1").join(crowd, "key", "left_semi")), "windows")


def near_words(vocabulary: DataFrame, limit: int = 4096, chunk: int = 4096) -> DataFrame:
    """(word, near, near_n): each ordered pair of words one edit apart, once.  vocabulary: (word, n), words distinct, of two or more letters."""

    def search(batches):
        short = key = n = np.empty(0, np.int64)
        word = np.empty(0, object)
        for b in batches:
            short = np.concatenate([short, b.column(0).to_numpy()])
            key = np.concatenate([key, b.column(1).to_numpy()])
            word = np.concatenate([word, np.array(b.column(2).to_pylist() + [None], object)[:-1]])
            n = np.concatenate([n, b.column(3).to_numpy()])
            first = np.nonzero(np.diff(key, prepend=key[0] - 1) != 0)[0] if len(key) else np.empty(0, int)
            done = 0
            for cut in first[1:].tolist():  # the last key may go on in the next batch
                if cut - done >= chunk or short[cut] != short[done]:
                    yield from compare(key[done:cut], word[done:cut], n[done:cut])
                    done = cut
            short, key, word, n = short[done:], key[done:], word[done:], n[done:]
        if len(key):
            yield from compare(key, word, n)

    def compare(key, word, n):
        _, of, times = np.unique(key, return_inverse=True, return_counts=True)
        word, place = np.unique(word[times[of] > 1].astype(object), return_index=True)
        n = n[times[of] > 1][place]
        if len(word) > 1:
            a, b = one_edit_pairs(word.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(word[a], pa.string()), pa.array(word[b], pa.string()), pa.array(n[b])], names=["word", "near", "near_n"])

    dealt = groups(vocabulary, limit).withColumn("short", F.col("short").cast("long")).repartition("key").sortWithinPartitions("short", "key")
    # dealt by word once; neither the removal of repeats nor the later grouping by word moves rows again
    return dealt.mapInArrow(search, NEAR).repartition("word").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) by pointer doubling: words without a form are their own root."""
    at = staged(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        further = staged(at.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        if further.filter("moved").isEmpty():
            return forms.join(further.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
        at = further.select("word", "root")


def variants(words: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, limit: int = 4096, chunk: int = 4096) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least min_length letters and min_count occurrences."""
    vocabulary = staged(words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count), "vocabulary")
    best = near_words(vocabulary, limit, chunk).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    strong = F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    judged = staged(vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), strong.alias("to")).select("word", "n", "n_near", "to.form", "to.form_n"), "spellings")
    return roots(judged).select("word", "form", "root", "n", "n_near", "form_n")
