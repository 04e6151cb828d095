"""Periodic runs of words, found online by dyadic square catching.

Words are appended one by one.  Whenever an aligned block of 2^k words is
complete it becomes a catcher: it waits for its own content to come back at a
distance q between 2^(k+1) and 2^(k+2) (below 8 for the shortest, k = 1).  Any
stretch of two periods q holds such a block whole in its first period, so every
square is caught.  Contents are compared by names, two halves giving the name of
the whole, so a suffix of 2^k words has a name only if its second half has one:
most words end their climb through k at once.

A caught return fixes the period q.  The match is followed back once, and the
place where the square will be complete is noted; there the rest is compared, and
if it holds, a run of period q is open.  Every further word either extends an
open run or closes it.  Squares that fall into an open run whose period divides
theirs add nothing.  Runs of equal extent merge, the smallest period stays.

A run is a stretch with smallest period q that neither neighbour extends, of at
least max(least, 2 q) words (least is 5 or more, as shorter ones may hold no
whole block of two in their first period); words behind its first period are dropped.

null texts count as empty: no words, no runs.  Rows are independent, so repeated
rows, ties and null ids pass through; an empty table gives an empty result.  A
text is one task's work; memory is in proportion to its words.  Other columns
are not read.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORD, rows

RESULT = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Level:
    """Completed blocks of one size: the name of a pair of halves, where blocks of a name begin, and the names of suffixes by end."""
    __slots__ = ("size", "low", "high", "names", "begins", "blocks", "suffix")

    def __init__(self, k: int):
        self.size, self.low, self.high = 1 << k, 1 << (k + 1) if k > 1 else 1, 1 << (k + 2)
        self.names: dict[tuple[int, int], int] = {}
        self.begins: list[list[int]] = []
        self.blocks: list[int] = []
        self.suffix: dict[int, int] = {}


class SquareCatcher:
    """Runs of an online sequence of numbered words; `runs` holds (start, end) -> period of what is closed."""

    def __init__(self, least: int = 12):
        if least < 5:
            raise ValueError("runs of fewer than five words are not looked for")
        self.least = least
        self.words = array("I")
        self.levels = [Level(1)]
        self.open: dict[int, int] = {}  # period -> start of the run that the last word belongs to
        self.noted: dict[int, list[int]] = {}  # place of the last word of a square -> its periods
        self.waiting: dict[int, int] = {}  # period -> place where its noted square will be complete
        self.runs: dict[tuple[int, int], int] = {}

    def extend(self, words: array) -> None:
        names, seen = self.levels[0].names, self.words
        last = seen[-1] if seen else None
        for word in words:
            i = len(seen)
            seen.append(word)
            if self.open:
                for q in [q for q in self.open if seen[i - q] != word]:
                    self.close(q, i)
            if self.noted and (periods := self.noted.pop(i, None)):
                for q in periods:
                    self.complete(q, i)
            if last is not None:
                if (name := names.get((last, word))) is not None:
                    self.climb(name, i)
                if i & 1:
                    self.block(name, last, word, i)
            last = word

    def block(self, name: int | None, left: int, right: int, i: int) -> None:
        """The block of two words that ends at i is complete, and with it larger ones."""
        at = 0
        while True:
            if at == len(self.levels):
                self.levels.append(Level(at + 1))
            level = self.levels[at]
            if name is None and (name := level.names.get((left, right))) is None:
                name = level.names[left, right] = len(level.begins)
                level.begins.append([])
            level.begins[name].append(i + 1 - level.size)
            level.blocks.append(name)
            if (i + 1) % (2 * level.size):
                return
            left, right, name = *level.blocks[-2:], None
            at += 1

    def climb(self, name: int, i: int) -> None:
        """The last two words are a block seen before: see what larger suffixes are, and which catchers they meet."""
        for at, level in enumerate(self.levels):
            if at:
                before = self.levels[at - 1].suffix.get(i - level.size // 2)
                if before is None or (name := level.names.get((before, name))) is None:
                    return
            level.suffix[i] = name
            begin = i + 1 - level.size
            for b in reversed(level.begins[name]):
                q = begin - b
                if q >= level.high:
                    break
                if q >= level.low and q not in self.open and self.waiting.get(q, 0) <= i and not self.within(q, b):
                    self.catch(q, b, i)

    def within(self, q: int, b: int) -> bool:
        """Whether b lies in an open run whose period divides q."""
        return any(q % p == 0 and s <= b for p, s in self.open.items())

    def back(self, q: int, end: int, most: int) -> int:
        """How many words up to place end (at most `most`) equal those q before."""
        words, n, step = self.words, 0, 8
        most = min(most, end + 1 - q)
        while n < most:
            step = min(step, most - n)
            at = end + 1 - n
            if words[at - step:at] != words[at - step - q:at - q]:
                if step == 1:
                    break
                step = max(1, step // 4)
                if step < 4:
                    while n < most and words[end - n] == words[end - n - q]:
                        n += 1
                    break
            else:
                n += step
                step *= 2
        return n

    def catch(self, q: int, b: int, i: int) -> None:
        """A block came back after q words: note where its square will be complete."""
        have = self.back(q, i, q)
        place = i + q - have
        self.waiting[q] = place
        if place == i:
            self.complete(q, i)
        else:
            self.noted.setdefault(place, []).append(q)

    def complete(self, q: int, i: int) -> None:
        if q not in self.open and self.back(q, i, q) == q:
            self.open[q] = i + 1 - q - self.back(q, i, i + 1)

    def close(self, q: int, end: int) -> None:
        start = self.open.pop(q)
        if end - start >= max(self.least, 2 * q):
            self.runs[start, end] = min(q, self.runs.get((start, end), q))

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, sorted by start, then period."""
        for q in list(self.open):
            self.close(q, len(self.words))
        return sorted(((s, e - s, q) for (s, e), q in self.runs.items()), key=lambda r: (r[0], r[2]))


def runs_of(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    number: dict = {}
    ids = array("I", [number.setdefault(w, len(number)) for w in words])
    if len(number) == len(words) or len(words) < least:
        return []  # no word comes back
    catcher = SquareCatcher(least)
    catcher.extend(ids)
    return catcher.finish()


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """words without those behind the first period of a run."""
    gone = bytearray(len(words))
    for s, n, q in runs:
        gone[s + q:s + n] = b"\x01" * (n - q)
    return [w for w, g in zip(words, gone) if not g] if runs else words


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_runs, the longest run, all runs, and the text without repeated periods."""
    kind = docs.select(id_col).schema[0].dataType
    schema = f"`{id_col}` {kind.simpleString()}, {RESULT}"
    fields = [to_arrow_type(kind), *[pa.int64()] * 6, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]
    names = [id_col, "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]

    def find(batches):
        for ids, texts in rows(batches, "key", "text"):
            out = []
            for key, text in zip(ids, texts):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                runs = runs_of(words, least)
                best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
                out.append((key, len(words), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                            [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), fields)], names=names)

    return docs.selectExpr(f"`{id_col}` AS key", f"`{text_col}` AS text").mapInArrow(find, schema)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): every tenth text, by the checksum of its id, ends in a period of its own words; null ids and texts stay."""
    check = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(F.col("check") / 10)
    n = F.size("words").cast("long")
    base = docs.select(F.col(id_col), F.col(text_col).alias("text"), check.alias("check")).withColumn(
        "words", F.when(F.col("check") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    a = g % n
    cut = base.withColumn("a", F.when(F.col("words").isNotNull() & (n > 0), a)).withColumn(
        "p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("long"))

    def word(i: Column) -> Column:
        return F.element_at("words", (F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")) + 1).cast("int"))

    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")
    return cut.select(id_col, F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of periodic_runs."""
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(id_col, "n_runs", "start", "length", "period", "exponent_milli",
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
