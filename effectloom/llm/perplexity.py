"""Character n-gram language model with modified Kneser-Ney smoothing.

An n-gram is four code points, told apart exactly: two integers hold a pair of
them each, 21 bits a code point.  Their counts and probabilities are tables that grow
with the corpus (ngrams.py).  Below pairs of characters stands a model of classes: a
character's probability there is that of its class after the three classes before it,
times its own within the class.  There are 64 classes (letters without case and
accents, digits, spaces, groups of marks, and classes that other signs and scripts
share), so the class model of a language has at most 2**24 keys; it is built from the
counts of the n-grams and held as sorted arrays, searched by bisection.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

BITS, ORDER = 6, 4
CLASSES = 1 << BITS
POINT = 21  # a code point plus one; 0 is the start of a text
MASK = (1 << POINT) - 1
SHARED = 30  # classes from here on hold several characters; the others one letter, digit or space up to its form
MARK_GROUPS = [".", ",", "!?", "-_", "\"'`", "()[]{}", ":;", "/\\", "#*$%&|<>", "=+@^~"]


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every character of the basic plane; 0 is the start of a text."""
    out = np.empty(1 << 16, np.uint8)
    marks = {c: 30 + k for k, group in enumerate(MARK_GROUPS) for c in group}
    for code in range(1 << 16):
        c = chr(code)
        base = c if 0xD800 <= code < 0xE000 else unicodedata.normalize("NFD", c)[0].lower()
        kind = unicodedata.category(c)
        if "a" <= base <= "z":
            out[code] = 1 + ord(base) - ord("a")
        elif c == "\n":
            out[code] = 28
        elif c.isspace():
            out[code] = 27
        elif kind == "Nd":
            out[code] = 29
        elif c in marks:
            out[code] = marks[c]
        else:
            out[code] = 40 if kind[0] in "PSC" else 41 + code % 23
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes_of(codes: np.ndarray) -> np.ndarray:
    return class_table()[np.where(codes < 1 << 16, codes, 0x4E00 + codes % 23)]


def classes(text: str) -> np.ndarray:
    return classes_of(code_points(text))


@lru_cache(maxsize=1)
def class_sizes() -> np.ndarray:
    """Code points of every class."""
    return np.bincount(classes_of(np.arange(0x110000, dtype=np.uint32)), minlength=CLASSES)


def shared_characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Place in the joined texts and code point of each character of a shared class."""
    codes = code_points("".join(texts))
    at = np.nonzero(classes_of(codes) >= SHARED)[0]
    return at, codes[at]


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts joined, each after ORDER - 1 zeros; which places are not such zeros; and each part's length."""
    lengths = np.array([len(p) for p in parts], np.int64)
    pad = ORDER - 1
    flat = np.zeros(int(lengths.sum()) + pad * len(parts), np.uint32)
    keep = np.ones(len(flat), bool)
    at = 0
    for p in parts:
        keep[at:at + pad] = False
        flat[at + pad:at + pad + len(p)] = p
        at += pad + len(p)
    return flat, keep, lengths


def packed(flat: np.ndarray, bits: int) -> np.ndarray:
    """One key per place: its value and the three before it, bits each."""
    key = flat.copy()
    for back in range(1, ORDER):
        key[back:] |= flat[:-back] << key.dtype.type(bits * back)
    return key


def keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One key per character of the texts (its class and the three before it), and each text's length."""
    flat, keep, lengths = padded([classes(t) for t in texts])
    return packed(flat, BITS)[keep], lengths


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return padded([code_points(t) + np.uint32(1) for t in texts])


def grams_at(flat: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at the places: first and last pair of code points."""
    a, b, c, d = (flat[places - back].astype(np.int64) for back in range(ORDER - 1, -1, -1))
    return a << POINT | b, c << POINT | d


def letters_of(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """The four code points (plus one) of each n-gram."""
    return [high >> POINT, high & MASK, low >> POINT, low & MASK]


def key_type(bits: int) -> type:
    return np.uint32 if ORDER * bits <= 32 else np.uint64


def gram_counts_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts and how often each is there."""
    flat, keep, _ = points_of(texts)
    present = np.zeros(MASK + 1, bool)
    present[flat] = True
    used = np.flatnonzero(present)
    bits = max(1, int(len(used) - 1).bit_length())
    if ORDER * bits <= 64:
        # places in the alphabet of these texts make short keys
        key, n = np.unique(packed((np.cumsum(present) - 1)[flat].astype(key_type(bits)), bits)[keep], return_counts=True)
        a, b, c, d = (used[(key >> key.dtype.type(bits * back)) & key.dtype.type((1 << bits) - 1)] for back in range(ORDER - 1, -1, -1))
        return a << POINT | b, c << POINT | d, n
    high, low = grams_at(flat, np.nonzero(keep)[0])
    highs, i = np.unique(high, return_inverse=True)
    lows, j = np.unique(low, return_inverse=True)
    key, n = np.unique(i * len(lows) + j, return_counts=True)
    return highs[key // len(lows)], lows[key % len(lows)], n


def added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of several parts, summed by n-gram."""
    high, low, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((low, high))
    high, low, n = high[order], low[order], n[order]
    first = np.flatnonzero(np.r_[True, (np.diff(high) != 0) | (np.diff(low) != 0)][:len(high)])
    return high[first], low[first], np.add.reduceat(n, first) if len(first) else n


def class_keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The key of classes of each n-gram."""
    out = np.zeros(len(high), np.uint32)
    for letter in letters_of(high, low):
        out = out << np.uint32(BITS) | np.where(letter == 0, 0, classes_of(np.maximum(letter - 1, 0))).astype(np.uint32)
    return out


class Table:
    """Values of n-grams (a column each), as sorted short keys over an alphabet of at most 2**16 - 1 code points by (language, model)."""

    def __init__(self, groups: list[tuple[str, str]], group: np.ndarray, high: np.ndarray, low: np.ndarray, *values: np.ndarray):
        self.width = len(values)
        letters = np.stack(letters_of(high, low)) if len(high) else np.zeros((ORDER, 0), np.int64)
        times = np.bincount(letters.ravel(), minlength=1)
        # the most frequent ones, should there be more; n-grams with others are not held
        self.alphabet = np.sort(np.argsort(-times, kind="stable")[:min(np.count_nonzero(times), (1 << 16) - 1)])
        self.bits = max(1, len(self.alphabet).bit_length())
        place = self.places()[letters]
        inside = (place < len(self.alphabet)).all(axis=0)
        key = np.zeros(letters.shape[1], key_type(self.bits))
        for row in place:
            key = key << key.dtype.type(self.bits) | row
        self.held, self.parts = int(inside.sum()), {}
        for k, g in enumerate(groups):
            some = np.flatnonzero(inside & (group == k))
            some = some[np.argsort(key[some])]
            if len(some):
                self.parts[g] = key[some], np.stack([v[some] for v in values], axis=1)

    def places(self) -> np.ndarray:
        """Place of each code point in the alphabet, behind its end for others."""
        out = np.full(MASK + 1, len(self.alphabet), key_type(self.bits))
        out[self.alphabet] = np.arange(len(self.alphabet))
        return out

    def score(self, group: tuple[str, str], texts: list[str], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Sums of the values over the n-grams held, each text's length, and the n-grams not held: text, high, low and times."""
        flat, keep, lengths = points_of(texts)
        n = int(lengths.sum())
        each, hit = np.zeros((n, self.width)), np.zeros(n, bool)
        if group in self.parts:
            known, values = self.parts[group]
            at, hit = find(known, packed(places[flat], self.bits)[keep])
            each[hit] = values[at[hit]]
        total = np.add.reduceat(each, np.cumsum(lengths) - lengths)
        of = np.repeat(np.arange(len(texts)), lengths)[~hit]
        high, low = grams_at(flat, np.flatnonzero(keep)[~hit])
        order = np.lexsort((low, high, of))
        of, high, low = of[order], high[order], low[order]
        first = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(high) != 0) | (np.diff(low) != 0)][:len(of)])
        return total, lengths, (of[first], high[first], low[first], np.diff(np.r_[first, len(of)]))


@dataclass
class Level:
    """n-grams of one order: sorted keys and log-probabilities; contexts and the log-weight they leave to the lower order."""
    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == wanted


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more."""
    return discounts_by(np.bincount(np.minimum(counts, 5), minlength=6)[1:5])


def discounts_by(times: np.ndarray) -> np.ndarray:
    """The same from how many counts are 1, 2, 3 and 4."""
    n = np.asarray(times, float)
    if (n == 0).any():
        return np.array([0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)])
    return np.clip(d, 0.05, [0.95, 1.95, 2.95])


class Model:
    """Interpolated modified Kneser-Ney over (key, count) of order 4."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        order = np.argsort(key)
        grams = [(key[order].astype(np.uint32), count[order].astype(np.int64))]
        for k in range(ORDER - 1, 0, -1):
            # lower orders count in how many contexts they continue
            low, n = np.unique(grams[0][0] & np.uint32((1 << BITS * k) - 1), return_counts=True)
            grams.insert(0, (low, n.astype(np.int64)))
        self.levels: list[Level] = []
        for k, (gram, n) in enumerate(grams, 1):
            last = (gram & np.uint32((1 << BITS * (k - 1)) - 1)) if k > 1 else gram
            d = discounts(n)[np.minimum(n, 3) - 1]
            if k == 1:
                held, where = np.zeros(1, np.uint32), np.zeros(len(gram), np.int64)
            else:
                # the context is the key without its last class; the lower order drops the first
                context = gram >> np.uint32(BITS)
                held, where = np.unique(context, return_inverse=True)
            total = np.bincount(where, n)
            left = np.bincount(where, np.minimum(d, n)) / total
            lower = np.exp(self.levels[-1].logp[np.searchsorted(self.levels[-1].keys, last)]) if k > 1 else 1.0 / CLASSES
            p = np.maximum(n - d, 0) / total[where] + left[where] * lower
            self.levels.append(Level(gram, np.log(p).astype(np.float32), held, np.log(np.maximum(left, 1e-12)).astype(np.float32)))

    def logp(self, key: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Log-probability of the last class of each key given the others."""
        if k == 0:
            return np.full(len(key), -np.log(CLASSES), np.float32)
        level = self.levels[k - 1]
        at, hit = find(level.keys, key)
        out = level.logp[at]
        if not hit.all():
            miss = ~hit
            rest = key[miss]
            back, known = find(level.contexts, rest >> np.uint32(BITS) if k > 1 else np.zeros_like(rest))
            out[miss] = np.where(known, level.backoff[back], 0) + self.logp(rest & np.uint32((1 << BITS * (k - 1)) - 1), k - 1)
        return out


class Characters:
    """Characters within their classes: discounted counts; what the discounts leave goes evenly to all code points of the class."""

    def __init__(self, code: np.ndarray, count: np.ndarray):
        order = np.argsort(code)
        self.codes, n = code[order].astype(np.uint32), count[order].astype(np.int64)
        of = classes_of(self.codes)
        d = np.minimum(discounts(n)[np.minimum(n, 3) - 1], n)
        total, left = np.bincount(of, n, CLASSES), np.bincount(of, d, CLASSES)
        size = np.maximum(class_sizes(), 1)
        # a class without any count is even
        even = np.divide(left, total, out=np.ones(CLASSES), where=total > 0) / size
        self.known = np.log((n - d) / total[of] + even[of]).astype(np.float32)
        self.unknown = np.log(even).astype(np.float32)

    def logp(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of each character given its class."""
        out = self.unknown[classes_of(codes)]
        if len(self.codes):
            at, hit = find(self.codes, codes)
            out[hit] = self.known[at[hit]]
        return out
