"""Token counts by heap-and-linked-list pair merging.

A text's symbols form a linked list.  Every adjacent pair that is a piece of the
vocabulary waits in a heap ordered by the piece's rank, then by position; the
lowest is popped and merged until none is left.  The number of tokens is the
number of initial symbols minus the number of merges, so no identifier is made.
A character outside the vocabulary counts as its UTF-8 bytes (byte fallback).

A merge never crosses two characters that stand side by side in no piece.  The
normalised text is cut there, and the count of each part is remembered in a
cache of bounded size: only speed depends on the cache.

null text: as empty, 0 tokens.  Rows are independent, so repeated rows, ties and
null identifiers pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rows, tokenizer_path

SPACE = "▁"
CACHE_PARTS = 1_000_000


class PartCounts(dict):
    """Tokens of a part of normalised text, by heap-and-linked-list merging.

    pairs: the two-character strings found in pieces; a part is cut elsewhere.
    """

    def __init__(self, ranks: dict[str, int], limit: int = CACHE_PARTS):
        super().__init__()
        self.ranks, self.limit = ranks, limit
        self.known = {p for p in ranks if len(p) == 1}
        self.pairs = {p[i:i + 2] for p in ranks for i in range(len(p) - 1)}

    def __missing__(self, part: str) -> int:
        cuts = [i for i in range(1, len(part)) if part[i - 1:i + 1] not in self.pairs]
        if cuts:
            n = sum([self[part[i:j]] for i, j in zip([0, *cuts], [*cuts, len(part)])])
        else:
            n = self.count(part)
        if len(self) >= self.limit:
            self.clear()
        self[part] = n
        return n

    def count(self, part: str) -> int:
        n = len(part)
        initial = n if self.known.issuperset(part) else sum([1 if c in self.known else len(c.encode()) for c in part])
        if part in self.known or n < 2:
            return initial
        get = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := get(part[i:i + 2])) is not None]
        if not heap:
            return initial
        heapify(heap)
        # the linked list: where the symbol that begins here ends (0: merged away), and where the one that ends here begins
        end, begin = list(range(1, n + 1)), list(range(-1, n))
        merges = 0
        while heap:
            rank, left = heappop(heap)
            middle = end[left]
            if not middle or middle == n:
                continue
            right = end[middle]
            if get(part[left:right]) != rank:
                continue  # one side has been merged since
            end[left], end[middle], begin[right] = right, 0, left
            merges += 1
            if right < n and (r := get(part[left:end[right]])) is not None:
                heappush(heap, (r, left))
            if left and (r := get(part[begin[left]:right])) is not None:
                heappush(heap, (r, begin[left]))
        return initial - merges


class PieceCounter:
    """Counts the tokens of texts for a sentencepiece BPE model with byte fallback."""

    def __init__(self, model: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.normalize = sp.normalize
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        scores = sorted({sp.get_score(i) for i in ids}, reverse=True)
        order = {x: k for k, x in enumerate(scores)}
        ranks = {sp.id_to_piece(i): order[sp.get_score(i)] for i in ids}
        if any(sp.is_unused(i) for i in ids) or any(c not in ranks for p in ranks for c in p):
            raise ValueError(f"{model}: unused pieces or characters that are no piece are not supported")
        self.parts = PartCounts(ranks)
        self.words = not any(p[1] == SPACE and p[0] != SPACE for p in self.parts.pairs)
        self.cut_runs = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        norm = self.normalize(text)
        if not self.words:
            return self.parts.count(norm)
        if SPACE + SPACE in norm or norm[0] != SPACE:
            parts = self.cut_runs(norm)
            return sum(map(self.parts.__getitem__, parts))
        # every word begins with one space
        parts = norm.replace(SPACE, "\x00" + SPACE).split("\x00")[1:] if "\x00" not in norm else self.cut_runs(norm)
        return sum(map(self.parts.__getitem__, parts))


@lru_cache(maxsize=2)
def piece_counter(model: str) -> PieceCounter:
    return PieceCounter(tokenizer_path(model))


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    model: a file of the public tokenizers, or its path on every machine.
    Further columns of docs are not read.
    """
    schema = docs.select(id_col).schema

    def count(batches):
        counter = piece_counter(model)
        for ids, texts in rows(batches, "key", "text"):
            texts = [t or "" for t in texts]
            n = [counter(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, key_type), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    from pyspark.sql.pandas.types import to_arrow_type
    key_type = to_arrow_type(schema[0].dataType)
    return docs.selectExpr(f"`{id_col}` AS key", f"`{text_col}` AS text").mapInArrow(
        count, f"`{id_col}` {schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
