"""Operator 10: token counts by heap-and-linked-list byte-pair merging.

A text is cut into segments that no vocabulary piece can span (a run of space marks and what
follows up to the next mark). In each segment the adjacent pair of lowest rank is popped from a
heap again and again and merged in a doubly linked list. The count is the number of initial
symbols less the number of merges; no identifier is produced. Segments repeat, so their counts
are kept in a bounded table per Python worker.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a character outside the vocabulary
counts as its UTF-8 bytes; repeated rows give repeated results; an empty table gives no rows;
further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁"
SEGMENT = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*|[^{SPACE_MARK}]+")
CACHE_SEGMENTS = 400_000
CACHE_CHARS = 64
PIECE = 1 << 20


class PieceCounter:
    """Counts tokens as a sentencepiece BPE model with byte fallback and a dummy prefix does."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.rank: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.rank[sp.id_to_piece(i)] = -sp.get_score(i)
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.rank):
            raise ValueError("a piece spans a word boundary; segments would not be independent")
        self.chars = {p for p in self.rank if len(p) == 1}
        if any(not self.chars.issuperset(p) for p in self.rank):
            raise ValueError("a piece has a character that is no piece; bytes could not be counted ahead")
        self.known: dict[str, int] = {}

    def segment(self, s: str) -> int:
        """Tokens of one segment: initial symbols less merges."""
        get = self.rank.get
        n = len(s)
        symbols = n if self.chars.issuperset(s) else sum(1 if c in self.chars else len(c.encode("utf-8", "surrogatepass")) for c in s)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(s[i : i + 2])) is not None]
        if not heap:
            return symbols
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        end = list(range(1, n + 1))  # end[i]: one past the symbol that starts at i; 0 once merged
        prev = list(range(-1, n))
        merges = 0
        while heap:
            _, i, stop = pop(heap)
            j = end[i]
            if not j or j >= stop or end[j] != stop:  # one of the two has been merged since
                continue
            merges += 1
            end[j] = 0
            end[i] = stop
            prev[stop] = i
            if stop < n and (r := get(s[i : end[stop]])) is not None:
                push(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := get(s[p:stop])) is not None:
                push(heap, (r, p, stop))
        return symbols - merges

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for s in SEGMENT.findall(SPACE_MARK + text.replace(" ", SPACE_MARK)):
            n = known.get(s)
            if n is None:
                n = self.segment(s)
                if len(s) <= CACHE_CHARS:
                    if len(known) >= CACHE_SEGMENTS:
                        known.clear()
                    known[s] = n
            total += n
        return total


_COUNTERS: dict[str, PieceCounter] = {}


def counter(model_path: str) -> PieceCounter:
    """The counter of a model, made once per Python worker."""
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = PieceCounter(model_path)
    return _COUNTERS[model_path]


def count_tokens(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row per row of ``docs``.

    A narrow map without a shuffle; memory is one Arrow batch and the bounded segment table.
    """
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [c.count(t) for t in texts]
            size = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(
        per_batch, f"doc_id {id_type.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    )
