"""Operator 3: packing token sequences by Karmarkar-Karp multiway differencing.

Executors tokenise whole texts and cut each document into full sequences and, from its rest, pieces
of at most ``piece`` tokens. Only the pieces' numbers travel on. They are dealt by a hash of their
row into groups of about ``group_tokens`` tokens. In a group, every piece starts as a partial partition with
one window in use; the two partial partitions whose windows differ most are merged again and again,
the fullest windows of one onto the emptiest of the other, until one partition is left. Its windows
are nearly equal. Where one exceeds the capacity, the number of windows rises by one and the
differencing starts anew. Pieces of equal length may then change places: those of one document
are brought together, which leaves every window as full as it was.

Defined cases: a null text is empty and gives the end id alone; repeated rows are packed as often
as they occur; null ids are carried along; an empty table gives no rows; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CAPACITY = 2048
PIECE = 256
GROUP_TOKENS = 512 * CAPACITY
END_ID = 1
#: Below this code point both libraries know the same letters, digits and blanks.
SHARED = re.compile("[^\x00-ɏ]")


class Encoder:
    """Token ids as the tokenizers file gives them.

    Texts of code points below U+0250 without an added token's string go through the same
    vocabulary as ranks, which gives the same ids several times as fast; all others go through the
    tokenizers library itself. Without a file of ranks all do.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer_path)
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path and pattern:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not SHARED.search(text) and not any(a in text for a in self.added):
            return self.fast.encode_to_numpy(text).astype("<u4", copy=False)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(*paths: str | None) -> Encoder:
    """The encoder of a set of files, made once per Python worker."""
    if paths not in _ENCODERS:
        _ENCODERS[paths] = Encoder(*paths)
    return _ENCODERS[paths]


def cuts(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length): full sequences, then pieces; the last of them is as short as it comes and fills gaps."""
    full = n // capacity * capacity
    found = [(at, capacity) for at in range(0, full, capacity)]
    return found + [(at, min(piece, n - at)) for at in range(full, n, piece)]


def difference(sizes: list[int], windows: int) -> list[tuple[int, object]]:
    """Windows as (tokens, pieces); pieces are nested pairs of the pieces' positions in ``sizes``.

    A partial partition lists its windows in use, fullest first; the others hold nothing.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        shared = len(a) + len(b) - windows
        if shared <= 0:
            merged = a + b
        else:  # the emptiest of each meet: the least of one with the greatest of the other
            merged = a[: len(a) - shared] + b[: len(b) - shared]
            merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(reversed(a[len(a) - shared :]), b[len(b) - shared :], strict=True)]
        merged.sort(key=_tokens, reverse=True)
        n += 1
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], n, merged))
    return heap[0][2] if heap else []


def _tokens(window: tuple[int, object]) -> int:
    return window[0]


def pieces_of(node: object) -> list[int]:
    found, open_ = [], [node]
    while open_:
        x = open_.pop()
        if isinstance(x, tuple):
            open_.extend(x)
        else:
            found.append(x)
    return sorted(found)


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of pieces by window; no window exceeds ``capacity``."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, count)
        if not found or found[0][0] <= capacity:
            return [pieces_of(node) for _, node in found]
        count += 1


def gathered(windows: list[list[int]], lengths: list[int], owners: list[int]) -> list[list[int]]:
    """The same windows by length, with pieces of equal length dealt anew so that documents stay together.

    ``owners`` numbers the document of each piece. Windows take turns: each keeps its pieces of a
    length of their own, then gets the other pieces of their documents, then those of the documents
    it has begun with, then the next ones that are left. Only pieces of the commonest length move.
    """
    common, times = Counter(lengths).most_common(1)[0] if lengths else (0, 0)
    if times < 2:
        return windows
    left: dict[int, deque[int]] = {}
    for i, n in enumerate(lengths):
        if n == common:
            left.setdefault(owners[i], deque()).append(i)
    order = deque(left)  # documents with pieces left, and some that have none any more
    out = []
    for window in windows:
        kept = [i for i in window if lengths[i] != common]
        room, wanted = len(window) - len(kept), deque(dict.fromkeys(owners[i] for i in kept))
        while room:
            if not wanted:
                while not left[order[0]]:
                    order.popleft()
                wanted.append(order[0])
            mine = left.get(wanted.popleft())
            while room and mine:
                kept.append(mine.popleft())
                room -= 1
        out.append(sorted(kept))
    return out


def pack(
    docs: DataFrame, files: tuple[str | None, ...], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    piece: int = PIECE, group_tokens: int = GROUP_TOKENS, end_id: int = END_ID,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    ``files`` are the arguments of ``Encoder``. The pieces are written once, since their total
    decides the number of groups; a group holds about ``group_tokens`` however large the input.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, row = encoder(*files), 0
        for b in batches:
            at, numbers = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(e.ids(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                for start, length in cuts(len(ids), capacity, piece):
                    at.append(i)
                    numbers.append((start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), row))
                row += 1
            columns = zip(*numbers, strict=True) if numbers else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=names
            )

    cut_ = rows.mapInArrow(cut, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))
    pieces = written(cut_, "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    # a row's pieces go to one group, as far as a group reaches
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "doc_tokens", "row", F.floor(F.col("start") / F.lit(group_tokens // 8))), F.lit(groups)))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([(n, "ascending") for n in ("doc_id", "row", "doc_tokens", "start", "ids_crc32")])
        group = table.column("group")[0].as_py()
        lengths = table.column("length").to_pylist()
        full = [i for i, n in enumerate(lengths) if n == capacity]
        rest = [i for i, n in enumerate(lengths) if n < capacity]
        sizes = [lengths[i] for i in rest]
        at_row = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "row", "doc_tokens")), strict=True))
        number = {x: n for n, x in enumerate(dict.fromkeys(at_row))}
        windows = gathered(windows_of(sizes, capacity), sizes, [number[at_row[i]] for i in rest])
        windows = [[i] for i in full] + [[rest[j] for j in w] for w in windows]
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for n, window in enumerate(windows):
            at = 0
            for i in window:
                sequence[i], offset[i] = (group << 32) + n, at
                at += lengths[i]
        out = table.select(names[:5])
        return out.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("group").applyInArrow(
        fill, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
