"""Operator 2: exact deduplication by Grace hashing.

Every task keeps the distinct contents it meets in an open-addressing table that compares complete
content. When a table outgrows its memory, its records and all later ones are dealt by the next
bits of their hash to spill files, and each file is handled in the same way, until a bucket fits.
The operator runs this twice: inside the input's partitions, so that copies collapse before they
are shuffled, and after one shuffle by the hash. A hot content thus sends one record per input
partition, however many copies it has.

Spill files are unnamed temporary files of the running task, in the folder for Spark's own spills:
no other task reads them, they vanish with the task, and a task that is run anew makes them anew.

Membership comes from the same passes. The first one, whose result is written once, gives every row
the number of its partition's record of its content; the second one, which compares the records'
complete contents, gives every such record its group.

Defined cases: a null text is an empty text, and all empty or blank texts are equal; the row with
the most code points in its original text stays, then the smallest id (null ids last), then the
smallest remaining columns as text; rows that repeat entirely leave one row; an empty table gives
no rows; all columns of the input are carried along whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import sys
import tempfile
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tasks, written

BLANKS = b" \t\n\x0b\x0c\r"
TABLE_BYTES = 64 << 20
FAN_OUT = 16
BITS = 4
BATCH_BYTES = 8 << 20
STRETCH_ROWS = 1_000_000

Record = tuple[int, bytes, tuple, int, tuple]  # hash, content, order (least stays), copies, row


class Members:
    """How many rows a record stands for, and what they are called: ids, or places of records before."""

    __slots__ = ("rows", "names")

    def __init__(self, rows: int, names: list):
        self.rows, self.names = rows, names

    def __add__(self, other: Members) -> Members:
        self.rows += other.rows
        self.names += other.names
        return self

    def __sizeof__(self) -> int:
        return 100 + 48 * len(self.names)


def held(record: Record) -> int:
    """Bytes that a record takes, about."""
    return 200 + sys.getsizeof(record[1]) + sys.getsizeof(record[3]) + sum(map(sys.getsizeof, record[4]))


class OpenAddressingTable:
    """Linear probing over a power-of-two array of slots; equality is that of complete content."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.records: list[Record] = []
        self.bytes = 0

    def add(self, record: Record) -> int:
        """The number of the record of this content, whose best row stays."""
        key, content, order, copies, row = record
        mask = len(self.slots) - 1
        at = (key ^ key >> 29) & mask
        while (i := self.slots[at]) >= 0:
            old = self.records[i]
            if old[0] == key and old[1] == content:
                # rows of one order differ in other columns, which are compared only then
                better = order < old[2] or (order == old[2] and repr(row) < repr(old[4]))
                best = record if better else old
                self.records[i] = (key, old[1], best[2], old[3] + copies, best[4])
                self.bytes += sum(map(sys.getsizeof, row)) - sum(map(sys.getsizeof, old[4])) if better else 0
                self.bytes += sys.getsizeof(copies) if isinstance(copies, Members) else 0
                return i
            at = (at + 1) & mask
        self.slots[at] = len(self.records)
        self.records.append(record)
        self.bytes += held(record)
        if 2 * len(self.records) > len(self.slots):
            self._grow()
        return len(self.records) - 1

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for i, r in enumerate(self.records):
            at = (r[0] ^ r[0] >> 29) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def spill_dir() -> str | None:
    """The folder that Spark gives its Python workers for spills."""
    named = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return named if named and os.path.isdir(named) else None


def grace(records: Iterable[Record], table_bytes: int = TABLE_BYTES, level: int = 0) -> Iterator[Record]:
    """One record for each distinct content: the one that stays, with the sum of the copies."""
    table, files = OpenAddressingTable(), None
    for r in records:
        if files is None:
            table.add(r)
            # beyond 64 bits of hash, what is left has one hash: the table takes it as it is
            if table.bytes > table_bytes and len(table.records) > 1 and level * BITS < 60:
                files = [tempfile.TemporaryFile(dir=spill_dir()) for _ in range(FAN_OUT)]
                for kept in table.records:
                    pickle.dump(kept, files[kept[0] >> level * BITS & FAN_OUT - 1], 5)
                table = OpenAddressingTable()
        else:
            pickle.dump(r, files[r[0] >> level * BITS & FAN_OUT - 1], 5)
    if files is None:
        yield from table.records
        return
    for f in files:
        with f:
            f.seek(0)
            yield from grace(_unpickled(f), table_bytes, level + 1)


def _unpickled(f) -> Iterator[Record]:  # noqa: ANN001
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def normalised(text: str | None) -> bytes:
    """The UTF-8 bytes without the blanks."""
    return (text or "").encode("utf-8", "surrogatepass").translate(None, BLANKS)


def _order(text: str | None, id_: object) -> tuple:
    return (-len(text or ""), id_ is None, id_ if id_ is not None else 0)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, held_bytes = [], 0
    for r in rows:
        held.append(r)
        held_bytes += size(r) + 64
        if held_bytes >= BATCH_BYTES or len(held) >= 10_000:
            yield _batch(held, schema)
            held, held_bytes = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def survivors(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """The rows that stay, with all columns of ``docs`` in one struct ``row``, and of each its
    group's ``group_size`` and ``text_sha256``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = docs.columns
    at_id, at_text = names.index(id_col), names.index(text_col)
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    local = T.StructType([T.StructField("key", T.LongType()), T.StructField("copies", T.LongType()), *plain.fields])
    final = T.StructType([T.StructField("group_size", T.LongType()), T.StructField("text_sha256", T.StringType()), *plain.fields])
    local_arrow, final_arrow = to_arrow_schema(local), to_arrow_schema(final)

    def record(copies: int, row: tuple) -> Record:
        content = normalised(row[at_text])
        return (xxhash.xxh3_64_intdigest(content), content, _order(row[at_text], row[at_id]), copies, row)

    def rows_of(batches: Iterator[pa.RecordBatch], skip: int) -> Iterator[Record]:
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            copies = columns[1] if skip else [1] * b.num_rows
            for n, row in zip(copies, zip(*columns[skip:], strict=True), strict=True):
                yield record(n, row)

    def width(r: tuple) -> int:
        return len(r[2 + at_text] or "")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = grace(rows_of(batches, 0), table_bytes)
        yield from _batches((((k ^ 1 << 63) - (1 << 63), n, *row) for k, _, _, n, row in found), local_arrow, width)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = grace(rows_of(batches, 2), table_bytes)
        yield from _batches(((n, hashlib.sha256(c).hexdigest(), *row) for _, c, _, n, row in found), final_arrow, width)

    collapsed = docs.toDF(*plain.names).mapInArrow(inside, local)
    found = collapsed.repartition(tasks(docs.sparkSession), "key").mapInArrow(across, final)
    row = F.struct(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
    return found.select(row.alias("row"), "group_size", "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, its columns as they were."""
    return survivors(docs, id_col, text_col).select("row.*")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A place is the number of a partition's record of one content. Inside a partition every row gets
    its place, and the places' contents go through the hash to their groups, one record a partition
    however many copies it has. The join by place is between rows of one partition and one record
    each, so a hot content is as many keys as partitions. Rows that repeat entirely share one
    keep_id, and ``kept`` is true for one row of a group.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    field = lambda name, of: T.StructField(name, of)
    place, flag, number, text = T.LongType(), T.BooleanType(), T.LongType(), T.StringType()
    first_schema = T.StructType([field("id", kind), field("place", place), field("best", flag), field("copies", number), field("key", number), field("text", text)])
    group_schema = T.StructType([field("place", place), field("keep_id", kind), field("wins", flag), field("group_size", number), field("text_sha256", text)])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    first = written(rows.mapInArrow(_inside(first_schema, table_bytes), first_schema), "places")
    records = first.where("key IS NOT NULL").select("id", "text", "place", "copies", "key")
    found = records.repartition(tasks(spark), "key").mapInArrow(_across(group_schema, table_bytes), group_schema)
    members = first.where("key IS NULL").select("id", "place", "best")
    return members.join(found, "place").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("best") & F.col("wins")).alias("kept"), "text_sha256"
    )


def _record(id_: object, text: str | None, members: Members, *more: object) -> Record:
    content = normalised(text)
    return (xxhash.xxh3_64_intdigest(content), content, _order(text, id_), members, (id_, text, *more))


def _inside(schema: T.StructType, table_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's rows with their places, and its records with theirs; only the latter have a key."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def spread(rows: Iterator[tuple]) -> Iterator[tuple]:
        place = TaskContext.get().partitionId() << 36
        # a stretch of rows at a time: a record's list of members is no longer than that
        for ahead in rows:
            stretch = chain([ahead], islice(rows, STRETCH_ROWS - 1))
            for key, _, _, members, (id_, text) in grace((_record(i, t, Members(1, [i])) for i, t in stretch), table_bytes):
                best = members.names.index(id_)
                for n, name in enumerate(members.names):
                    yield (name, place, n == best, None, None, None)
                yield (id_, place, None, members.rows, (key ^ 1 << 63) - (1 << 63), text)
                place += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from _batches(spread(rows), out, lambda r: len(r[5] or ""))

    return run


def _across(schema: T.StructType, table_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of every place, its group: what stays in it, whether from this place, its rows and its digest."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
        for b in batches:
            for id_, text, place, copies in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                yield _record(id_, text, Members(copies, [place]), place)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, content, _, members, (id_, _, winner) in grace(records(batches), table_bytes):
            digest = hashlib.sha256(content).hexdigest()
            for place in members.names:
                yield (place, id_, place == winner, members.rows, digest)

    return lambda batches: _batches(spread(batches), out, lambda r: 64)
