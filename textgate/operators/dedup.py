"""Exact duplicates, conflicts, families and digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def with_counts(rows: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Per key: rows, distinct labels, least and greatest label. Partial sums go before the shuffle."""
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"), F.sort_array(F.collect_set(label)).alias("labels")
    )


def deduplicate(rows: DataFrame, key: str, order: str, label: str = "label") -> DataFrame:
    """One row per key, the first in input order; keys with more than one label are dropped whole."""
    columns = [c for c in rows.columns if c != key]
    best = F.min_by(F.struct(*columns), F.col(order))
    found = rows.groupBy(key).agg(best.alias("best"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    return found.where("lo = hi").select(key, "best.*")


def conflicts(rows: DataFrame, key: str, key_hash: Column, label: str = "label", id_col: str = "id") -> DataFrame:
    """The quarantine: keys with more than one label, their labels, number of rows and first and last id."""
    found = rows.groupBy(key).agg(
        F.sort_array(F.collect_set(label)).alias("labels"), F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")
    )
    return found.where(F.size("labels") > 1).select(key_hash.alias("normalized_hash"), F.array_join("labels", ",").alias("labels"), "n", "first_id", "last_id")


def one_per(rows: DataFrame, key: str | list[str], order: Column) -> DataFrame:
    """One row per key: the least by ``order``."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("best")).select(*keys, "best.*")


def duplicate_counts(rows: DataFrame, key: str) -> DataFrame:
    groups = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def set_digest(rows: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Order-independent digests: n, and the SHA-256 of the sorted, newline-joined values; nulls count
    in n only, and an empty table has no digest.

    A digest is sequential by definition: one task makes it, from a sorted stream of which it holds a
    batch, so its memory does not grow with the group.
    """
    kind = rows.schema[by].dataType if by else None
    values = rows.select(*([F.col(by).alias("k")] if by else [F.lit(None).cast("string").alias("k")]), F.col(value).cast("string").alias("v"))
    dealt = values.repartition("k") if by else values.repartition(1)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, said, digest, none = None, 0, 0, None, True
        out: list[tuple] = []
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if none or k != key:
                    if not none:
                        out.append((key, n, digest.hexdigest()))
                    key, n, said, digest, none = k, 0, 0, hashlib.sha256(), False
                n += 1
                if v is not None:
                    digest.update((b"\n" if said else b"") + v.encode("utf-8", "surrogatepass"))
                    said += 1
            if len(out) >= 10_000:
                yield _digests(out, arrow)
                out = []
        if not none:
            out.append((key, n, digest.hexdigest()))
        if out:
            yield _digests(out, arrow)

    arrow = to_arrow_type(kind) if by else pa.string()
    name = kind.simpleString() if by else "string"
    found = dealt.sortWithinPartitions("k", "v").mapInArrow(digests, f"k {name}, n long, digest string")
    return found.select(F.col("k").alias(by), "n", "digest") if by else found.select("n", "digest")


def _digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    k, n, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k, kind), pa.array(n, pa.int64()), pa.array(digest, pa.string())], names=["k", "n", "digest"])


def without_exact(rows: DataFrame, protected: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the protected ones."""
    return rows.join(protected.select(key).distinct(), key, "left_anti")


def families_elsewhere(rows: DataFrame, family: str, group: str, wanted: str) -> DataFrame:
    """Rows of one group whose family no other group has."""
    others = rows.where(F.col(group) != wanted).select(family).distinct()
    return rows.where(F.col(group) == wanted).join(others, family, "left_anti")
