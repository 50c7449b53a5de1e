"""Deterministic samples: hash ranks, round robin, quotas, contexts within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_hash
from .ranges import positions


def hash_rank(seed: str, id_col: str = "id") -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col)).cast("binary"), 256)


def ranked(rows: DataFrame, by: list[str], order: list[Column], out: str = "rn") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_per_group(rows: DataFrame, by: list[str], n: int | Column, order: list[Column]) -> DataFrame:
    """At most n rows a group. Spark filters the rank before the shuffle (window group limit)."""
    return ranked(rows, by, order).where(F.col("rn") <= n)


def first_in_order(rows: DataFrame, n: int, order: list) -> DataFrame:
    """The n least rows: each task keeps n, one merges them."""
    return rows.orderBy(*order).limit(n)


def round_robin(rows: DataFrame, groups: list[str], limit: int, seed: str, id_col: str = "id") -> DataFrame:
    """All groups' first rows, then all groups' second rows, and so on to the limit."""
    order = hash_rank(seed, id_col)
    return first_in_order(ranked(rows, groups, [order, F.col(id_col)], "depth"), limit, ["depth", *groups])


def diverse_sample(rows: DataFrame, groups: list[str], limit: int, seed: str, id_col: str = "id") -> DataFrame:
    """A quarter of the sample (or one a group) by round robin, the rest by hash rank."""
    order = hash_rank(seed, id_col)
    n = rows.count()
    if n <= limit:
        return rows
    target = min(limit, max(rows.select(*groups).distinct().count(), limit // 4))
    breadth = round_robin(rows, groups, target, seed, id_col).drop("depth")
    rest = rows.join(breadth.select(id_col), id_col, "left_anti").select(*rows.columns)
    return breadth.unionByName(first_in_order(rest, limit - target, [order, F.col(id_col)]))


def largest_remainder(counts: dict[str, int], size: int, least: int = 10) -> dict[str, int]:
    """Rows per label: a minimum each, the rest in proportion to what is left, largest remainders first."""
    given = {k: min(least, n) for k, n in counts.items()}
    if size < sum(given.values()) or size > sum(counts.values()):
        raise ValueError("the size does not fit the labels' minimum or total")
    left, room = size - sum(given.values()), {k: counts[k] - given[k] for k in counts}
    if left:
        total = sum(room.values())
        share = {k: left * room[k] / total for k in counts}
        for k in counts:
            given[k] += int(share[k])
        names = list(counts)
        for k in sorted(names, key=lambda k: (-(share[k] % 1), names.index(k)))[: size - sum(given.values())]:
            given[k] += 1
    return given


def quota_sample(rows: DataFrame, label: str, labels: tuple[str, ...], size: int, seed: str, id_col: str = "id") -> DataFrame:
    """A sample with largest-remainder quotas per label, by hash rank. Only the counts reach the driver."""
    found = {r[label]: r["count"] for r in rows.where(F.col(label).isin(*labels)).groupBy(label).count().collect()}
    quota = largest_remainder({k: found.get(k, 0) for k in labels}, size)
    n = F.coalesce(*[F.when(F.col(label) == k, F.lit(q)) for k, q in quota.items()], F.lit(0))
    return top_per_group(rows, [label], n, [hash_rank(seed, id_col)])


def spaced_rows(rows: DataFrame, count: int, order: list[str]) -> DataFrame:
    """Rows at evenly spaced places of an order."""
    n = rows.count()
    if count >= n:
        return rows
    at = [int(i * (n - 1) / (count - 1)) for i in range(count)] if count > 1 else [0]
    return positions(rows, order).where(F.col("place").isin(at)).drop("place")


def repeated(rows: DataFrame, times: Column, seed: str, id_col: str = "id") -> DataFrame:
    """Every row ``times`` times, with a hash that permutes the presentations."""
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    return rows.withColumn("place", short_hash(F.concat(F.lit(f"{seed}:"), F.col(id_col), F.lit(":"), F.col("copy").cast("string"))))


def context(turns: DataFrame, key: str, order: str, line: str, limit: int, recent: bool) -> DataFrame:
    """The longest run of lines from one end that fits a number of characters, one between two lines.

    The first line is kept whatever its length, cut to the limit with an ellipsis.
    """
    w = Window.partitionBy(key).orderBy(F.col(order).desc() if recent else F.col(order).asc())
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.where(F.length(line) > 0).withColumn("__rn", F.row_number().over(w))
    size = F.when((F.col("__rn") == 1) & (F.length(line) > limit), F.lit(limit)).otherwise(F.length(line))
    rows = rows.withColumn("__total", F.sum(size).over(upto) + F.col("__rn") - 1).where((F.col("__rn") == 1) | (F.col("__total") <= limit))
    cut = F.concat(F.rtrim(F.substring(F.col(line), 1, limit - 1)), F.lit("…"))
    rows = rows.withColumn("__line", F.when((F.col("__rn") == 1) & (F.length(line) > limit), cut).otherwise(F.col(line)))
    found = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "__line"))).alias("__lines"))
    return found.select(key, F.array_join("__lines.__line", "\n").alias("context"), F.size("__lines").cast("long").alias("lines"))
