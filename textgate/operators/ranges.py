"""Running sums and positions over a whole table without one task that sees all of it.

Rows are dealt by ranges of the order and written once; each range is summed, the few range sums
are accumulated, and every range adds its own start to a window of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def running_sums(rows: DataFrame, order: list, sums: dict[str, str], inclusive: bool = True) -> DataFrame:
    """``rows`` with, for each name in ``sums``, the sum of its column over all rows up to this one
    (or before it). ``order`` must tell all rows apart where the sums of ties matter."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    whole = dealt.groupBy("__part").agg(*[F.sum(c).alias(f"__sum_{n}") for n, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = whole.select("__part", *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__start_{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    found = dealt.join(F.broadcast(starts), "__part")
    found = found.select("*", *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__start_{n}")).alias(n) for n, c in sums.items()])
    return found.select(*rows.columns, *sums)


def positions(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """``rows`` with their position from 0 in the order."""
    return running_sums(rows.withColumn("__one", F.lit(1).cast("long")), order, {name: "__one"}, inclusive=False).drop("__one")
