"""What the operators of this subpackage share: tables, written intermediates, folds."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discarded, shared_dir, written  # noqa: F401

#: A key is hot that has more than this part of all rows: fewer keys than its inverse can be.
HOT_SHARE = 1 / 2000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished rounds, which it does once nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids: of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def joined_with_hot(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """``left`` with the one row that ``right`` has for each key; its column ``rows`` says how many of left's it goes with.

    Fewer than 1 / HOT_SHARE keys are hot: their rows of ``right`` are sent to all, so that no task
    gets all of a key. The others are joined. Both inputs are read twice and should be written tables.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) > F.lit(total * HOT_SHARE)
    some = F.broadcast(right.where(hot))
    rest = left.join(F.broadcast(right.where(hot).select(key)), key, "left_anti").join(right.where(~hot), key)
    return left.join(some, key).unionByName(rest)
