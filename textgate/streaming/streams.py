"""Streaming variants: windowed counts, deduplication within a watermark, a running maximum per key.

The reference has no streams; each of these equals its batch counterpart once all input has come.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import shared_dir


def stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A Parquet table as a stream of its files."""
    one = f"{folder}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(one).schema)
    rows = reader.parquet(one) if _is_folder(spark, one) else reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    # event time needs an instant; local times are taken in the session's time zone
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def tumbling_counts(events: DataFrame, by: str, window: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    counts = events.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), by, "n", "total")


def session_counts(events: DataFrame, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    counts = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), by, "n")


def distinct_within(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_max(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key, the greatest value so far, sent whenever it rises."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else None
        best = max([*([old] if old is not None else []), *(float(f[value].max()) for f in frames)])
        if old is None or best > old:
            state.update((best,))
            yield pd.DataFrame({key: [k[0]], "best": [best]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, best double", "best double", "update", GroupStateTimeout.NoTimeout)


def finished(df: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives once it has read all that is there now, as a written table."""
    spark = df.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/textgate/stream-{uuid.uuid4().hex}"
    if mode == "append":
        run = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    else:
        keep = lambda rows, n: rows.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{base}/out")
        run = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")
