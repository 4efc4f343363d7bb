"""A stream of experiences appended to a memory, each key once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumaframe.operators.order import first_wins
from lumaframe.sources.jsonl import path_exists


BUCKETS = 256
BUCKET = "key_bucket"


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a memory without the column of its folders."""
    return spark.read.parquet(path).drop(BUCKET)


def append_stream(stream: DataFrame, path: str, checkpoint: str, key: str, order: list[Column], keep: Column | None = None) -> StreamingQuery:
    """Append new keys of each micro-batch to the Parquet memory at ``path``.

    Within a batch the first row in ``order`` wins; keys the memory holds are
    skipped, so that a batch replayed after a failure adds nothing twice.  ``keep``
    filters rows first (null is false).  Readers see the memory as of a batch.

    The memory is partitioned by a hash of the key into ``BUCKETS`` folders; a batch reads
    the keys of its own buckets only, and of these no more than the key column.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(F.coalesce(keep, F.lit(False))) if keep is not None else batch
        fresh = first_wins(rows.where(F.col(key).isNotNull()), [key], order).withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int"))
        if path_exists(batch.sparkSession, path):
            touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # at most BUCKETS numbers
            held = batch.sparkSession.read.parquet(path).where(F.col(BUCKET).isin(touched)).select(key, BUCKET)
            fresh = fresh.join(held, [key, BUCKET], "left_anti")
        fresh.write.mode("append").partitionBy(BUCKET).parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_gains(stream: DataFrame, time: str, group: str, gain: Column, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and mean gain per tumbling window and group; rows later than ``late`` are dropped by the watermark."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), group)
        .agg(F.count("*").alias("rows"), F.avg(gain).alias("mean_gain"))
        .select(F.col("w.start").alias("window_start"), group, "rows", "mean_gain")
    )
