"""Streams of events: duplicates within a watermark, windows with late data, and an idempotent keyed sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrecall.operators.records import upsert


def timed(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """The stream with a watermark; times without zone are taken in the session's zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def first_deliveries(stream: DataFrame, ident: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Each event once; ids are forgotten when the watermark has passed them, so the state is bounded by time."""
    return timed(stream, ts, delay).dropDuplicatesWithinWatermark([ident])


def window_counts(stream: DataFrame, ts: str, size: str, delay: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts per window and key; events later than the watermark are left out."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return timed(stream, ts, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def bursts(stream: DataFrame, ts: str, key: str, gap: str, delay: str) -> DataFrame:
    """Bursts per key, closed by a pause."""
    return timed(stream, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def keyed_sink(path: str, key: str, payload: list[str], created: str, updated: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that upserts each batch into versions below ``path``.

    Version n is the store after batch n. A batch that is run again writes its version again from the one before, so a replay changes nothing;
    older versions than that one are deleted.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(key, *payload, created, updated)
        if batch_id > 0:
            old = spark.read.parquet(f"{path}/version={batch_id - 1}")
        else:
            old = rows.limit(0).withColumn("writes", F.lit(0).cast("long"))
        out = upsert(old.select(key, *payload, created, updated), rows, key, payload, created, updated)
        out.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={batch_id - 2}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    return write
