"""Running numbers over ordered groups without sending a hot group to one task.

A plain ``Window.partitionBy(key).orderBy(...)`` puts all rows of a key into one task. ``split_ordered`` cuts the rows into
range partitions by (key, order) first, so that a key with a third of all rows spans many partitions, numbers the rows within each
(key, slice), and adds the number of rows that earlier slices of the key hold. Only one row per (key, slice) is exchanged for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomrecall.session import materialize, slots, source_bytes

SLICE = "_slice"
POS = "pos"
#: Bytes of the source tables for each slice, so that slices stay small when the tables grow.
SLICE_BYTES = 64_000_000


def range_slices(df: DataFrame, key: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` written once in ranges of (key, order), with the number of its range in ``_slice``.

    It is written because the borders come from a sample: they must be the same for every later read.
    """
    n = max(4 * slots(df.sparkSession), -(-source_bytes(df) // SLICE_BYTES))
    ranged = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in key + order])
    return materialize(ranged.withColumn(SLICE, F.spark_partition_id()), label)


def split_ordered(df: DataFrame, key: list[str], order: list[str], label: str, around: dict[str, str] | None = None) -> DataFrame:
    """Add ``pos`` (0, 1, ... in each key by ``order``, nulls first) and, for each ``around`` entry ``{new: column}``, the next row's value.

    ``order`` must be unique within a key for a repeatable result. Null keys form a group of their own. An empty table gives an empty table.
    """
    around = around or {}
    ranged = range_slices(df, key, order, label)
    local = Window.partitionBy(*key, SLICE).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = ranged.withColumn("_rn", F.row_number().over(local))
    for new, column in around.items():
        numbered = numbered.withColumn(f"_next_{new}", F.lead(column).over(local))
    first = {new: F.min_by(F.struct(F.col(column).alias("v")), F.struct(*[F.col(c) for c in order])).alias(f"_first_{new}") for new, column in around.items()}
    parts = ranged.groupBy(*key, SLICE).agg(F.count(F.lit(1)).alias("_n"), *first.values())
    across = Window.partitionBy(*key).orderBy(SLICE)
    before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    for new in around:
        before = before.withColumn(f"_after_{new}", F.lead(f"_first_{new}").over(across))
    back = before.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col(SLICE).alias("_s"), "_before", F.col("_n").alias("_size"), *[F.col(f"_after_{new}") for new in around])
    on: Column = F.col(SLICE) == F.col("_s")
    for i, c in enumerate(key):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = numbered.join(back, on).withColumn(POS, F.col("_before") + F.col("_rn") - F.lit(1))
    for new in around:
        out = out.withColumn(new, F.when(F.col("_rn") == F.col("_size"), F.col(f"_after_{new}.v")).otherwise(F.col(f"_next_{new}")))
    return out.select(*df.columns, POS, *around)
