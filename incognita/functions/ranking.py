"""Consecutive row numbers over an unbounded set, without a one-task window.

``row_number().over(Window.orderBy(...))`` with no partition key moves every
row into a single task. Here the rows are range-partitioned and sorted on the
order key, materialised once (reliable checkpoint into the shared
``spark.checkpoint.dir``) so partition contents are fixed, numbered locally
with ``monotonically_increasing_id`` and shifted by the row counts of earlier
partitions. The per-partition count table has one row per partition, so its
broadcast is bounded by the partition count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incognita.session import ensure_checkpoint_dir


def consecutive_index(df: DataFrame, order_cols: list[str], name: str = "idx",
                      start: int = 1, num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = start, start+1, ... following the total order ``order_cols``.

    ``order_cols`` must be a total order (unique key) for the numbering to be
    reproducible; callers append a unique tie-breaker.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [F.col(c).asc_nulls_first() for c in order_cols]
    if num_partitions:
        ordered = df.repartitionByRange(num_partitions, *keys)
    else:
        ordered = df.repartitionByRange(*keys)
    ordered = ordered.sortWithinPartitions(*keys).checkpoint(eager=True)

    tagged = (ordered
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_local") + F.lit(start)).cast("bigint")) \
              .drop("_pid", "_local", "_off")
