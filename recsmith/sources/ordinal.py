"""A12 stable global row ordinal, A17 contiguous shards, A18 shard merge, E16 batches.

The ordinal is the 0-based position of a row in a *total* order.  It is computed
without a single-partition window: the frame is range-partitioned on the order
columns (a hot key is split across ranges), each range is sorted locally, the
per-range counts (one row per partition) give the offsets, and the offset is
added to the local index.  The ranges are checkpointed before they are read twice, so
rows and offsets stay together when an executor is lost.  Only ``num_partitions`` small rows reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def with_ordinal(df: DataFrame, order_cols, name: str = "ord", num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    local = cut_lineage(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        # monotonically_increasing_id = (partition << 33) + index inside the sorted partition
        .withColumn("_lidx", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33))
    )
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the partition count, safe to broadcast
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("bigint")).select("_pid", "_off")
    out = local.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_lidx"))
    return out.drop("_pid", "_lidx", "_off")


def shard(df: DataFrame, ord_col: str, n_rows, n_shards: int, name: str = "shard") -> DataFrame:
    """Shard i holds rows ``[i*n//P, (i+1)*n//P)``.

    The shard of a row is the largest i with ``i*n div P <= ord``, which in closed
    form is ``((ord + 1) * P - 1) div n``.  ``n_rows`` is an int or a column name.
    """
    n = str(int(n_rows)) if isinstance(n_rows, int) else f"`{n_rows}`"
    return df.withColumn(name, F.expr(f"((CAST(`{ord_col}` AS BIGINT) + 1) * {int(n_shards)} - 1) div {n}"))


def merge_shards(dfs, ord_col: str = "ord") -> DataFrame:
    """Concatenate shards in listed order; the merged ordinal is (shard, ord)."""
    out = None
    for i, d in enumerate(dfs):
        d = d.withColumn("_shard", F.lit(i))
        out = d if out is None else out.unionByName(d)
    return out


def batch_id(ord_col, batch_size: int):
    """Batch of a row = ordinal div batch size."""
    c = F.col(ord_col) if isinstance(ord_col, str) else ord_col
    return F.floor(c / F.lit(batch_size)).cast("bigint")


def group_row_number(df: DataFrame, keys, order_cols, name: str = "rn", with_count: str | None = None,
                     num_partitions: int | None = None) -> DataFrame:
    """1-based row number inside each group without a per-group window or a join on
    the bare group key.

    The frame is range-partitioned on ``keys + order_cols`` (a group holding a third
    of all rows spans many ranges) and sorted inside each range.  Per (range, group)
    a small table holds the first local index and the row count; a window over that
    table (one row per range the group touches) gives the rows of the group in earlier
    ranges.  Rows join it back on (range, group), a key no group can make hot.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) for c in keys + list(order_cols)]
    local = cut_lineage(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_lidx", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33))
    )
    parts = local.groupBy("_pid", *keys).agg(F.min("_lidx").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*keys).orderBy("_pid")
    parts = parts.withColumn("_before", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if with_count:
        parts = parts.withColumn(with_count, F.sum("_cnt").over(Window.partitionBy(*keys)))
    cols = ["_pid", *keys, "_first", "_before"] + ([with_count] if with_count else [])
    out = local.join(parts.select(*cols), ["_pid", *keys])
    out = out.withColumn(name, F.col("_before") + F.col("_lidx") - F.col("_first") + F.lit(1))
    return out.drop("_pid", "_lidx", "_first", "_before")
