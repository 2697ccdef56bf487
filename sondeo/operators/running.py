"""Running totals, ranks and forward fill that no single task has to hold whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondeo.session import durable


def running_totals(
    df: DataFrame,
    order: list[Column],
    value: str,
    total: str = "running",
    rank: str | None = None,
) -> DataFrame:
    """Add the running sum of ``value`` (and optionally the 1-based rank) in a total order.

    The table is range-partitioned on the order, stored with its slice number, and finished with
    per-slice windows plus the totals of the slices before: every slice is one partition's share
    of the data, whatever its size.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()))
    # One row per slice, so a window over all of them stays as small as the slice count.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_slice")
        .agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
        .select(
            "_slice",
            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        )
    )
    inside = Window.partitionBy("_slice").orderBy(*order)
    out = ranged.join(F.broadcast(offsets), "_slice").withColumn(
        total, F.col("_sum_before") + F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    if rank:
        out = out.withColumn(rank, F.col("_rows_before") + F.row_number().over(inside))
    return out.drop("_slice", "_sum_before", "_rows_before")


def forward_fill(
    df: DataFrame, column: str, order: str, partition: list[str], block_rows: int = 1_000_000
) -> DataFrame:
    """Replace NULLs by the last value above, per partition, in the order of an integer column.

    A sheet may hold most of the table, so its rows are cut into blocks of consecutive
    ordinals: each block is filled by itself and takes its first value from one summary row
    per block. Neither window sees more than a block, or a sheet's list of blocks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block_rows))
    inside = Window.partitionBy(*partition, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*partition).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy(*partition, "_block")
        .agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("_last"))
        .select(*partition, "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    )
    filled = F.coalesce(F.last(column, ignorenulls=True).over(inside), F.col("_carried"))
    return (
        blocked.join(carried, [*partition, "_block"], "left")
        .withColumn(column, filled)
        .select(*df.columns)
    )


def first_appearances(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of every distinct key. Pre-aggregates, so a hot key costs one row per partition."""
    row = F.struct(*[F.col(c) for c in df.columns])
    firsts = df.withColumn("_key", key).where(F.col("_key") != "")
    return firsts.groupBy("_key").agg(F.min_by(row, F.col(order)).alias("_row")).select("_row.*")
