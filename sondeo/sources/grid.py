"""Raw grids: rows of untyped cells with an ordinal, before any header is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GRID_COLUMNS = ["workbook", "sheet", "row_ord", "cells"]


def as_grid(df: DataFrame, workbook: str, sheet: str, row_ord: Column, columns: list[str] | None = None) -> DataFrame:
    """Turn a table into grid rows; ``row_ord`` is the zero-based position of each row."""
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in columns or df.columns])
    return df.select(
        F.lit(workbook).alias("workbook"), F.lit(sheet).alias("sheet"), row_ord.cast("bigint").alias("row_ord"), cells.alias("cells")
    )


def read_grid(
    spark: SparkSession, path: str, workbook: str, sheet: str, ordinal: str | None = None, skip_rows: int = 0, fmt: str = "parquet"
) -> DataFrame:
    """Scan a headerless sheet, leaving out its first ``skip_rows`` rows.

    Parquet files know the position of their rows; those of several files follow one another in the
    order of their paths. Every other layout has to bring an ``ordinal`` column, because a distributed
    scan promises no order.
    """
    reader = spark.read.option("header", False) if fmt == "csv" else spark.read
    raw = reader.format(fmt).load(path)
    if ordinal is None:
        if fmt != "parquet":
            raise ValueError("only Parquet files carry row positions; name the ordinal column")
        columns = raw.columns
        placed = raw.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_place"))
        before = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
        offsets = placed.groupBy("_path").agg((F.max("_place") + 1).alias("_rows")).select("_path", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
        raw = placed.join(F.broadcast(offsets), "_path")      # a row per file, whose list the driver holds anyway
        position = F.col("_before") + F.col("_place")
    else:
        position, columns = F.col(ordinal), [c for c in raw.columns if c != ordinal]
    grid = as_grid(raw, workbook, sheet, position, columns)
    return grid.where(F.col("row_ord") >= skip_rows) if skip_rows else grid


def write_grid(grid: DataFrame, path: str) -> None:
    """Store a grid so that reading one sheet touches only that sheet's files."""
    grid.write.partitionBy("workbook", "sheet").mode("overwrite").parquet(path)
