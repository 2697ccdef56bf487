"""Periodic totals and the direction they take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondeo.functions import vocabulary as V
from sondeo.functions.dates import bucket, bucket_label

SWING = 10.0
MIN_DATED = 3


def periodic_totals(df: DataFrame, ts: Column, amount: Column, unit: str = "month") -> DataFrame:
    """(period, value): total per calendar period; nothing where fewer than three rows have date and value.

    The calendar bounds the number of rows.
    """
    rows = df.select(bucket(ts, unit).alias("period"), amount.alias("value"))
    totals = rows.where("period IS NOT NULL AND value IS NOT NULL").groupBy("period").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return totals.withColumn("n", F.sum("n").over(Window.partitionBy())).where(F.col("n") >= MIN_DATED).drop("n")


def trend_summary(periods: DataFrame) -> DataFrame:
    """One row: mean of the first half against the mean of the last half of the periods.

    With an odd number of periods the middle one belongs to neither half. No row for fewer
    than two periods.
    """
    calendar = Window.orderBy("period")
    placed = periods.select(
        "value",
        F.row_number().over(calendar).alias("place"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n_periods"),
    )
    half = F.greatest(F.lit(1), F.floor(F.col("n_periods") / 2))
    first, last = F.col("place") <= half, F.col("place") > F.col("n_periods") - half
    means = placed.agg(
        F.max("n_periods").alias("n_periods"),
        F.avg(F.when(first, F.col("value"))).alias("mean_start"),
        F.avg(F.when(last, F.col("value"))).alias("mean_end"),
    ).where("n_periods >= 2")
    start, end = F.col("mean_start"), F.col("mean_end")
    change = F.coalesce(F.bround(F.try_divide(end - start, F.abs(start)) * 100, 1), F.lit(0.0))
    direction = F.when(change > SWING, "creciente").when(change < -SWING, "decreciente").otherwise("estable")
    return means.select(
        direction.alias("direction"),
        change.alias("change_pct"),
        F.round(start, 2).alias("mean_start"),
        F.round(end, 2).alias("mean_end"),
        "n_periods",
    )


def last_periods(periods: DataFrame, k: int = V.MAX_CATEGORIES, unit: str = "month") -> DataFrame:
    """(ord, label, value): the last k periods in calendar order."""
    recent = periods.orderBy(F.desc("period")).limit(k)
    return recent.select(
        F.row_number().over(Window.orderBy("period")).alias("ord"),
        bucket_label(F.col("period"), unit).alias("label"),
        "value",
    )


def before_after(summary: DataFrame, measure: str) -> DataFrame:
    """The same two means, laid out as a comparison."""
    return summary.select(
        F.lit(measure).alias("measure"),
        F.col("mean_start").alias("before_value"),
        F.col("mean_end").alias("after_value"),
        F.col("change_pct").alias("delta_pct"),
        F.when(F.col("change_pct") > 0, "mejora").otherwise("ajuste").alias("verdict"),
    )
