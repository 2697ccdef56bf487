"""Pareto concentration of a category by count or by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.functions.scoring import share
from sondeo.operators.groups import frequency, ranked_top, totals
from sondeo.operators.running import running_totals


def pareto(df: DataFrame, category: str, amount: Column | None = None) -> DataFrame:
    """(label, value, rank, share, cum_share), largest group first, ties by label."""
    grouped = frequency(df, category) if amount is None else totals(df, category, amount)
    return group_shares(grouped)


def group_shares(grouped: DataFrame) -> DataFrame:
    """The same from groups already at hand."""
    order = [F.col("value").desc(), F.col("label").asc()]
    ranked = running_totals(grouped, order, "value", "running", "rank")
    total = grouped.agg(F.sum("value")).scalar()
    return ranked.select(
        "label",
        "value",
        "rank",
        share(F.col("value"), total).alias("share"),
        share(F.col("running"), total).alias("cum_share"),
    )


def pareto_summary(shares: DataFrame, category: str, measure: str = "conteo") -> DataFrame:
    """One row on how few groups hold 80 percent; no row with fewer than three groups."""
    counted = shares.agg(
        F.count(F.lit(1)).alias("n_categories"),
        F.count_if(F.col("cum_share") <= 80).alias("below_80"),
        F.max_by("label", F.struct(-F.col("rank"))).alias("leader"),
        F.max_by("share", F.struct(-F.col("rank"))).alias("leader_share"),
    ).where("n_categories >= 3")
    n80 = F.least(F.col("below_80") + 1, F.col("n_categories"))
    pct80 = F.bround(n80 / F.col("n_categories") * 100, 0)
    level = F.when(pct80 <= 25, "alta").when(pct80 <= 50, "moderada").otherwise("dispersa")
    return counted.select(
        F.lit(category).alias("category_col"),
        F.lit(measure).alias("value_col"),
        "n_categories",
        n80.alias("n80"),
        pct80.alias("pct80"),
        level.alias("concentration"),
        F.substring("leader", 1, 40).alias("leader"),
        "leader_share",
    )


def pareto_top(shares: DataFrame, k: int = 5) -> DataFrame:
    """The k leading groups, with labels cut for display."""
    return ranked_top(shares, k).select(F.substring("label", 1, 40).alias("label"), "value", "rank", "share", "cum_share")
