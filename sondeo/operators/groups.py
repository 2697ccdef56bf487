"""Grouped counts and totals, top-k, and top-k with an "others" bucket.

Every function here starts from ``groupBy(label)``, whose partial aggregation turns a hot
label into one row per partition before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondeo.functions import vocabulary as V
from sondeo.functions.scoring import share
from sondeo.functions.text import clean_category, clean_text, is_noise



def _order() -> list[Column]:
    return [F.col("value").desc(), F.col("label").asc()]


def frequency(df: DataFrame, label: str) -> DataFrame:
    """(label, value): records per trimmed label, placeholders left out."""
    labels = df.select(clean_category(F.col(label)).alias("label")).where("label IS NOT NULL")
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("value"))


def totals(df: DataFrame, label: str, amount: Column, positive: bool = True) -> DataFrame:
    """(label, value): sum of an amount per trimmed label; groups at or below zero dropped."""
    pairs = df.select(clean_category(F.col(label)).alias("label"), amount.alias("value"))
    grouped = pairs.where("label IS NOT NULL AND value IS NOT NULL").groupBy("label").agg(F.sum("value").alias("value"))
    return grouped.where("value > 0") if positive else grouped


def totals_and_counts(df: DataFrame, label: str, amount: Column, counted: str) -> DataFrame:
    """(label, value, n): sum of an amount and count of another column per label."""
    pairs = df.select(clean_category(F.col(label)).alias("label"), amount.alias("value"), F.col(counted).alias("c"))
    return (
        pairs.where("label IS NOT NULL AND value IS NOT NULL")
        .groupBy("label")
        .agg(F.sum("value").alias("value"), F.count("c").alias("n"))
    )


def category_totals(df: DataFrame, categories: list[str], amounts: dict[str, Column]) -> DataFrame:
    """(column, label, n, <one sum per amount>): every categorical column in a single scan.

    Rows fan out to one per column inside the task and collapse again in its partial
    aggregation, so the shuffle carries labels, not rows. Sums are named ``s0``, ``s1``, ...
    """
    fan = F.array(*[F.struct(F.lit(c).alias("column"), clean_category(F.col(f"`{c}`")).alias("label")) for c in categories])
    sums = [f"s{i}" for i in range(len(amounts))]
    rows = df.select(*[a.alias(s) for a, s in zip(amounts.values(), sums)], F.inline(fan))
    return rows.where("label IS NOT NULL").groupBy("column", "label").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in sums]
    )


def report_groups(df: DataFrame, label: str, amount: Column | None = None) -> DataFrame:
    """Counts, or totals of ``amount``, per cleaned report label; noise labels left out."""
    cell = F.col(f"`{label}`")          # a header may hold a dot
    text = clean_text(cell)
    rows = df.where(~is_noise(cell))
    if amount is None:
        return rows.groupBy(text.alias("label")).agg(F.count(F.lit(1)).alias("value"))
    pairs = rows.select(text.alias("label"), amount.alias("value")).where("value IS NOT NULL")
    return pairs.groupBy("label").agg(F.sum("value").alias("value"))


def measure_totals(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(ord, label, value): the total of several measures in one pass, positive ones only."""
    sums = df.agg(*[F.sum(amount).alias(f"m{i}") for i, amount in enumerate(measures.values())])
    rows = [
        F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), F.col(f"m{i}").alias("value"))
        for i, label in enumerate(measures)
    ]
    return sums.select(F.inline(F.array(*rows))).where("value > 0")


def distinct_counts(df: DataFrame, columns: dict[str, Column], approximate: bool = False) -> DataFrame:
    """One row of distinct counts; exact unless a sketch will do."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(column).cast("bigint").alias(name) for name, column in columns.items()])


def top_groups(grouped: DataFrame, k: int) -> DataFrame:
    """The k largest groups, ties broken by label (a distributed top-k, never a full sort)."""
    return grouped.orderBy(*_order()).limit(k)


def ranked_top(grouped: DataFrame, k: int) -> DataFrame:
    """``top_groups`` with a 1-based ``ord``; the window sees at most k rows."""
    return top_groups(grouped, k).withColumn("ord", F.row_number().over(Window.orderBy(*_order())))


def top_with_others(grouped: DataFrame, k: int, others: str = V.OTHERS, label_length: int = 30) -> DataFrame:
    """(ord, label, value): all groups when there are at most k, else the k-1 largest and the rest as one.

    ``grouped`` is aggregated once; the exchange below it is reused by both branches.
    """
    positive = grouped.where("value > 0")
    heads = ranked_top(positive, k + 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    kept = heads.where((F.col("n") <= k) | (F.col("ord") < k)).select("label", "ord")
    joined = positive.join(F.broadcast(kept), "label", "left")
    shown = F.when(F.col("ord").isNull(), F.lit(others)).otherwise(F.substring("label", 1, label_length))
    return (
        joined.select(F.coalesce("ord", F.lit(k)).alias("ord"), shown.alias("label"), "value")
        .groupBy("ord", "label")
        .agg(F.sum("value").alias("value"))
    )


def leaders(grouped: DataFrame) -> DataFrame:
    """One row: the two largest groups with their shares, the number of groups and the total."""
    facts = grouped.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("value").alias("total"))
    return _beside(facts, ranked_top(grouped, 2)).select(
        "leader",
        "leader_value",
        share(F.col("leader_value"), F.col("total")).alias("leader_share"),
        "second",
        share(F.col("second_value"), F.col("total")).alias("second_share"),
        "n_groups",
        "total",
    )


def _beside(facts: DataFrame, top2: DataFrame) -> DataFrame:
    """Put a one-row aggregate and the first two groups into one row by a union, not a join."""
    wide = top2.agg(
        F.max(F.when(F.col("ord") == 1, F.col("label"))).alias("leader"),
        F.max(F.when(F.col("ord") == 1, F.col("value"))).alias("leader_value"),
        F.max(F.when(F.col("ord") == 2, F.col("label"))).alias("second"),
        F.max(F.when(F.col("ord") == 2, F.col("value"))).alias("second_value"),
    )
    return merge_rows(facts, wide)


def merge_rows(*one_row_tables: DataFrame) -> DataFrame:
    """Combine one-row tables with different columns into a single row."""
    stacked = one_row_tables[0]
    for table in one_row_tables[1:]:
        stacked = stacked.unionByName(table, allowMissingColumns=True)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def imbalance(grouped: DataFrame, column: str, threshold: float = 55.0) -> DataFrame:
    """The leader's row when it holds more than ``threshold`` percent of at least five records."""
    pct = F.col("leader_value") / F.col("total") * 100
    return leaders(grouped).where((F.col("total") >= 5) & (F.col("n_groups") >= 2) & (pct > threshold)).select(
        F.lit(column).alias("column"), "leader", "leader_value", "leader_share", "total"
    )


def alerts(grouped: DataFrame, k: int = 5, warning: float = 1.15, critical: float = 1.45) -> DataFrame:
    """The k largest groups, each rated against multiples of their mean."""
    from sondeo.functions.scoring import status

    top = ranked_top(grouped, k).withColumn("mean", F.avg("value").over(Window.partitionBy()))
    light = status(F.col("value"), F.col("mean") * warning, F.col("mean") * critical)
    detail = (
        F.when(light == "rojo", "Supera el umbral critico.")
        .when(light == "amarillo", "Requiere seguimiento.")
        .otherwise("Dentro del rango esperado.")
    )
    return top.select("ord", "label", "value", "mean", light.alias("status"), detail.alias("detail"))
