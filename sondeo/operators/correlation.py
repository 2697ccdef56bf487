"""Pearson correlation of every pair of numeric columns, in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_PAIRS = 5
NOTABLE = 0.5
STRONG = 0.8


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows where both are present; NULL (not an error) for a constant column."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def pair_moments(df: DataFrame, columns: list[Column]) -> DataFrame:
    """(i, j, n, r) of every pair i < j of ``columns`` that some row has both of: complete rows and correlation.

    One scan for any number of columns. A row's pairs come apart inside the task and go into partial sums of their
    pair (count, means and co-moments, which merge), so a row for each task and pair is all that moves.
    """
    k = len(columns)
    views = df.select(F.array(*[c.cast("double") for c in columns]).alias("v"))
    first = views.select("v", F.posexplode("v").alias("i", "a")).where("a IS NOT NULL")
    both = first.select("i", "a", F.posexplode(F.slice("v", F.col("i") + 2, F.lit(k))).alias("d", "b")).where("b IS NOT NULL")
    return both.groupBy("i", (F.col("i") + 1 + F.col("d")).alias("j")).agg(pearson(F.col("a"), F.col("b")).alias("r"), F.count(F.lit(1)).alias("n"))


def _named(index: str, labels: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, labels)), F.col(index))


def correlations(df: DataFrame, columns: dict[str, Column], top: int = 5, minimum: float = NOTABLE) -> DataFrame:
    """The ``top`` pairs by absolute correlation, at least ``minimum``, over five or more rows."""
    labels = list(columns)
    if len(labels) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double, label string, n bigint")
    long = pair_moments(df, list(columns.values())).select(_named("i", labels).alias("col_a"), _named("j", labels).alias("col_b"), "r", "n")
    sign = F.when(F.col("r") > 0, "positiva").otherwise("negativa")
    strength = F.when(F.abs("r") >= STRONG, "fuerte").otherwise("moderada")
    found = long.where((F.col("n") >= MIN_PAIRS) & (F.abs("r") >= minimum))
    return (
        found.orderBy(F.abs("r").desc(), "col_a", "col_b")
        .limit(top)
        .select("col_a", "col_b", F.bround("r", 3).alias("r"), F.concat_ws(" ", sign, strength).alias("label"), "n")
    )
