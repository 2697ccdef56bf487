"""IQR outliers for all numeric columns of a table at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sondeo.operators.quantiles import exact_quantiles

MIN_VALUES = 8
REACH = 1.5
EXAMPLES = 3

SCHEMA = "column string, n bigint, n_outliers bigint, pct double, lower double, upper double, min_outlier double, max_outlier double, examples array<double>"


def fences(quartiles: dict[str, list[float | None]]) -> dict[str, tuple[float, float]]:
    """Lower and upper fence per column with a positive interquartile range."""
    out = {}
    for name, (q1, *_, q3) in quartiles.items():
        if q1 is not None and q3 > q1:
            out[name] = (q1 - REACH * (q3 - q1), q3 + REACH * (q3 - q1))
    return out


def outliers(
    df: DataFrame,
    columns: dict[str, Column],
    quartiles: dict[str, list[float | None]] | None = None,
    sortable_values: int | None = None,
) -> DataFrame:
    """One row per column that has outliers; columns with fewer than eight values are skipped.

    Fences are a pair of numbers per column, so they enter the second pass as literals.
    """
    quartiles = quartiles or exact_quantiles(df, columns, (0.25, 0.75), sortable_values=sortable_values)
    bounds = fences(quartiles)
    if not bounds:
        return df.sparkSession.createDataFrame([], SCHEMA)
    names = list(bounds)
    views = df.select(*[columns[name].cast("double").alias(f"v{i}") for i, name in enumerate(names)])

    def outside(i: int) -> Column:
        lower, upper = bounds[names[i]]
        return (F.col(f"v{i}") < lower) | (F.col(f"v{i}") > upper)

    facts = views.agg(*[
        F.struct(
            F.lit(name).alias("column"),
            F.count(f"v{i}").alias("n"),
            F.count_if(outside(i)).alias("n_outliers"),
            F.lit(bounds[name][0]).alias("lower"),
            F.lit(bounds[name][1]).alias("upper"),
            F.min(F.when(outside(i), F.col(f"v{i}"))).alias("min_outlier"),
            F.max(F.when(outside(i), F.col(f"v{i}"))).alias("max_outlier"),
        ).alias(f"f{i}")
        for i, name in enumerate(names)
    ]).select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(names))])))

    # Only outliers become long rows. Spark limits each partition to the best three per
    # column before the shuffle (WindowGroupLimit), so no task receives a whole column.
    cells = F.array(*[F.when(outside(i), F.struct(F.lit(name).alias("column"), F.col(f"v{i}").alias("value"))) for i, name in enumerate(names)])
    largest = (
        views.select(F.inline(cells)).where("column IS NOT NULL")
        .withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("value"))))
        .where(F.col("place") <= EXAMPLES)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list("value"), asc=False).alias("examples"))
    )
    kept = facts.where((F.col("n") >= MIN_VALUES) & (F.col("n_outliers") > 0))
    return kept.join(F.broadcast(largest), "column").select(
        "column",
        "n",
        "n_outliers",
        F.bround(F.col("n_outliers") / F.col("n") * 100, 1).alias("pct"),
        F.round("lower", 2).alias("lower"),
        F.round("upper", 2).alias("upper"),
        "min_outlier",
        "max_outlier",
        "examples",
    )
