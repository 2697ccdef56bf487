"""Data quality: placeholders, duplicates, fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.functions import vocabulary as V
from sondeo.functions.text import is_placeholder
from sondeo.operators.groups import merge_rows


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> Column:
    """128 bits per row from two differently seeded hashes.

    Grouping on this instead of on all columns keeps the duplicate check's shuffle at
    sixteen bytes a row however wide the table is. Spark's hash skips NULLs, so each column's
    nullness is hashed with it.
    """
    parts = []
    for name in columns or df.columns:
        value = F.col(f"`{name}`")
        parts += [F.to_json(value) if "map<" in df.schema[name].dataType.simpleString() else value, F.isnull(value)]     # maps have no hash
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("sondeo"), *parts).alias("b"))


def duplicate_rows(df: DataFrame, keys: list[Column] | None = None) -> DataFrame:
    """One row (duplicate_rows): rows beyond the first of each equal group.

    Equality is on the given key expressions, or on all columns by fingerprint. The grouping
    pre-aggregates, so a group holding a third of the table shuffles one row per partition.
    """
    keyed = df.groupBy(*keys) if keys else df.groupBy(fingerprint(df).alias("_row"))
    return keyed.agg(F.count(F.lit(1)).alias("c")).agg(
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")
    )


def data_quality(df: DataFrame, source: str, zero_is_placeholder: bool = False) -> DataFrame:
    """One row of cell and row counts with a 0 to 1 score.

    Placeholders are counted in text columns; NULL and text stand-ins alike.
    """
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    flags = [F.count_if(is_placeholder(F.col(f"`{c}`"), zero_is_placeholder)) for c in text] or [F.lit(0)]
    cells = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        sum(flags[1:], flags[0]).cast("bigint").alias("placeholder_cells"),
    ).withColumn("total_cells", F.col("total_rows") * len(df.columns))
    row = merge_rows(cells, duplicate_rows(df))
    placeholder_ratio = F.coalesce(F.try_divide("placeholder_cells", "total_cells"), F.lit(0.0))
    duplicate_ratio = F.coalesce(F.try_divide("duplicate_rows", "total_rows"), F.lit(0.0))
    score = F.greatest(F.lit(0.0), 1 - placeholder_ratio * 0.55 - duplicate_ratio * 0.45)
    return row.select(
        F.lit(source).alias("source"),
        "total_rows",
        "total_cells",
        "placeholder_cells",
        F.round(placeholder_ratio, 3).alias("placeholder_ratio"),
        "duplicate_rows",
        F.round(duplicate_ratio, 3).alias("duplicate_ratio"),
        F.round(score, 3).alias("quality_score"),
    )


def sparse_measures(profile: DataFrame, minimum: float = 0.2, limit: int = 6) -> DataFrame:
    """Numeric columns missing at least a fifth of their rows, from a column profile."""
    ratio = F.col("n_missing") / F.col("n_rows")
    return (
        profile.where((F.col("role") == "numerico") & (ratio >= minimum))
        .orderBy(F.desc("importance"), "ord")
        .limit(limit)
        .select("column", F.round(ratio, 3).alias("missing_ratio"))
    )


def fill_rates(df: DataFrame) -> DataFrame:
    """(column, ord, n_filled, n_rows): non-blank cells per column, in one pass."""
    def filled(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.count_if(F.trim(c) != "") if isinstance(f.dataType, T.StringType) else F.count(c)

    one = df.agg(F.count(F.lit(1)).alias("n"), *[filled(f).alias(f"c{i}") for i, f in enumerate(df.schema)])
    rows = [
        F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("ord"), F.col(f"c{i}").alias("n_filled"), F.col("n").alias("n_rows"))
        for i, f in enumerate(df.schema)
    ]
    return one.select(F.inline(F.array(*rows)))


def passes_fill_gate(df: DataFrame, minimum: float = V.MIN_FILL_RATIO) -> DataFrame:
    """One row: share of filled cells and whether it reaches the gate."""
    ratio = F.try_divide(F.sum("n_filled"), F.sum("n_rows"))
    return fill_rates(df).agg(F.round(ratio, 4).alias("fill_ratio"), (ratio >= minimum).alias("accepted"))
