"""Readers for the two special sheet layouts and the secondary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.functions import names
from sondeo.functions import vocabulary as V
from sondeo.functions.numbers import number_view
from sondeo.functions.text import contains_any, is_placeholder
from sondeo.operators.cleaning import strip_leading_empty, table_sample
from sondeo.operators.running import forward_fill

# Fixed values of the control-evaluation layout.
HIERARCHY_SKIP_ROWS = 3
HIERARCHY_HEADER_ROWS = 10
HIERARCHY_HEADER_WORDS = ("componente", "item", "evalua", "punto de control", "control")
HIERARCHY_ITEM_WORDS = ("item", "evalua", "punto de control")
HIERARCHY_GROUP_WORDS = ("componente", "evalua")
PENDING = "Pendiente de evaluacion"
HIERARCHY_COLUMNS = ("Componente", "Ítems Evaluados", "Estado", "Acción Recomendada")


def read_hierarchy(grid: DataFrame, skip_rows: int = HIERARCHY_SKIP_ROWS, block_rows: int = 1_000_000) -> DataFrame | None:
    """Group / item / status / action rows of one sheet whose group cells were merged.

    Merged cells arrive as NULLs below their first row and are filled downwards. Header
    echoes and short items are dropped, an empty status reads as pending.
    """
    rows = grid.where(F.col("row_ord") >= skip_rows)
    joined = F.concat_ws(" ", "cells")
    candidates = rows.where(F.col("row_ord") < skip_rows + HIERARCHY_HEADER_ROWS)
    hit = contains_any(joined, HIERARCHY_HEADER_WORDS)
    top = candidates.agg(F.coalesce(F.min(F.when(hit, F.col("row_ord"))), F.min("row_ord")).alias("h"), F.max(F.size("cells")).alias("w")).first()
    if top["h"] is None:
        return None
    cells = [F.get("cells", F.lit(i)) for i in range(top["w"])]
    body = rows.where(F.col("row_ord") > top["h"]).select("row_ord", *[F.when(F.trim(c) != "", c).alias(f"c{i}") for i, c in enumerate(cells)])
    columns = strip_leading_empty(body.drop("row_ord")).columns
    if len(columns) < 3:
        return None
    group, item, status = columns[:3]
    sheet = body.withColumn("_sheet", F.lit(0)).select("_sheet", "row_ord", *columns[:4])
    filled = forward_fill(sheet, group, "row_ord", ["_sheet"], block_rows)
    kept = (
        filled.where(F.length(F.trim(item)) > 3)
        .where(~contains_any(F.col(item), HIERARCHY_ITEM_WORDS) & ~contains_any(F.col(group), HIERARCHY_GROUP_WORDS))
    )
    stated = F.when(is_placeholder(F.col(status), zero=True), PENDING).otherwise(F.trim(status))
    parts: list[Column] = [F.substring(group, 1, 80), F.substring(F.trim(item), 1, 120), F.substring(stated, 1, 60)]
    if len(columns) > 3:
        parts.append(F.substring(F.trim(columns[3]), 1, 120))
    return kept.select("row_ord", *[p.alias(n) for p, n in zip(parts, HIERARCHY_COLUMNS)])


def read_first_column(grid: DataFrame, rows: int = 12, name: str = "Centro de Costos") -> DataFrame:
    """The first ``rows`` filled cells of the first column below the top row, in order."""
    body = grid.where(F.exists("cells", lambda c: c.isNotNull()))
    first = body.agg(F.min("row_ord")).scalar()
    cell = F.get("cells", F.lit(0))
    listed = body.where((F.col("row_ord") > first) & cell.isNotNull())
    return listed.orderBy("row_ord").limit(rows).select("row_ord", cell.alias(name))


def progress_column(columns: list[str]) -> str | None:
    return next((c for c in columns if c.strip() == "%" or names.mentions(c, V.PROGRESS_HEADERS)), None)


def progress_status(df: DataFrame, progress: Column) -> DataFrame:
    """One row: items done (at least 1), under way, pending, and the mean."""
    p = F.col("p")
    # Projected first, so each text is parsed once however many figures read the number.
    return df.select(F.coalesce(progress, F.lit(0.0)).alias("p")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(p >= 1).alias("done"),
        F.count_if((p > 0) & (p < 1)).alias("under_way"),
        F.count_if(p == 0).alias("pending"),
        F.round(F.avg(p), 4).alias("mean_progress"),
    )


def progress_values(df: DataFrame, column: str) -> Column:
    """Progress as a fraction: a column on the 0 to 100 scale is divided by 100."""
    v = number_view(F.col(f"`{column}`"), df.schema[column].dataType)
    top = df.agg(F.max(v)).scalar()
    return F.when(top > 1.2, v / 100).otherwise(v)


def secondary_table(df: DataFrame, order_by: list[str], family: str) -> DataFrame:
    """The table shown for a sheet that is not the main one."""
    if family in ("hallazgos", "oportunidades"):
        return table_sample(df, order_by, family, max_columns=6, max_rows=50, text_length=200)
    return table_sample(df, order_by, family)


def finding_bullets(df: DataFrame, column: str, order_by: list[str], limit: int = 8) -> DataFrame:
    """(ord, text): the first readable entries of a findings column."""
    text = F.substring(F.regexp_replace(F.col(f"`{column}`"), r"_x000d_(\\n)?", " "), 1, 120)
    listed = df.select(*order_by, text.alias("text")).where((F.length("text") > 5) & ~F.col("text").isin("—", "ù"))
    return listed.orderBy(*order_by).limit(limit).select("text")
