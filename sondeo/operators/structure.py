"""Finding the real header of raw grids, for all sheets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo import session
from sondeo.functions import names
from sondeo.operators.quality import fill_rates

HEADER_CANDIDATES = 20
TAG_ROWS = 8
SHEET = ["workbook", "sheet"]


def _filled(cell: Column) -> Column:
    return F.coalesce(F.trim(cell) != "", F.lit(False))


def _header_cell(cell: Column) -> Column:
    return _filled(cell) & ~cell.startswith("Unnamed") & ~cell.rlike("TITLE:|TYPE:")


def drop_blank_rows(grid: DataFrame) -> DataFrame:
    return grid.where(F.exists("cells", _filled))


def detect_headers(grid: DataFrame, rule: str = "fullest") -> DataFrame:
    """(workbook, sheet, header_row, header) per sheet, from its first twenty rows.

    ``fullest`` takes the row with the most usable cells, the earliest on a tie, and needs at
    least two. ``first`` takes the first row with two filled cells, else the first row.
    The ordinal filter reaches the scan, so only the top of each sheet is read.
    """
    top = grid.where(F.col("row_ord") < HEADER_CANDIDATES)
    row = F.struct("row_ord", "cells")
    if rule == "fullest":
        counted = top.withColumn("n", F.size(F.filter("cells", _header_cell))).where("n >= 2")
        best = counted.groupBy(*SHEET).agg(F.max_by(row, F.struct(F.col("n"), -F.col("row_ord"))).alias("best"))
    else:
        wide = F.size(F.filter("cells", _filled)) >= 2
        best = drop_blank_rows(top).groupBy(*SHEET).agg(F.min_by(row, F.struct(~wide, F.col("row_ord"))).alias("best"))
    return best.select(*SHEET, F.col("best.row_ord").alias("header_row"), F.col("best.cells").alias("header"))


def body_rows(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Non-blank rows below each sheet's header.

    The header side has one row per sheet; while it is proven small it goes to the grid, so that a large
    sheet is not moved to one task.
    """
    below = grid.join(session.small_side(headers.select(*SHEET, "header_row")), SHEET).where(F.col("row_ord") > F.col("header_row"))
    return drop_blank_rows(below).select("workbook", "sheet", "row_ord", "cells")


def sheet_tags(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """(workbook, sheet, title, subtitle, type) from the tag rows and lone cells above the header."""
    above = (
        grid.where(F.col("row_ord") < TAG_ROWS)
        .join(headers.select(*SHEET, "header_row"), SHEET)
        .where(F.col("row_ord") < F.col("header_row"))
        .withColumn("text", F.trim(F.get("cells", F.lit(0))))
        .withColumn("tag", F.regexp_extract(F.upper("text"), "^(TITLE|SUBTITLE|TYPE):", 1))
        .withColumn("content", F.trim(F.regexp_replace("text", "(?i)^(TITLE|SUBTITLE|TYPE):", "")))
    )
    lone = (F.col("tag") == "") & (F.size(F.filter("cells", _filled)) == 1) & (F.length("text") > 3)

    def last(tag: str) -> Column:
        return F.max_by(F.when(F.col("tag") == tag, F.col("content")), F.when(F.col("tag") == tag, F.col("row_ord")))

    seen = above.groupBy(*SHEET).agg(
        last("TITLE").alias("title_tag"),
        last("SUBTITLE").alias("subtitle_tag"),
        last("TYPE").alias("type"),
        # At most TAG_ROWS entries per sheet.
        F.array_sort(F.collect_list(F.when(lone, F.struct("row_ord", "content")))).alias("lone"),
        F.min(F.when((F.col("tag") == "TITLE") | lone, F.col("row_ord"))).alias("named_at"),
    )
    first_lone = F.get("lone", F.lit(0))["content"]
    later_lone = F.get(F.filter("lone", lambda x: x["row_ord"] > F.col("named_at")), F.lit(0))["content"]
    return seen.select(
        *SHEET,
        F.coalesce("title_tag", first_lone).alias("title"),
        F.coalesce("subtitle_tag", later_lone).alias("subtitle"),
        "type",
    )


def materialize(grid: DataFrame, workbook: str, sheet: str, rule: str = "fullest", keep_order: bool = True) -> DataFrame:
    """One sheet as a table: named columns, header and rows above it gone, empty columns dropped.

    One header row comes to the driver; the data stay where they are.
    """
    one = grid.where((F.col("workbook") == workbook) & (F.col("sheet") == sheet))
    found = detect_headers(one, rule).first()
    width = len(found["header"]) if found else one.agg(F.max(F.size("cells"))).first()[0]
    columns = names.unique_names(found["header"] if found else [None] * width)
    rows = drop_blank_rows(one.where(F.col("row_ord") > (found["header_row"] if found else -1)))
    cells = [F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(columns)]
    table = rows.select("row_ord", *[F.when(F.trim(c) != "", c).alias(name) for c, name in zip(cells, columns)])
    kept = [r["column"] for r in fill_rates(table.drop("row_ord")).where("n_filled > 0").orderBy("ord").collect()]
    return table.select(*(["row_ord"] if keep_order else []), *[F.col(f"`{c}`") for c in kept])
