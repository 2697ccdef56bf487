"""Row and column cleaning. Row filters stay narrow; column decisions need one aggregate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.functions import names
from sondeo.functions import vocabulary as V
from sondeo.functions.dates import from_excel_serial
from sondeo.functions.text import clean_text, contains_any, is_noise, is_placeholder
from sondeo.operators.quality import fill_rates
from sondeo.session import union_all


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _count(flags: list[Column]) -> Column:
    """How many of the conditions hold in a row."""
    return sum((f.cast("int") for f in flags), F.lit(0))


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[_col(c) for c in columns])


def drop_empty(df: DataFrame) -> DataFrame:
    """Without all-null columns and all-null rows."""
    kept = [r["column"] for r in fill_rates(df).where("n_filled > 0").orderBy("ord").collect()]
    return select_columns(df, kept).na.drop("all")


def drop_sparse_columns(df: DataFrame, minimum: float = 0.08) -> DataFrame:
    """Named columns filled to at least ``minimum``; everything if none qualifies."""
    rates = fill_rates(df).orderBy("ord").collect()
    kept = [r["column"] for r in rates if not names.is_unnamed(r["column"]) and r["n_filled"] >= minimum * r["n_rows"] and r["n_rows"]]
    return select_columns(df, kept or df.columns)


def strip_leading_empty(df: DataFrame) -> DataFrame:
    """Without the empty columns left of the first filled one."""
    rates = fill_rates(df).orderBy("ord").collect()
    first = next((r["ord"] for r in rates if r["n_filled"]), len(rates))
    return select_columns(df, df.columns[first:])


def trim_sparse_columns(df: DataFrame) -> DataFrame:
    """Generic-named columns survive only with enough readable cells; never below two columns."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~is_noise(_col(c))).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    n = one["n"]

    def needed(i: int) -> int:
        return max(1, math.ceil(n * (0.08 if i == 0 else 0.12)), 3 if n >= 8 else 2)

    kept = [c for i, c in enumerate(df.columns) if not names.is_generic_report_header(c) or one[f"c{i}"] >= needed(i)]
    return select_columns(df, kept) if len(kept) >= 2 else df


def meaningful_cells(columns: list[str]) -> Column:
    return _count([~is_noise(_col(c)) for c in columns])


def keep_informative_rows(df: DataFrame) -> DataFrame:
    """Rows with two readable cells (one in narrow tables), or with one if no row has two."""
    least = 1 if len(df.columns) <= 2 else 2
    scored = df.withColumn("_cells", meaningful_cells(df.columns))
    richest = scored.agg(F.max("_cells")).first()[0] or 0
    return scored.where(F.col("_cells") >= min(least, max(1, richest))).drop("_cells")


def remove_junk_rows(df: DataFrame) -> DataFrame:
    """Without rows in which any text cell is a template instruction."""
    flags = [contains_any(_col(c), V.JUNK_WORDS) for c in _text_columns(df)]
    return df.where(_count(flags) == 0) if flags else df


def require_keys(df: DataFrame, keys: tuple[str, ...] = V.COMMISSION_KEYS) -> DataFrame:
    """At least one key column filled, and always the first key where the table has it."""
    present = [k for k in keys if k in df.columns]
    if not present:
        return df
    kept = df.where(F.coalesce(*[_col(k).cast("string") for k in present]).isNotNull())
    return kept.where(_col(keys[0]).isNotNull()) if keys[0] in present else kept


def drop_phantom_rows(df: DataFrame, minimum: int = 1, zero: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Rows with at least ``minimum`` cells that are not placeholders."""
    return df.where(_count([~is_placeholder(_col(c), zero) for c in columns or df.columns]) >= minimum)


def fill_nulls(df: DataFrame, text: str = "—", number: float = 0) -> DataFrame:
    """Visible stand-ins for NULL. Off by default everywhere: it would bias statistics."""
    return df.na.fill(text).na.fill(number)


def fix_serial_dates(df: DataFrame) -> DataFrame:
    """Numeric columns named like dates become dates where every number in them can be an Excel day.

    The word must be a whole token of the header. A column with any other number (months, years, 20240115)
    stays as it is, so no value is ever lost. All candidates are judged in one pass.
    """
    return serial_dates_fixed([df])[0]


def serial_dates_fixed(tables: list[DataFrame]) -> list[DataFrame]:
    """The same for many tables, all judged by one job."""
    words = set(V.SERIAL_DATE_HEADERS)
    candidates = [[f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and words & set(names.semantic_key(f.name).split())] for df in tables]
    cells = [
        df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), _col(c).isNotNull().alias("filled"), from_excel_serial(_col(c)).isNotNull().alias("day")) for c in cs])))
        for i, (df, cs) in enumerate(zip(tables, candidates)) if cs
    ]
    if not cells:
        return tables
    judged = union_all(cells).where("filled").groupBy("i", "c").agg(F.bool_and("day").alias("days"))
    days = {(r["i"], r["c"]) for r in judged.where("days").collect()}
    return [
        df.select(*[from_excel_serial(_col(c)).alias(c) if (i, c) in days else _col(c) for c in df.columns]) if cs else df
        for i, (df, cs) in enumerate(zip(tables, candidates))
    ]


def truncate_text(df: DataFrame, length: int) -> DataFrame:
    shortened = set(_text_columns(df))
    return df.select(*[F.substring(_col(c), 1, length).alias(c) if c in shortened else _col(c) for c in df.columns])


def clean_rows(df: DataFrame) -> DataFrame:
    """The cleaning every sheet goes through before analysis."""
    return clean_tables([df])[0]


def clean_tables(tables: list[DataFrame]) -> list[DataFrame]:
    """The same for many sheets, in one job at most."""
    return serial_dates_fixed([require_keys(remove_junk_rows(df)) for df in tables])


def table_sample(
    df: DataFrame, order_by: list[str], family: str = "general", max_columns: int = V.MAX_TABLE_COLUMNS,
    max_rows: int = 30, text_length: int = 150, min_cells: int = 1,
) -> DataFrame:
    """The top of a table for display: chosen columns, cut text, no phantom rows."""
    columns = names.pick_columns([c for c in df.columns if c != "row_ord"], family, max_columns)
    top = df.orderBy(*order_by).limit(max_rows)
    return drop_phantom_rows(truncate_text(select_columns(top, columns), text_length), min_cells)


def main_table(df: DataFrame, ranked_columns: list[str], fixed: tuple[str, ...] = V.COMMISSION_MAIN_COLUMNS) -> DataFrame:
    """The report's main table: the fixed columns if any exist, else the most important ones."""
    columns = [c for c in fixed if c in df.columns] or ranked_columns[: V.MAX_TABLE_COLUMNS] or df.columns[: V.MAX_TABLE_COLUMNS]
    return drop_phantom_rows(truncate_text(select_columns(df, columns), 70), 2)


def is_valid_table(df: DataFrame) -> bool:
    """A real header and at least one real cell. Stops at the first such row."""
    named = [c for c in df.columns if not names.is_generic(c)]
    return bool(named) and bool(drop_phantom_rows(df, 1).limit(1).take(1))


def valid_row_count(df: DataFrame) -> DataFrame:
    """One row (valid_rows): rows with any readable text."""
    return df.agg(F.count_if(_count([clean_text(_col(c)) != "" for c in df.columns]) > 0).alias("valid_rows"))


def report_table(df: DataFrame) -> DataFrame:
    """Text cells on one line, empty rows out, uninformative rows and columns out."""
    text = df.select(*[clean_text(_col(c)).alias(c) for c in df.columns])
    filled = text.where(_count([_col(c) != "" for c in df.columns]) > 0)
    return trim_sparse_columns(keep_informative_rows(filled))


def declared_numeric_violations(df: DataFrame, sheet: str, order: str) -> DataFrame:
    """(sheet, column, row, value): the first non-number in columns whose name promises numbers.

    All rows are checked. The first offender is an aggregate, so nothing is sorted.
    """
    columns = [c for c in _text_columns(df) if any(w in c.lower() for w in V.DECLARED_NUMERIC_HEADERS)]
    offenders = []
    for i, c in enumerate(columns):
        bare = F.regexp_replace(_col(c), r"[$,\s]", "")
        wrong = (bare != "") & bare.try_cast("double").isNull() & ~F.lower(bare).isin("na", "-")
        offenders.append(F.when(wrong, F.struct(F.col(order).alias("row"), F.lit(i).alias("i"), F.lit(c).alias("column"), _col(c).alias("value"))))
    if not offenders:
        return df.sparkSession.createDataFrame([], "sheet string, column string, row bigint, value string")
    first = F.least(*offenders) if len(offenders) > 1 else offenders[0]
    return df.agg(F.min(first).alias("v")).where("v IS NOT NULL").select(
        F.lit(sheet).alias("sheet"), "v.column", F.col("v.row").cast("bigint").alias("row"), "v.value"
    )
