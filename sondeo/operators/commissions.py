"""The travel-commission workbook: executive summary and its five charts.

Column names are parameters, so the same analysis serves any table of that shape.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.functions import vocabulary as V
from sondeo.operators.charts import chart, stack
from sondeo.operators.groups import frequency, measure_totals, ranked_top, top_with_others, totals, totals_and_counts
from sondeo.operators.money import money_view, resolution_aggregates


@dataclass(frozen=True)
class CommissionColumns:
    key: str = "Id Comisión"
    person: str = "Solicitante"
    amount: str = "Valor Total Solicitado"
    city: str = "Ciudad Destino"
    state: str = "Estado"
    centre: str = "Centro de Costos"


def is_commissions(columns: list[str]) -> bool:
    return all(c in columns for c in V.COMMISSION_MARKERS)


def executive_summary(df: DataFrame, cols: CommissionColumns = CommissionColumns(), approximate: bool = False) -> DataFrame:
    """One row: size, total, distinct people, cities and centres, mean and maximum."""
    view = money_view(df, cols.amount)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    centre = F.when(F.length(F.trim(F.col(f"`{cols.centre}`").cast("string"))) > 1, F.col(f"`{cols.centre}`"))
    facts = resolution_aggregates(view)
    one = df.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.coalesce(F.sum(view.converted), F.lit(0.0)).alias("total"),
        distinct(F.col(f"`{cols.person}`")).alias("n_people"),
        distinct(F.col(f"`{cols.city}`")).alias("n_cities"),
        distinct(centre).alias("n_centres"),
        F.max(view.converted).alias("max_amount"),
        F.try_divide(facts["n_resolved"], facts["n_amounts"]).alias("resolved_ratio"),
        facts["currencies"].alias("currencies"),
    )
    return one.select(
        "n_records", "total", "n_people", "n_cities", "n_centres",
        F.coalesce(F.try_divide("total", "n_records"), F.lit(0.0)).alias("mean_amount"),
        F.coalesce("max_amount", F.lit(0.0)).alias("max_amount"),
        F.round("resolved_ratio", 3).alias("resolved_ratio"),
        F.when(F.size("currencies") == 0, F.array(F.lit(V.BASE_CURRENCY))).otherwise(F.col("currencies")).alias("currencies"),
    )


def generic_summary(df: DataFrame, source: str, measures: list[str], max_measures: int | None = 8, max_columns: int | None = 12) -> DataFrame:
    """One row: rows, columns and the first names of each; None names all."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(source).alias("source"), "n_rows", F.lit(len(df.columns)).alias("n_cols"),
        F.array(*map(F.lit, measures[:max_measures])).cast("array<string>").alias("measures"), F.array(*map(F.lit, df.columns[:max_columns])).alias("columns"),
    )


def expense_totals(df: DataFrame, measures: dict[str, str] = V.COMMISSION_EXPENSES) -> DataFrame:
    """(ord, label, value): converted total of each expense column the table has."""
    return measure_totals(df, {label: money_view(df, c).converted for label, c in measures.items() if c in df.columns})


def top_people(df: DataFrame, cols: CommissionColumns = CommissionColumns(), k: int = 8) -> DataFrame:
    """(ord, label, value, n): the k people with the largest totals and their number of records."""
    counted = cols.key if cols.key in df.columns else cols.person
    return ranked_top(totals_and_counts(df, cols.person, money_view(df, cols.amount).converted, counted), k)


def commission_charts(df: DataFrame, cols: CommissionColumns = CommissionColumns(), expenses: dict[str, str] = V.COMMISSION_EXPENSES) -> DataFrame:
    """``chart_data`` rows by state, expense type, city, person and cost centre."""
    amount = money_view(df, cols.amount).converted
    parts = []
    if cols.state in df.columns:
        parts.append(chart(top_with_others(frequency(df, cols.state), V.MAX_PIE), "estados"))
    if any(c in df.columns for c in expenses.values()):
        parts.append(chart(expense_totals(df, expenses), "gastos"))
    if cols.city in df.columns:
        parts.append(chart(top_with_others(frequency(df, cols.city), V.MAX_BAR, label_length=25), "ciudades"))
    parts.append(chart(top_people(df, cols), "solicitantes"))
    if cols.centre in df.columns:
        parts.append(chart(top_with_others(totals(df, cols.centre, amount, positive=False), V.MAX_BAR), "centros"))
    return stack(parts)
