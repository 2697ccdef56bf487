"""Currency conversion to the base currency, and how much of it could be resolved."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.functions import names
from sondeo.functions import vocabulary as V
from sondeo.functions.numbers import number_view
from sondeo.functions.scoring import currency_code

MIN_RESOLVED = 0.7


@dataclass(frozen=True)
class MoneyView:
    """How one amount column reads: original number, its currency, and the converted number."""

    column: str
    kind: str
    amount: Column
    code: Column
    converted: Column
    currency_column: str | None
    rate_column: str | None

    @property
    def unresolved(self) -> Column:
        return self.amount.isNotNull() & self.converted.isNull()


def _read(schema: T.StructType, column: str, strict: bool) -> Column:
    return number_view(F.col(f"`{column}`"), schema[column].dataType, strict)


def money_view(df: DataFrame, column: str, strict: bool = True) -> MoneyView:
    """Amount, code and rate stand in the same row, so conversion is an expression, not a join.

    Base-currency and unlabelled amounts pass; foreign ones need a positive rate.
    """
    kind = names.metric_kind(column)
    amount = _read(df.schema, column, strict)
    others = [c for c in df.columns if c != column]
    currency = names.currency_column(others) if kind == "currency" else None
    rate = names.rate_column(others) if currency else None
    if currency is None:
        return MoneyView(column, kind, amount, F.lit(None).cast("string"), amount, None, None)
    code = currency_code(F.col(f"`{currency}`"))
    quoted = _read(df.schema, rate, strict) if rate else F.lit(None).cast("double")
    converted = F.when(code.isNull() | (code == V.BASE_CURRENCY), amount).when(quoted > 0, amount * quoted)
    return MoneyView(column, kind, amount, code, converted, currency, rate)


def resolution_aggregates(view: MoneyView) -> dict[str, Column]:
    """The aggregates behind ``money_facts``, to be folded into a caller's own single pass."""
    known = view.amount.isNotNull()
    return {
        "n_amounts": F.count_if(known),
        "n_resolved": F.count_if(view.converted.isNotNull()),
        "n_unresolved": F.count_if(view.unresolved),
        "currencies": F.array_sort(F.collect_set(F.when(known, view.code))),
    }


def money_facts(df: DataFrame, columns: list[str], strict: bool = True) -> DataFrame:
    """One row per amount column: currencies met, mixed or not, resolved ratio, trusted or not."""
    views = [money_view(df, c, strict) for c in columns]
    one = df.agg(*[F.struct(*[a.alias(n) for n, a in resolution_aggregates(v).items()]).alias(f"m{i}") for i, v in enumerate(views)])
    rows = []
    for i, v in enumerate(views):
        m = F.col(f"m{i}")
        found = m["currencies"]
        mixed = F.size(found) > 1
        ratio = F.coalesce(F.try_divide(m["n_resolved"], m["n_amounts"]), F.lit(0.0))
        rows.append(F.struct(
            F.lit(v.column).alias("column"),
            F.lit(v.currency_column).cast("string").alias("currency_column"),
            F.lit(v.rate_column).cast("string").alias("rate_column"),
            F.when(F.size(found) == 0, F.array(F.lit(V.BASE_CURRENCY))).otherwise(found).alias("currencies"),
            mixed.alias("mixed_currency"),
            F.round(ratio, 3).alias("resolved_ratio"),
            m["n_unresolved"].alias("unresolved_rows"),
            (~mixed | (ratio >= MIN_RESOLVED)).alias("trusted"),
        ))
    return one.select(F.inline(F.array(*rows)))


def currency_alerts(facts: DataFrame) -> DataFrame:
    """(column, currencies, resolved_ratio, unresolved_rows): amount columns that mix currencies or could not resolve some."""
    return facts.where("mixed_currency OR unresolved_rows > 0").select("column", "currencies", "resolved_ratio", "unresolved_rows")


def financial_context(facts: DataFrame) -> DataFrame:
    """Workbook-level summary over the per-column facts (one row per amount column)."""
    return facts.agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("currencies")))).alias("currencies"),
        F.bool_or(F.col("unresolved_rows") > 0).alias("has_unresolved"),
    ).withColumn("has_mixed", F.size("currencies") > 1)
