"""Small scoring expressions shared by reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sondeo.functions import vocabulary as V


def status(value: Column, warning: Column | float, critical: Column | float) -> Column:
    """Traffic light; an unknown value is amber."""
    return (
        F.when(value.isNull(), F.lit("amarillo"))
        .when(value >= critical, F.lit("rojo"))
        .when(value >= warning, F.lit("amarillo"))
        .otherwise(F.lit("verde"))
    )


def clamp(score: Column, low: float = 0.0, high: float = 0.99) -> Column:
    return F.greatest(F.lit(low), F.least(score, F.lit(high)))


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.8, "Alta").when(score >= 0.62, "Media").otherwise("Baja")


def share(part: Column, whole: Column) -> Column:
    """Percentage, half-even at one decimal."""
    return F.bround(F.try_divide(part, whole) * 100, 1)


def currency_code(c: Column) -> Column:
    """Free text to COP / USD / EUR / GBP, COP tested first; NULL when none is named."""
    text = F.upper(c.cast("string"))
    code = F.lit(None).cast("string")
    for name, marks in reversed(V.CURRENCY_MARKS.items()):
        quoted = "|".join(rf"\Q{m}\E" for m in marks)
        code = F.when(text.rlike(quoted), F.lit(name)).otherwise(code)
    return code
