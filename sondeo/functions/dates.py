"""Dates: Excel serial days, lenient parsing and month buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.functions import vocabulary as V

# Year first: one digit or two, an optional time with or without seconds, fractions and zone. Spark's own cast reads these.
ISO = r"^\d{4}-\d{1,2}(-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s?(Z|[+-]\d{1,2}:\d{2})?)?)?$"

# Other accepted formats, each with the shape a text must have before it is tried. The day comes first, unless a column's vote
# (``date_votes``) says that the month does.
DATE_FORMATS = {
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d/M/yyyy H:mm": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$",
    "d/M/yyyy H:mm:ss": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "d-M-yyyy H:mm": r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}$",
    "d-M-yyyy H:mm:ss": r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}:\d{2}$",
    "d.M.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    "d.M.yyyy H:mm": r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{2}$",
    "d.M.yyyy H:mm:ss": r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{2}:\d{2}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
}

# Two numbers before the year: only these shapes leave open which of them is the month.
EITHER_ORDER = r"^(\d{1,2})([/.-])(\d{1,2})\2\d{4}( \d{1,2}:\d{2}(:\d{2})?)?$"

# Serial days outside this span are month numbers, years or amounts, not dates (1954 to 2119).
SERIAL_SPAN = (20_000, 80_000)


def from_excel_serial(c: Column) -> Column:
    """Days since 1899-12-30 to DATE; NULL where the number cannot be a plausible date."""
    days = c.try_cast("double")
    return F.when(
        days.between(*SERIAL_SPAN),
        F.date_add(F.lit(V.EXCEL_EPOCH).cast("date"), F.floor(days).cast("int")),
    )


def parse_timestamp(c: Column, dtype: T.DataType, month_first: bool = False) -> Column:
    """Lenient reading of a column as TIMESTAMP, NULL where it is not a date; ``month_first`` as its vote says."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if isinstance(dtype, T.NumericType):
        return from_excel_serial(c).cast("timestamp")
    if isinstance(dtype, T.StringType):
        text = F.trim(c)
        read = F.when(text.rlike(ISO), text.try_cast("timestamp"))
        for fmt, shape in DATE_FORMATS.items():
            said = fmt.replace("d/M", "M/d").replace("d-M", "M-d").replace("d.M", "M.d") if month_first else fmt
            read = F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(said))).otherwise(read)
        return read
    return F.lit(None).cast("timestamp")


def date_votes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, n_day, n_month, n_open, n_unread_day, n_unread_month, date_order, n_unread): how each column writes its dates.

    One aggregate over all columns. ``n`` counts filled cells; of those with two numbers before the year, ``n_day`` can only
    have the day first, ``n_month`` only the month, ``n_open`` either. The column's order is chosen once, for all its cells:
    ``day`` or ``month`` where only that one is shown, ``mixed: day`` or ``mixed: month`` by majority (a tie is the day's),
    ``undecided`` (read with the day first) where every such cell fits both, ``none`` where there is no such cell.
    ``n_unread`` counts the filled cells that are no dates in the chosen order.
    """
    def facts(name: str) -> Column:
        kind, c = df.schema[name].dataType, F.col(f"`{name}`")
        text = F.trim(c.cast("string"))
        filled = c.isNotNull() & (text != "")
        first, second = (F.regexp_extract(text, EITHER_ORDER, g).try_cast("int") for g in (1, 3))
        day, month, either = (F.lit(False),) * 3
        if isinstance(kind, T.StringType):
            day, month = first.between(13, 31) & second.between(1, 12), first.between(1, 12) & second.between(13, 31)
            either = first.between(1, 12) & second.between(1, 12)
        unread = [F.count_if(filled & parse_timestamp(c, kind, m).isNull()) for m in (False, True)]
        return F.struct(
            F.lit(name).alias("column"), F.count_if(filled).alias("n"), F.count_if(day).alias("n_day"), F.count_if(month).alias("n_month"),
            F.count_if(either).alias("n_open"), unread[0].alias("n_unread_day"), unread[1].alias("n_unread_month"))

    votes = df.agg(F.array(*[facts(c) for c in columns]).alias("x")).select(F.inline("x"))
    shown_day, shown_month, leans = F.col("n_day") > 0, F.col("n_month") > 0, F.col("n_month") > F.col("n_day")
    order = (
        F.when(shown_day & shown_month, F.when(leans, "mixed: month").otherwise("mixed: day"))
        .when(shown_month, "month").when(shown_day, "day").when(F.col("n_open") > 0, "undecided").otherwise("none"))
    return votes.withColumn("date_order", order).withColumn("n_unread", F.when(leans, F.col("n_unread_month")).otherwise(F.col("n_unread_day")))


def unread_dates(df: DataFrame, column: str) -> DataFrame:
    """One row (unread_dates): values of a column that are there but could not be read as dates in the order it votes for."""
    return date_votes(df, [column]).select(F.col("n_unread").alias("unread_dates"))


def bucket(ts: Column, unit: str = "month") -> Column:
    return F.date_trunc(unit, ts)


def bucket_label(ts: Column, unit: str = "month") -> Column:
    fmt = {"month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH", "year": "yyyy"}[unit]
    return F.date_format(ts, fmt)
