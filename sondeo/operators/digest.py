"""Digests of what tables hold: the same for the same rows in any order, files and partitions.

A row is written as text and hashed; the first and the second 60 bits of its hash are summed over all rows. Sums merge, so
tasks add up their rows and a row for each task moves; no file or column is ever held in one place. Equal rows count as
often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.session import union_all

#: Hexadecimal digits of md5 in each of the two sums, and what stands for NULL and between cells (controls, which SQL can write).
DIGITS, NULL, BETWEEN = 15, "\x01", "\x02"


def cell_text(df: DataFrame, name: str) -> Column:
    """A cell as text: instants as microseconds and days as days since 1970, arrays element by element, all else as Spark writes it."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.to_json(F.struct(c.alias("x"))), F.lit(NULL))
    return F.coalesce(c.cast("string"), F.lit(NULL))


def _sums(hashed: Column) -> list[Column]:
    def part(start: int) -> Column:
        return F.sum(F.conv(F.substring(hashed, start, DIGITS), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)"))

    return [F.coalesce(part(1), F.lit(0).cast("decimal(38,0)")).cast("string").alias("sum_1"), F.coalesce(part(1 + DIGITS), F.lit(0).cast("decimal(38,0)")).cast("string").alias("sum_2")]


def table_digest(df: DataFrame) -> DataFrame:
    """(n_rows, sum_1, sum_2, digest): one row. The digest is sha256 of the columns' names, the count and both sums."""
    columns = sorted(df.columns)
    row = F.concat_ws(BETWEEN, *[cell_text(df, c) for c in columns])
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *_sums(F.md5(row)))
    return one.withColumn("digest", F.sha2(F.concat_ws(BETWEEN, F.lit(",".join(columns)), F.col("n_rows").cast("string"), "sum_1", "sum_2"), 256))


def column_digests(df: DataFrame) -> DataFrame:
    """(column, n_filled, sum_1, sum_2): one row per column, all from one scan, so that a changed table shows where."""
    facts = F.array(*[F.struct(F.lit(c).alias("column"), F.count(F.col(f"`{c}`")).alias("n_filled"), *_sums(F.md5(cell_text(df, c)))) for c in df.columns])
    return df.agg(facts.alias("x")).select(F.inline("x"))


def input_digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(path, sha256): the digest of each input by name, as an audit records it."""
    return union_all([table_digest(df).select(F.lit(name).alias("path"), F.col("digest").alias("sha256")) for name, df in tables.items()])
