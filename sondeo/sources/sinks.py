"""JSON reports, organised tables, audit records and file fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.session import local_table, union_all
from sondeo.sources import chain

#: Bytes of a file that a task may hold and hash as one cell.
WHOLE = 128 << 20


def to_report_json(df: DataFrame) -> DataFrame:
    """One JSON document per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("report"))


def from_report_json(df: DataFrame, schema: str, column: str = "report") -> DataFrame:
    """Typed columns back from JSON documents; malformed ones become NULL fields."""
    return df.select(F.from_json(column, schema).alias("r")).select("r.*")


def write_reports(tables: dict[str, DataFrame], folder: str) -> None:
    """Write every result table as JSON lines under its own name."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{folder}/{name}")


def read_report(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{folder}/{name}")


def write_organised(sheets: DataFrame, tags: DataFrame, folder: str) -> None:
    """Cleaned rows by sheet, and the title / subtitle / type tags beside them."""
    sheets.write.partitionBy("sheet").mode("overwrite").parquet(f"{folder}/rows")
    tags.write.mode("overwrite").parquet(f"{folder}/sheet_tags")


def read_organised(spark: SparkSession, folder: str, sheets: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows and tags of a store, of all sheets or of those named; only their folders are listed and read.

    Sheet names are texts, also where they look like numbers or dates.
    """
    stored = spark.read.parquet(f"{folder}/rows").schema
    kinds = T.StructType([T.StructField(f.name, T.StringType() if f.name == "sheet" else f.dataType) for f in stored])
    rows, tags = spark.read.schema(kinds).parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/sheet_tags")
    if sheets is None:
        return rows, tags
    return rows.where(F.col("sheet").isin(sheets)), tags.where(F.col("sheet").isin(sheets))


def append_audit(record: DataFrame, folder: str) -> None:
    """Add records as they come; a run that is repeated is there twice. ``record_runs`` replaces it instead."""
    record.write.mode("append").json(folder)


def record_runs(records: DataFrame, folder: str, run: str = "run_id") -> None:
    """Store audit records under their run. Records of a run stored before, by a failed or repeated attempt, are replaced as a
    whole when the write commits; those of other runs stay. The session's settings are left alone."""
    keyed = records.withColumn("run_key", F.col(f"`{run}`").cast("string"))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_key").json(folder)


def recorded_runs(spark: SparkSession, folder: str, schema: str | T.StructType, runs: list[str] | None = None) -> DataFrame:
    """The stored records, of all runs or of those named; only their folders are read."""
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = spark.read.schema(T.StructType([*kinds, T.StructField("run_key", T.StringType())])).json(folder)
    return (found if runs is None else found.where(F.col("run_key").isin(runs))).drop("run_key")


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every input file. Files of up to ``WHOLE`` bytes are a cell each, longer ones are read split by split.

    Longer files are hashed when this is called; see ``chain.long_file_sha256``.
    """
    def read(paths: str | list[str]) -> DataFrame:
        return spark.read.format("binaryFile").load(paths)

    def hashed(files: DataFrame) -> DataFrame:
        return files.select("path", "length", F.sha2("content", 256).alias("sha256"))

    if not chain.resumable():
        return hashed(read(path))
    packed = F.lower("path").rlike(chain.UNPACKED).alias("packed")
    rows = read(path).where(F.col("length") > WHOLE).select("path", "length", packed).collect()
    parts = [hashed(read(path).where(F.col("length") <= WHOLE))]
    if cells := [chain.literal(r["path"]) for r in rows if r["packed"]]:
        parts.append(hashed(read(cells)))
    if lengths := {r["path"]: r["length"] for r in rows if not r["packed"]}:
        found = chain.long_file_sha256(spark, lengths)
        parts.append(local_table(spark, [(p, lengths[p], found[p]) for p in sorted(lengths)], "path string, length bigint, sha256 string"))
    return union_all(parts)
