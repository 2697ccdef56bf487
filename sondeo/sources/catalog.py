"""A workbook as a catalog of lazily scanned tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondeo.functions.text import semantic_text
from sondeo.operators.profile import profilable
from sondeo.session import local_table, settle, shared_path, union_all

SIGNATURE_HEADERS, SIGNATURE_ROWS, SIGNATURE_CELLS = 10, 4, 4


@dataclass
class Sheet:
    """One table of a workbook. ``order_by`` is its row order, where it has one."""

    name: str
    df: DataFrame
    order_by: list[str] = field(default_factory=list)


@dataclass
class Catalog:
    """Sheets in workbook order, and what could not be read."""

    workbook: str
    sheets: dict[str, Sheet]
    errors: dict[str, str] = field(default_factory=dict)
    rejected: DataFrame | None = None      # records that could not be read, where schemas were given


def load_catalog(
    spark: SparkSession, workbook: str, paths: dict[str, str], fmt: str = "parquet",
    order_by: dict[str, list[str]] | None = None, schemas: dict[str, str] | None = None, **options,
) -> Catalog:
    """Scan every path lazily; an unreadable one is reported instead of raised.

    A sheet of records (CSV, JSON) with a schema in ``schemas`` is read once and stored; records that do not fit go to
    ``rejected`` instead of becoming rows of NULLs.
    """
    sheets, errors, rejected = {}, {}, []
    for name, path in paths.items():
        try:
            if name in (schemas or {}):
                df, refused = split_records(spark, path, fmt, schemas[name], **options)
                rejected.append(refused.select(F.lit(name).alias("sheet"), "file", "block_start", "record"))
            else:
                df = spark.read.format(fmt).options(**options).load(path)
            sheets[name] = Sheet(name, df, (order_by or {}).get(name, []))
        except (PySparkException, Py4JJavaError) as problem:      # a missing path, or a file of another kind
            errors[name] = (problem.getCondition() if isinstance(problem, PySparkException) else None) or str(problem).splitlines()[0]
    return Catalog(workbook, sheets, errors, union_all(rejected) if rejected else None)


def split_records(spark: SparkSession, path: str, fmt: str, schema: str, **options) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and (file, block_start, record) of what does not: the text as it stands, with the file and the
    part of it that the task read.

    One scan writes both, side by side, to a new table in the shared folder; what is read afterwards cannot fail any more.
    """
    wanted = T.StructType.fromDDL(schema)
    record = T.StructField("refused record", T.StringType())
    scan = spark.read.format(fmt).options(**options).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", record.name)
    found = scan.schema(T.StructType([*wanted, record])).load(path)
    told = found.select(
        F.struct(*[F.col(f"`{f.name}`") for f in wanted]).alias("row"), F.col(f"`{record.name}`").alias("record"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"))
    folder = shared_path(spark, "records")
    told.withColumn("fits", F.col("record").isNull()).write.partitionBy("fits").parquet(folder)
    kinds = T.StructType([*told.schema, T.StructField("fits", T.BooleanType())])
    back = spark.read.schema(kinds).parquet(folder)
    return back.where("fits").select("row.*"), back.where("not fits").select("file", "block_start", "record")


def sort_place(df: DataFrame, order_by: list[str]) -> Column:
    """The order of a row as a value of one type, whatever the types of the key: whole numbers, other numbers, texts."""
    def part(name: str) -> Column:
        kind, c = df.schema[name].dataType, F.col(f"`{name}`")
        none = {"whole": F.lit(None).cast("bigint"), "number": F.lit(None).cast("double"), "text": F.lit(None).cast("string")}
        if isinstance(kind, (T.IntegralType, T.BooleanType)):
            none["whole"] = c.cast("bigint")
        elif isinstance(kind, T.TimestampType):
            none["whole"] = F.unix_micros(c)
        elif isinstance(kind, T.DateType):
            none["whole"] = F.unix_date(c).cast("bigint")
        elif isinstance(kind, T.NumericType):
            none["number"] = c.cast("double")
        else:
            none["text"] = c.cast("string")
        return F.struct(*[value.alias(field) for field, value in none.items()])

    places = [part(name) for name in order_by]
    return F.array(*places) if places else F.array().cast("array<struct<whole: bigint, number: double, text: string>>")


def sheet_table(catalog: Catalog) -> DataFrame:
    """(workbook, sheet, ord, n_rows, n_cols, headers, signature): one row per sheet.

    The signature joins the name, the first headers and a few cells of the first rows; it is
    what the family rules read.
    """
    sheets = list(catalog.sheets.values())
    edges = _edges(sheets)
    sized = union_all([sheet.df.select(F.lit(i).alias("ord")) for i, sheet in enumerate(sheets)]).groupBy("ord").agg(F.count(F.lit(1)).alias("n_rows"))
    rank = F.row_number().over(Window.partitionBy("ord").orderBy("place"))
    tops = union_all([_lines(i, sheet, edges.get(i)) for i, sheet in enumerate(sheets)]).withColumn("rank", rank).where(F.col("rank") <= SIGNATURE_ROWS)
    # of at most SIGNATURE_ROWS lines a sheet
    samples = tops.groupBy("ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), " ").alias("sample"))
    heads = [tuple([i, sheet.name, sheet.df.columns, " ".join((sheet.name, *sheet.df.columns[:SIGNATURE_HEADERS]))]) for i, sheet in enumerate(sheets)]
    named = local_table(catalog_session(catalog), heads, "ord int, sheet string, headers array<string>, said string")
    joined = named.join(sized, "ord", "left").join(samples, "ord", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    line = F.concat_ws(" ", semantic_text(F.col("said")), F.col("sample"))
    return settle(joined.select(
        F.lit(catalog.workbook).alias("workbook"), "sheet", "ord", "n_rows", F.size("headers").alias("n_cols"), "headers",
        F.regexp_replace(F.trim(line), " +", " ").alias("signature")))


def catalog_session(catalog: Catalog) -> SparkSession:
    return next(iter(catalog.sheets.values())).df.sparkSession


def _edges(sheets: list[Sheet]) -> dict[int, object]:
    """The last key among the first rows of each ordered sheet, as its place; one job reads the keys of all."""
    ordered = [(i, sheet) for i, sheet in enumerate(sheets) if sheet.order_by]
    if not ordered:
        return {}
    keys = union_all([sheet.df.select(F.lit(i).alias("ord"), sort_place(sheet.df, sheet.order_by[:1]).alias("place")) for i, sheet in ordered])
    rank = F.row_number().over(Window.partitionBy("ord").orderBy("place"))
    return {r["ord"]: r["edge"][0] for r in keys.withColumn("rank", rank).where(F.col("rank") <= SIGNATURE_ROWS).groupBy("ord").agg(F.max("place").alias("edge")).collect()}


def _lines(position: int, sheet: Sheet, edge) -> DataFrame:
    """(ord, place, line): the rows of a sheet that can be among its first. The key alone was ordered; texts are read only where the key
    can be among the first, which the scan's statistics narrow to a few row groups."""
    df = sheet.df
    if edge is not None:
        key, value = F.col(f"`{sheet.order_by[0]}`"), next((v for v in edge if v is not None), None)
        if value is not None:
            kind = df.schema[sheet.order_by[0]].dataType
            last = F.timestamp_micros(F.lit(value)) if isinstance(kind, T.TimestampType) else F.date_from_unix_date(F.lit(value).cast("int")) if isinstance(kind, T.DateType) else F.lit(value)
            df = df.where(key.isNull() | (key <= last))
    shown = [c for c in df.columns if c in profilable(sheet.df)][:SIGNATURE_CELLS]
    line = F.concat_ws(" ", *[semantic_text(F.col(f"`{c}`")) for c in shown])
    place = sort_place(df, sheet.order_by)
    return (df if sheet.order_by else df.limit(SIGNATURE_ROWS)).select(F.lit(position).alias("ord"), place.alias("place"), line.alias("line"))


def find_sheet(sheets: DataFrame, contains: str | None = None, equals: str | None = None) -> DataFrame:
    """The first sheet of each workbook whose name contains one text or equals another."""
    name = F.trim(F.lower("sheet"))
    hit = F.lit(False)
    if contains is not None:
        hit = hit | name.contains(contains.lower())
    if equals is not None:
        hit = hit | (name == equals.lower())
    return sheets.where(hit).groupBy("workbook").agg(F.min_by("sheet", "ord").alias("sheet"))
