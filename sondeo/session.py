"""Session defaults, the shared folder, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "sondeo") -> SparkSession:
    """A session for tests and benches. On a cluster, pass in the session you were given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage in the cluster's shared checkpoint folder, so that lost executors do no harm.

    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset and the session is a single local process, as in tests, a new folder is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sondeo-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/sondeo-{name}-{uuid.uuid4().hex}"


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A metadata-sized table (a row per column, sheet or chart), held in the plan itself."""
    struct = T.StructType.fromDDL(schema)
    records = [dict(zip(struct.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, to_arrow_schema(struct)), struct)


def union_all(tables: list[DataFrame]) -> DataFrame:
    """All rows of many tables of one shape. Joined in halves, so that planning hundreds of them stays quick."""
    if len(tables) == 1:
        return tables[0]
    half = len(tables) // 2
    return union_all(tables[:half]).unionByName(union_all(tables[half:]))


def small_side(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A table to join with, counted: broadcast up to ``most`` rows, otherwise left to a shuffled join."""
    table = settle(df)
    return F.broadcast(table) if table.count() <= most else table


def settle(df: DataFrame) -> DataFrame:
    """Compute a report table once, for the several statements that read it."""
    return durable(df)
