"""What the operators share: stored tables, Arrow batches cut by size, folds, bounded bitmaps, vectors."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a task turns into number arrays at a time, so that long documents fit its memory.
CHUNK_CHARS = 400_000
#: Classes or languages that a training sample may have.
MOST_VALUES = 64
#: Bytes that travel between Spark and a Python worker at a time.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where the session has none, as in tests on one machine, a new local folder is set. A session with
    executors elsewhere must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sondeo-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later steps reread it and survive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/sondeo-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(*tables: DataFrame) -> None:
    """Delete what :func:`stored` wrote for these tables, once nothing that reads them is left to compute."""
    for df in tables:
        spark = df.sparkSession
        for folder in {unquote(f).rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("sondeo-"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, the files of a query's shuffles go when it ends, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def fold(key: Column, folds: int = 5) -> Column:
    """The fold of a row: crc32 of its key as text, modulo ``folds`` (a null key counts as empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def thinned(df: DataFrame, key: Column, bound: int, by: str) -> DataFrame:
    """A sample of about ``bound`` rows for each value of ``by``, chosen by a hash of ``key``; all rows where fewer.

    The sizes of at most ``MOST_VALUES`` values come to the driver and go into the filter, so no row is moved for it; more
    values are an error. Rows with a null value are left out.
    """
    sizes = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n")).limit(MOST_VALUES + 1).collect()
    if len(sizes) > MOST_VALUES:
        raise ValueError(f"{by} has more than {MOST_VALUES} values")
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col(by) == F.lit(r[by]), bound / r["n"]).otherwise(share)
    return df.filter(hashed_share(key) < share)


def hashed_share(key: Column) -> Column:
    """A number from 0 to 1 that follows from the key alone."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(1_000_003)) / 1_000_003.0


def taught(docs: DataFrame, marks: DataFrame, key: str, text: str) -> DataFrame:
    """One text (``_text``) for each key of ``marks`` (``_key``, ``_label``) that ``docs`` holds: of several rows, the one
    whose text has the smallest hash. So what is collected follows the number of keys, not of rows."""
    rows = docs.select(docs[key].alias("_key"), F.coalesce(docs[text], F.lit("")).alias("_text")).join(F.broadcast(marks), "_key")
    return rows.groupBy("_key").agg(F.min("_label").alias("_label"), F.min_by("_text", F.struct(F.xxhash64("_text"), F.length("_text"))).alias("_text"))


def lighter_batches(spark: SparkSession) -> None:
    """From here on, Arrow batches of at most ``BATCH_BYTES``, so that long texts and groups stay within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Shipped:
    """An object in a broadcast, pickled by value like the functions that use it: executors need no copy of this package."""

    def __init__(self, spark: SparkSession, what: object):
        self.blob = spark.sparkContext.broadcast(cloudpickle.dumps(what))

    def __getstate__(self) -> dict:
        return {"blob": self.blob}

    @property
    def value(self):
        if "held" not in self.__dict__:
            self.held = cloudpickle.loads(self.blob.value)
        return self.held

    def done(self) -> None:
        """Free it everywhere, once nothing that uses it is left to compute."""
        self.blob.destroy()


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    return sys.modules.setdefault("_sondeo_worker_cache", types.ModuleType("_sondeo_worker_cache")).__dict__


def give_back() -> None:
    """At the end of a task: what a worker remembers shrinks to its newest part, and free memory goes back to the system."""
    for held in list(worker_cache().values()):
        if hasattr(held, "forget"):
            held.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # another C library
        pass


def tidy(function: Callable) -> Callable:
    """``function`` over batches, followed by :func:`give_back`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()
    return run


def chunks(lengths: np.ndarray, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` characters in all, or of a single row."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def map_texts(df: DataFrame, function: Callable[[list[str | None]], dict], schema: str, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` as they are, and those that ``function`` makes of whole texts, a size-bounded list at a time."""
    names = [*keep]
    lighter_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for lo, hi in chunks(_utf8_lengths(column)):
                made = function(column.slice(lo, hi - lo).to_pylist())
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*arrays, *made.values()], names=[*names, *made])

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(tidy(run), f"{kept}, {schema}")


def _utf8_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and where each begins (one entry more than texts)."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a bijection)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``starts``; empty ranges give 0."""
    total = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype.kind in "fu" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def bitmap(df: DataFrame, key: str, bits: int = 1 << 23) -> np.ndarray:
    """Hashed membership of a long column in ``bits`` bits (a Bloom filter with one hash): the driver gets
    at most bits / 64 words, however many rows there are. Test it with :func:`in_bitmap`.

    Keys are hashed first: row numbers that begin anew in each partition have their lowest bits in common."""
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bits))
    words = (
        df.filter(F.col(key).isNotNull())
        .groupBy((place / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(cast(`{key}` as long)), 64) as int))")).alias("mask"))
    )
    table = words.toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return out.view(np.uint64)


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """May each key (signed 64-bit) be in the set? True for all that are, and for some that are not."""
    place = np.mod(xxhash64_of_longs(keys), len(words) * 64)
    return (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


def xxhash64_of_longs(keys: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for each long."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    start = np.full(1, 42 + 8, dtype=np.uint64) + p5
    h = start ^ turn(np.asarray(keys, dtype=np.int64).view(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows whose vector takes part: not null, all components finite numbers, some not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)
