"""Nearest neighbours by cross-polytope hashing: fast pseudo-rotations, the nearest signed axis as bucket, several probes.

Every table rotates vectors by three rounds of random signs and a Hadamard transform. A vector lies in the
bucket of the signed axis nearest to it; a query probes the axes nearest to it, and everything found there
is ranked by the exact inner product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondeo.llm.support import matrix, stored, valid_vectors

#: Rows of a bucket that meet in one group; larger buckets are cut into blocks of about this many.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def rotations(dimension: int, tables: int, seed: int) -> np.ndarray:
    """Random signs: three for each table and each axis, the axes padded to a power of two."""
    width = 1 << max(1, (dimension - 1).bit_length())
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, 3, width))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """H D3 H D2 H D1 x for each row, with the fast Hadamard transform (not normalised)."""
    width = signs.shape[1]
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for d in signs:
        y *= d
        step = 1
        while step < width:
            z = y.reshape(len(y), -1, 2, step)
            y = np.stack((z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]), axis=2).reshape(len(y), width)
            step *= 2
    return y


def on_sphere(x: np.ndarray, longest: float, query: bool, lift: bool) -> np.ndarray:
    """Unit vectors whose order by cosine is the order by inner product.

    Where lengths differ (``lift``), data get one more coordinate that makes all as long as the longest.
    """
    if not lift:
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    if query:
        return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
    x = x / longest
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])


def best_in_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of a block for each query (query, row, score), ties to the smaller id, a query's own row left out."""
    s = q @ x.T
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    floor = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
    row, col = np.nonzero((s >= floor[:, None] - 1e-9) & (s > -np.inf))
    exact = np.einsum("ij,ij->i", q[row], x[col])
    order = np.lexsort((ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    begin = np.searchsorted(row, np.arange(len(q)))
    top = np.arange(len(row)) - begin[row] < k
    return q_ids[row[top]], ids[col[top]], exact[top]


def search(data: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, tables: int = 8,
           probes: int = 16, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``data`` found nearest to each row of ``queries``.

    Nearness is the inner product in double precision on the vectors as they are; a query's own key is no
    candidate; ties go to the smaller key. Vectors that are null, empty, zero or hold a null or non-finite
    component take no part, neither as data nor as queries. Repeated keys count once, with one of their
    vectors. Queries that found fewer than ``k`` rows look into every bucket of one table, so they get all there
    are. No rows give no rows.

    ``tables`` and ``probes`` set recall against work; every row is in each table. Buckets beyond about
    ``BLOCK_ROWS`` rows are cut into blocks, and so are their queries.
    """
    rows = valid_vectors(data, key, vector).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = valid_vectors(queries, key, vector).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = rows.agg(F.max(F.size("v")).alias("most"), F.min(F.size("v")).alias("least"), F.max(length).alias("longest"), F.min(length).alias("shortest")).first()
    if facts["most"] is None:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if facts["most"] != facts["least"]:
        raise ValueError(f"vectors of {facts['least']} to {facts['most']} components")
    dimension, longest = facts["most"], facts["longest"]
    lift = longest > facts["shortest"] * (1 + 1e-6)
    signs = rotations(dimension + lift, tables, seed)

    def placed(query: bool, most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 2000):
                    part = batch.slice(lo, 2000)
                    x = matrix(part.column(1))
                    unit = on_sphere(x, longest, query, lift)
                    raw = pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary())
                    for t in range(tables):
                        y = rotate(unit, signs[t])
                        signed = np.hstack([y, -y])
                        bucket = np.argpartition(-signed, most - 1, axis=1)[:, :most] if most < signed.shape[1] else np.tile(np.arange(signed.shape[1]), (len(y), 1))
                        if most == 1:
                            bucket = np.argmax(signed, axis=1)[:, None]
                        at = np.repeat(np.arange(len(y)), bucket.shape[1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), t, dtype=np.int32)), pa.array(bucket.ravel().astype(np.int32)), part.column(0).take(pa.array(at)), raw.take(pa.array(at))],
                            names=["t", "bucket", "id", "raw"])
        return run

    shape = "t int, bucket int, id long, raw binary"

    def look(asked: DataFrame, most: int, only: int | None) -> DataFrame:
        inside = rows.mapInArrow(placed(False, 1), shape)
        probing = asked.mapInArrow(placed(True, most), shape)
        if only is not None:
            inside, probing = inside.filter(F.col("t") < only), probing.filter(F.col("t") < only)
        # rows and probes by bucket: at most tables x axes lines
        n = inside.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("nr"))
        m = probing.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("nq"))
        sizes = F.broadcast(_small(n.join(m, ["t", "bucket"])))
        spread = lambda own, count, other, others: (F.pmod(F.xxhash64("id"), F.col(count)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other))
        left = inside.join(sizes, ["t", "bucket"]).select("t", "bucket", "id", "raw", *spread("br", "nr", "bq", "nq"))
        right = probing.join(sizes, ["t", "bucket"]).select("t", "bucket", "id", "raw", *spread("bq", "nq", "br", "nr"))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            vectors = [np.frombuffer(b"".join(x.column("raw").to_pylist()), dtype="<f8").reshape(x.num_rows, -1) for x in (a, b)]
            q, i, s = best_in_block(b.column("id").to_numpy(), vectors[1], a.column("id").to_numpy(), vectors[0], k)
            return pa.table({"query_id": q, "vec_id": i, "score": s})

        by = ["t", "bucket", "br", "bq"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "query_id long, vec_id long, score double")

    found = stored(_best(look(asked, min(probes, 2 * signs.shape[2]), None), k))
    there = rows.select("id").distinct().count()
    got = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.least(F.lit(k), F.lit(there) - 1)
    short = stored(asked.join(got, F.col("id") == F.col("query_id"), "left").filter(F.coalesce("n", F.lit(0)) < wanted).select("id", "v"))
    if short.isEmpty():
        return found
    rest = _best(look(short, 2 * signs.shape[2], 1), k)
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").select(*rest.columns).unionByName(rest)


def _small(df: DataFrame) -> DataFrame:
    """A table with a line for each bucket, held in the plan."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best of what its probes returned: at most probes x tables x blocks x k rows a query."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
