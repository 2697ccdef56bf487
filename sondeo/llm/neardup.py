"""Near-duplicate vectors by NN-descent.

A neighbour graph is started from random hyperplane cells and refined through neighbours of neighbours; lists
full of links are enlarged; recall is audited, vector by vector, against a fixed set of queries; links at the threshold and their
components are kept. Within a component every pair is then counted exactly, in blocks, so the number of links
does not depend on the length of a list; rounds go on, looking only across components, until one finds nothing new.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondeo.llm.components import components
from sondeo.llm.support import matrix, stored, valid_vectors

log = logging.getLogger(__name__)

NEIGHBOURS = 10
ENLARGED = 4
CELL = 48
BLOCK = 768
#: Cosines of one-byte codes are off by at most about 2 / 127 of the largest component; links are checked exactly beyond this margin.
MARGIN = 0.04
AUDIT_QUERIES = 400
AUDIT_RECALL = 0.999
#: The audit passes over links that sums in another order could put below the threshold.
HAIR = 1e-9
PLANES = 3


def _codes(x: np.ndarray) -> np.ndarray:
    """Unit vectors as signed bytes, scaled by the largest component, so that the code keeps the direction."""
    return np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)


def _unit(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs_schema(name: str = "id") -> str:
    return f"{name} long, nbr long, sim float"


def _best_pairs(ids: np.ndarray, comp: np.ndarray, s: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each member its ``most`` nearest others among ``allowed`` pairs, pairs of one component left out."""
    s = np.where(allowed & (comp[:, None] != comp[None, :]), s, -2.0)
    top = np.argsort(-s, axis=1, kind="stable")[:, :most]
    row = np.repeat(np.arange(len(ids)), top.shape[1])
    col = top.ravel()
    good = s[row, col] > -2.0
    return ids[row[good]], ids[col[good]], s[row, col][good]


def _cells(nodes: DataFrame, dimension: int, bits: int, planes: int, seed: int) -> DataFrame:
    """First lists: in each of ``planes`` random partitions, members of a cell (in blocks of about ``CELL``) compare."""
    normals = np.random.default_rng(seed).standard_normal((planes, bits, dimension)).astype(np.float32)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.int8).reshape(batch.num_rows, -1).astype(np.float32)
                for p in range(planes):
                    cell = ((x @ normals[p].T > 0) * weights).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, dtype=np.int32)), pa.array(cell), *(batch.column(i) for i in range(3))], names=["p", "cell", "id", "comp", "code"])

    placed = nodes.select("id", "comp", "code").mapInArrow(assign, "p int, cell long, id long, comp long, code binary")
    sizes = placed.groupBy("p", "cell").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("n"))
    blocks = (
        placed.join(sizes, ["p", "cell"]).groupBy("p", "cell", F.pmod(F.xxhash64("id", F.lit(seed)), "n").alias("block"))
        .agg(F.collect_list(F.struct("id", "comp", "code", F.lit(True).alias("fresh"))).alias("members"))
    )
    return blocks.select("members").mapInArrow(_compare(NEIGHBOURS), _pairs_schema())


def _compare(most: int):
    """Local join: the members of each list compare with one another, pairs with no fresh member left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            ids, comp = (np.asarray(flat.field(i)) for i in (0, 1))
            fresh = np.asarray(flat.field(3).to_numpy(zero_copy_only=False), dtype=bool)
            x = _unit(np.frombuffer(b"".join(flat.field(2).to_pylist()), dtype=np.int8).reshape(len(ids), -1)) if len(ids) else None
            ends = np.cumsum([0, *pa.compute.list_value_length(lists).to_pylist()])
            out: list[tuple] = []
            for a, b in zip(ends, ends[1:]):
                if b - a > 1:
                    f = fresh[a:b]
                    allowed = f[:, None] | f[None, :]
                    np.fill_diagonal(allowed, False)
                    out.append(_best_pairs(ids[a:b], comp[a:b], x[a:b] @ x[a:b].T, allowed, most))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["id", "nbr", "sim"])

    import pyarrow.compute  # noqa: F401  (pa.compute)

    return run


def _refined(old: DataFrame | None, found: DataFrame, threshold: float) -> DataFrame:
    """Lists of the nearest ``NEIGHBOURS``; a list full of links holds ``ENLARGED`` times as many."""
    both = found.select("id", "nbr", "sim", F.lit(True).alias("fresh"))
    if old is not None:
        both = old.select("id", "nbr", "sim", F.lit(False).alias("fresh")).unionByName(both)
    once = both.groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "nbr")))
    most = F.when(F.col("sim") >= threshold - MARGIN, NEIGHBOURS * ENLARGED).otherwise(NEIGHBOURS)
    return stored(ranked.filter((F.col("place") <= NEIGHBOURS * ENLARGED) & (F.col("place") <= most)).select("id", "nbr", "sim", "fresh"))


def _descend(nodes: DataFrame, lists: DataFrame, threshold: float, steps: int, least: float, seed: int) -> DataFrame:
    """Refine ``lists`` until fewer than ``least`` of the entries are new, or ``steps`` times."""
    for step in range(steps):
        forth = lists.select(F.col("id").alias("pivot"), F.col("nbr").alias("id"), "fresh")
        back = lists.select(F.col("nbr").alias("pivot"), "id", "fresh")
        seats = forth.union(back).groupBy("pivot", "id").agg(F.max("fresh").alias("fresh"))
        order = Window.partitionBy("pivot").orderBy(F.desc("fresh"), F.xxhash64("id", F.lit(seed + step)))
        seats = seats.withColumn("seat", F.row_number().over(order)).filter(F.col("seat") <= 3 * NEIGHBOURS)
        groups = seats.join(nodes, "id").groupBy("pivot").agg(F.collect_list(F.struct("id", "comp", "code", "fresh")).alias("members"), F.max("fresh").alias("any"))
        found = groups.filter("any").select("members").mapInArrow(_compare(5), _pairs_schema())
        lists = _refined(lists, found, threshold)
        share = lists.agg(F.avg(F.col("fresh").cast("double"))).first()[0]
        if share is None or share < least:
            break
    return lists


def _exact_links(lists: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs of the lists whose cosine in double precision reaches the threshold."""
    near = lists.filter(F.col("sim") >= threshold - MARGIN).select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct()
    pairs = near.join(vectors.select(F.col("id").alias("a"), F.col("unit").alias("u")), "a").join(vectors.select(F.col("id").alias("b"), F.col("unit").alias("w")), "b")
    cosine = F.aggregate(F.zip_with("u", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.filter(cosine >= threshold).select("a", "b")


def _block_links(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links): for each member of a component the weight of the others that it links with, every pair compared.

    Components are cut into blocks of about ``BLOCK`` members; each pair of blocks is one group. Counts leave it, not pairs.
    """
    sizes = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    cut = members.join(sizes, "comp").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.struct("id", "weight", "mine", "unit").alias("m"))
    groups = dealt.groupBy("comp", "i", "j").agg(F.collect_list("m").alias("members"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                i, j = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                flat = batch.column(2)[r].values
                ids, weight, mine = (np.asarray(flat.field(c)) for c in range(3))
                x = matrix(flat.field(3))
                left, right = mine == i, mine == j
                linked = (x[left] @ x[right].T >= threshold) & (ids[left][:, None] != ids[right][None, :])
                sums = [(ids[left], linked @ weight[right])] + ([(ids[right], linked.T @ weight[left])] if i != j else [])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[0] for s in sums])), pa.array(np.concatenate([s[1] for s in sums]).astype(np.int64))], names=["id", "links"])

    counted = groups.select("i", "j", "members").mapInArrow(count, "id long, links long")
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def _audit(vectors: DataFrame, comps: DataFrame | None, threshold: float) -> float:
    """Of audited vectors that have links, compared with every row: the share whose links a component holds, all of them.

    Audited are ``AUDIT_QUERIES`` vectors outside large components and as many inside (smallest hashes of the id); the
    smaller of the two shares counts, so that a large family, whose links are easily found, does not stand for the others.
    """
    if comps is None:
        rows = vectors.select("id", "unit", F.col("id").alias("comp"))
        chosen = rows.withColumn("large", F.lit(False)).orderBy(F.xxhash64("id"), "id").limit(AUDIT_QUERIES)
    else:
        rows = vectors.join(comps, F.col("id") == F.col("node"), "left").select("id", "unit", F.coalesce("component", "id").alias("comp"))
        limit = max(CELL, vectors.count() / AUDIT_QUERIES)
        large = comps.groupBy(F.col("component").alias("comp")).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > limit).select("comp", F.lit(True).alias("large"))
        sided = rows.join(large, "comp", "left").select("id", "unit", "comp", F.coalesce("large", F.lit(False)).alias("large"))
        side = lambda at: sided.filter(F.col("large") == at).orderBy(F.xxhash64("id"), "id").limit(AUDIT_QUERIES)
        chosen = side(False).unionByName(side(True))
    chosen = chosen.select("id", "unit", "comp", "large").toArrow()
    if not chosen.num_rows:
        return 1.0
    q = chosen.column(0).to_numpy(), matrix(chosen.column(1)), chosen.column(2).to_numpy()
    shipped = vectors.sparkSession.sparkContext.broadcast(q)       # 2 * AUDIT_QUERIES vectors at most

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, comp = shipped.value
        there, held = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                if part.num_rows:
                    mine = part.column(0).to_numpy()
                    linked = (matrix(part.column(1)) @ x.T >= threshold + HAIR) & (mine[:, None] != ids[None, :])
                    there += linked.sum(axis=0)
                    held += (linked & (part.column(2).to_numpy()[:, None] == comp[None, :])).sum(axis=0)
        some = np.flatnonzero(there)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(there[some]), pa.array(held[some])], names=["query", "there", "held"])

    sums = rows.select("id", "unit", "comp").mapInArrow(compare, "query long, there long, held long").groupBy("query").agg(F.sum("there").alias("there"), F.sum("held").alias("held")).toArrow()
    query, there, held = (sums.column(c).to_numpy() for c in range(3))
    inside = chosen.column(3).to_numpy()[query].astype(bool)
    return min((float(np.mean((there == held)[inside == side])) for side in (False, True) if (inside == side).any()), default=1.0)


def near_duplicates(data: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, rounds: int = 6,
                    steps: int = 4, seed: int = 5) -> DataFrame:
    """One row per row of ``data``: the key, ``n_links`` (other rows with a cosine of at least ``threshold``),
    ``component_id`` (smallest key reachable by links, itself included) and ``kept`` (is it that one?).

    Rows with equal vectors are one node and count as links of one another. Vectors that are null, empty,
    zero or hold a null or non-finite component link with nothing; a null key gives a row with null
    component. Repeated keys are rows of their own. Links are found by descent, so some may be missed: rounds,
    each from other cells, stop when one finds no new link and the audit reaches ``AUDIT_RECALL``. After an
    audit that falls short the next round has twice as many partitions into cells. The measured recall is logged;
    where it is still short after ``rounds``, RuntimeError tells it and there is no result.
    Every link found is exact, and inside a component no pair is missed.
    """
    spark = data.sparkSession
    values = F.col(vector).cast("array<double>")
    rows = data.select(F.col(key).cast("long").alias("vec"), values.alias("v"))
    rows = valid_vectors(rows, "vec", "v").select("vec", F.transform("v", lambda x: x + 0.0).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64("v", F.lit(1)))
    classes = rows.groupBy("h1", "h2").agg(F.min("vec").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = _codes(matrix(batch.column(4)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["h1", "h2", "id", "weight", "unit", "code"])

    unit = F.transform("v", lambda x: x / F.col("length"))
    scaled = classes.withColumn("length", length).select("h1", "h2", "id", "weight", unit.alias("unit"))
    vectors = stored(scaled.mapInArrow(encode, "h1 long, h2 long, id long, weight long, unit array<double>, code binary"))
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("unit")).alias("most"), F.min(F.size("unit")).alias("least")).first()
    own = data.select(F.col(key).cast("long").alias("vec"), F.transform(values, lambda x: x + 0.0).alias("v"))
    tagged = own.select("vec", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2"))
    if facts["n"] and facts["most"] != facts["least"]:
        raise ValueError(f"vectors of {facts['least']} to {facts['most']} components")

    links = comps = None
    bits = max(1, int(np.ceil(np.log2(max(2, facts["n"]) / (CELL / 2)))))
    planes, recall = PLANES, 1.0
    for r in range(rounds if facts["n"] > 1 else 0):
        if comps is None:
            nodes = vectors.select("id", F.col("id").alias("comp"), "code")
        else:
            nodes = vectors.join(comps, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("comp"), "code")
        lists = _refined(None, _cells(nodes, facts["most"], bits, planes, seed + 100 * r), threshold)
        lists = _descend(nodes, lists, threshold, steps, 0.02, seed + 1000 * r)
        fresh = stored(_exact_links(lists, vectors, threshold))
        none = fresh.isEmpty()
        if not none or comps is None:
            links = fresh if links is None else links.union(fresh)
            comps = stored(components(links))
        recall = _audit(vectors, comps, threshold)
        log.info("round %d: %d partitions into cells, recall %.4f of audited vectors", r + 1, planes, recall)
        if recall < AUDIT_RECALL:
            planes *= 2
        elif none:
            break
    if recall < AUDIT_RECALL:
        raise RuntimeError(f"after {rounds} rounds only {recall:.4f} of audited vectors have all their links, {AUDIT_RECALL} are asked; give more rounds")
    if comps is None:
        comps = spark.createDataFrame([], "node long, component long")
    members = vectors.join(comps, F.col("id") == F.col("node")).select("id", "weight", "unit", F.col("component").alias("comp"))
    counted = _block_links(members, threshold)
    per_class = (
        vectors.select("h1", "h2", "id", "weight").join(comps, F.col("id") == F.col("node"), "left").join(counted, "id", "left")
        .select("h1", "h2", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    out = tagged.join(per_class, ["h1", "h2"], "left").select(
        F.col("vec").alias(key), F.when(F.col("vec").isNotNull() & F.col("n_links").isNotNull(), F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("vec").isNotNull(), F.coalesce("component", "vec")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
