"""Exact Jaccard self-join of documents on five-word shingles, by a token-group matrix.

Documents that share their first common token form a group. The matrix holds, for each token that may prove a
link, the groups in which it occurs. A query opens only groups whose union of tokens overlaps it enough; inside an
opened group similarities are computed from whole sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.components import components
from sondeo.llm.support import Shipped, _utf8_lengths, bitmap, chunks, in_bitmap, lighter_batches, mix, stored, tidy

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
GROUP = 64
#: Sizes of sets in a group differ by at most this factor.
BAND = 1.12
#: Characters whose shingles are made at a time.
CHUNK_CHARS = 1_000_000
#: Cells of each of the two rows of the frequency sketch, and the parts it travels in.
CELLS, PARTS = 1 << 21, 32
PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The set of each text: sorted 64-bit hashes of its five-word shingles.

    Letters A-Z are lowered; words are what blanks and the controls 9 to 13 separate. A text of fewer
    than five words is one shingle; without words the set is empty.
    """
    words = [x.encode("utf-8", "surrogatepass").lower().split() if x else [] for x in texts]
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    digest = xxhash.xxh3_64_intdigest
    codes = np.fromiter((digest(w) for ws in words for w in ws), dtype=np.uint64, count=int(starts[-1]))
    rolled = codes[: max(0, len(codes) - WORDS + 1)].copy()
    for k in range(1, WORDS):
        rolled = rolled * PRIME + codes[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            short = np.full(1, b - a, dtype=np.uint64)
            for c in codes[a:b]:
                short = short * PRIME + c
            out.append(mix(short))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _sketch_cells(sets: list[np.ndarray], table: np.ndarray) -> None:
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    for row in range(2):
        table[row] += np.bincount(((flat >> np.uint64(23 * row)) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the compressed counts of each part as they stream by."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            cells = np.frombuffer(zlib.decompress(blob), dtype=np.uint32).astype(np.uint64)
            total[part] = total[part] + cells if part in total else cells
    if total:
        top = np.uint64(0xFFFFFFFF)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([zlib.compress(np.minimum(x, top).astype(np.uint32).tobytes(), 1) for x in total.values()], pa.binary())], names=["part", "blob"])


def _levels(marked: DataFrame) -> np.ndarray:
    """How common each cell is: 0 within the noise of unrelated tokens, one more for every doubling beyond."""
    parts = marked.filter("part is not null").select("part", "blob", F.spark_partition_id().alias("task"))
    once = parts.repartition(F.col("part"), F.col("task") % 16).select("part", "blob").mapInArrow(tidy(_sum_parts), "part int, blob binary")
    table = once.repartition(PARTS, "part").mapInArrow(tidy(_sum_parts), "part int, blob binary").toArrow()    # a table of fixed size
    cells = np.zeros((PARTS, 2 * CELLS // PARTS), dtype=np.uint64)
    for part, blob in zip(table.column(0).to_pylist(), table.column(1).to_pylist()):
        cells[part] += np.frombuffer(zlib.decompress(blob), dtype=np.uint32)
    flat = cells.reshape(2, CELLS).astype(np.float64)
    usual = np.maximum(1.0, flat.mean(axis=1, keepdims=True))
    excess = flat - usual - 4 * np.sqrt(usual)
    return np.clip(np.floor(np.log2(np.maximum(excess, 1) / 8)) + 1, 0, 31).astype(np.uint8)


def _in_order(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Tokens as keys in the order all documents agree on, sorted: uncommon cells first, then by hash."""
    level = np.minimum(levels[0][(tokens & np.uint64(CELLS - 1)).astype(np.int64)], levels[1][((tokens >> np.uint64(23)) & np.uint64(CELLS - 1)).astype(np.int64)])
    return np.sort((level.astype(np.uint64) << np.uint64(58)) | (tokens >> np.uint64(6))).view(np.int64)


def prefix_length(n: int) -> int:
    """Two sets that link share one of their first so many tokens, in any order common to both."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def _over_sets(docs: DataFrame, key: str, text: str, columns: str, make) -> DataFrame:
    """``make(keys, sets)`` over the shingle sets of ``docs``, a bounded number of characters at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(_utf8_lengths(batch.column(1)), CHUNK_CHARS):
                keys = batch.column(0).slice(lo, hi - lo)
                yield from make(keys, batch.column(1).slice(lo, hi - lo))
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(tidy(run), columns)


def _pairs_within_bounds(left: list[np.ndarray], right: list[np.ndarray], n: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which pairs of members may link, judged by their prefixes.

    Up to the smaller of two prefixes' ends, all shared tokens are known; beyond it, at most the shorter rest is shared.
    """
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    both = _overlaps(left, right, shared)
    ends = [np.array([x[-1] for x in side]) for side in (left, right)]
    seen_left = np.array([np.searchsorted(x, ends[1], side="right") for x in left])
    seen_right = np.array([np.searchsorted(x, ends[0], side="right") for x in right]).T
    most = both + np.minimum(n[0][:, None] - seen_left, n[1][None, :] - seen_right)
    return (100 * most >= PERCENT * (n[0][:, None] + n[1][None, :] - most)) & (both > 0)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], shared: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of members, over the tokens ``shared``."""
    both = np.zeros((len(left), len(right)), dtype=np.int64)
    for lo in range(0, len(shared), 50_000):
        part = shared[lo : lo + 50_000]
        both += np.rint(_incidence(left, part) @ _incidence(right, part).T).astype(np.int64)
    return both


def _links(sets: tuple[list[np.ndarray], list[np.ndarray]], ids: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """Links between two groups (or within one): enough of them to connect all that link."""
    left, right = sets
    n = [np.array([len(s) for s in x]) for x in sets]
    union = np.unique(np.concatenate(right))
    overlap = np.array([int(_hits(s, union).sum()) for s in left])
    opened = np.flatnonzero(100 * overlap >= PERCENT * n[0])      # the bound: what the whole group could share
    if not len(opened):
        return []
    left = [left[i] for i in opened]
    both = _overlaps(left, right, np.unique(np.concatenate([s[_hits(s, union)] for s in left])))
    linked = 100 * both >= PERCENT * (n[0][opened][:, None] + n[1][None, :] - both)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = int(ids[0][opened[i]]), int(ids[1][j])
        if a != b and (x := find(a)) != (y := find(b)):
            root[x] = y
            out.append((a, b))
    return out


def _hits(tokens: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocabulary, tokens), len(vocabulary) - 1)
    return vocabulary[at] == tokens


def _incidence(sets: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(vocabulary)), dtype=np.float32)
    for i, s in enumerate(sets):
        inside = s[np.searchsorted(s, vocabulary[0]) : np.searchsorted(s, vocabulary[-1], side="right")]
        at = np.minimum(np.searchsorted(vocabulary, inside), len(vocabulary) - 1)
        out[i, at[vocabulary[at] == inside]] = 1
    return out


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, ``n_shingles`` (size of its set) and ``component_id`` (smallest key
    reachable by links, itself included).

    Documents of equal sets are linked and join as one. Empty sets (null text or no words) link with
    nothing. Rows of one key are one document. A null key links with nothing and has a null component.
    Two different shingles share a 64-bit hash with a chance of about 10^-19; sets are told apart by 128 bits.

    No document is dropped and no list is cut: a token held by very many groups only makes more pairs of
    groups. Such tokens are ordered last (a sketch of fixed size says which), so that they rarely come into prefixes.
    """
    def describe_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, CELLS), dtype=np.uint32)
        names = ["doc", "n", "h1", "h2", "part", "blob"]
        for batch in batches:
            for lo, hi in chunks(_utf8_lengths(batch.column(1)), CHUNK_CHARS):
                sets = shingle_sets(batch.column(1).slice(lo, hi - lo).to_pylist())
                _sketch_cells(sets, table)
                sums = [pa.array(np.array([np.bitwise_xor.reduce(mix(s ^ np.uint64(c))) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)) for c in (1, 0x5555555555555555)]
                none = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), *sums, pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names=names)
        flat = table.reshape(PARTS, -1)
        used = [i for i in range(PARTS) if flat[i].any()]
        if used:
            none = len(used)
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(none, pa.int64()) for _ in range(4)), pa.array(used, pa.int32()), pa.array([zlib.compress(flat[i].tobytes(), 1) for i in used], pa.binary())], names=names)

    spark = docs.sparkSession
    lighter_batches(spark)
    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    marked = stored(source.mapInArrow(tidy(describe_all), "doc long, n long, h1 long, h2 long, part int, blob binary"))
    rows = marked.filter("part is null").select("doc", "n", "h1", "h2")
    classes = stored(rows.filter("n > 0 and doc is not null").groupBy("n", "h1", "h2").agg(F.min("doc").alias("id")))
    copies = rows.join(classes, ["n", "h1", "h2"]).filter("doc <> id").select("doc")
    shipped = Shipped(spark, (_levels(marked), bitmap(copies, "doc")))       # tables of fixed size

    def first_tokens(keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        levels, copied = shipped.value
        sets = shingle_sets(texts.to_pylist())
        first = [_in_order(s, levels)[: prefix_length(len(s))] for s in sets]
        sizes = np.cumsum([0, *(len(f) for f in first)]).astype(np.int32)
        flat = pa.array(np.concatenate(first) if first else np.zeros(0, dtype=np.int64))
        copy = in_bitmap(copied, keys.to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays([keys, pa.array([len(s) for s in sets], pa.int64()), pa.array(copy), pa.ListArray.from_arrays(pa.array(sizes), flat)], names=["doc", "n", "copy", "first"])

    # one document of each class: only those that may be copies need a join to tell
    keyed = docs.filter(F.col(key).isNotNull())
    prefixes = stored(_over_sets(keyed, key, text, "doc long, n long, copy boolean, first array<long>", first_tokens).filter("n > 0"))
    ids = classes.select(F.col("id").alias("doc"))
    own = prefixes.filter("not copy").unionByName(prefixes.filter("copy").join(ids, "doc", "left_semi")).select("doc", "n", "first")

    # tokens that only one document has in its prefix prove nothing
    common = stored(own.select(F.explode("first").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1"))
    shipped.done()
    may_be_common = Shipped(spark, bitmap(common, "token", 1 << 25))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            tokens = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = np.flatnonzero(in_bitmap(may_be_common.value, tokens))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(owner[at])) for i in range(2)), pa.array(tokens[at])], names=["doc", "n", "token"])

    matrix = stored(own.mapInArrow(tidy(entries), "doc long, n long, token long").join(common, "token"))
    may_be_common.done()

    # groups: of like size and with the same lead, a token as common as the middle one of a document's common tokens:
    # among copies a token of their own, in very large families one of many
    uses = F.sort_array(F.collect_list(F.struct("uses", "token")))
    scale = lambda x: F.floor(F.log2(x.cast("double")))
    middle = F.col("tokens")[F.floor(F.size("tokens") / 2).cast("int")]["uses"]
    lead = F.array_min(F.transform(F.filter("tokens", lambda t: scale(t["uses"]) == scale(middle)), lambda t: t["token"]))
    firsts = matrix.groupBy("doc").agg(F.max("n").alias("n"), uses.alias("tokens")).select("doc", "n", lead.alias("lead"), F.floor(F.log("n") / F.log(F.lit(BAND))).alias("band"))
    sizes = firsts.groupBy("lead", "band").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("blocks"))
    groups = stored(firsts.join(sizes, ["lead", "band"]).select("doc", "n", F.xxhash64("lead", "band", F.pmod(F.xxhash64("doc"), "blocks")).alias("grp")))
    seats = matrix.select("token", "doc").join(groups, "doc").groupBy("token", "grp")
    seats = stored(seats.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("held")))
    pairs = stored(_candidate_groups(seats))
    alone = seats.filter("held > 1").groupBy("grp").agg(F.count(F.lit(1)).alias("shared"), F.min("low").alias("low"), F.max("high").alias("high"))
    several = stored(alone.filter(_enough("low", "high", "low", "high")).select("grp"))

    # the bound on prefixes of members, then whole sets of those that it lets pass
    near = stored(_opened(own.withColumnRenamed("first", "tokens"), groups, pairs, several, _bounded_members, "grp long, grp2 long, doc long", pick=True))
    passing = stored(near.select("doc").distinct().join(groups, "doc"))
    wanted = Shipped(spark, bitmap(passing.select("doc"), "doc"))

    def whole_sets(keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        may = np.flatnonzero(in_bitmap(wanted.value, keys.to_numpy(zero_copy_only=False).astype(np.int64)))
        if len(may):
            sets = [np.sort(s.view(np.int64)) for s in shingle_sets(texts.take(pa.array(may)).to_pylist())]   # as signed numbers
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(may)), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "n", "tokens"])

    sets = _over_sets(keyed, key, text, "doc long, n long, tokens array<long>", whole_sets).filter("n > 0")
    left = near.select("grp", "grp2").distinct()
    edges = stored(_opened(sets, passing, left.filter("grp <> grp2"), left.filter("grp = grp2").select("grp"), _linked_members, "a long, b long", pick=False))
    wanted.done()
    named = classes.join(components(edges), F.col("id") == F.col("node"), "left").select("n", "h1", "h2", F.coalesce("component", "id").alias("component_id"))
    out = rows.join(named, ["n", "h1", "h2"], "left")
    kind = docs.schema[key].dataType
    return out.select(F.col("doc").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).cast(kind).alias("component_id"))


def _candidate_groups(seats: DataFrame) -> DataFrame:
    """Pairs of groups (grp < grp2) that share enough tokens of the matrix for some sizes of their members.

    Sets of sizes m >= s link with at least PERCENT (m + s) / (100 + PERCENT) shared tokens. Beyond the prefixes
    lie at most PERCENT m / 100 of them; the prefixes must share the rest. It is least for the largest m, and
    the smallest s that is not too small for it.
    """
    other = seats.select("token", F.col("grp").alias("grp2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    met = seats.join(other, "token").filter("grp < grp2").groupBy("grp", "grp2").agg(
        F.count(F.lit(1)).alias("shared"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("low2").alias("low2"), F.max("high2").alias("high2"))

    return met.filter(f"{_enough('low', 'high', 'low2', 'high2')} or {_enough('low2', 'high2', 'low', 'high')}").select("grp", "grp2")


def _enough(low: str, high: str, low2: str, high2: str) -> str:
    """May a set of a size from ``low`` to ``high`` link with one of a size from ``low2`` to ``high2`` that is no larger?"""
    least = f"greatest({low2}, {PERCENT} * {high} / 100)"
    return f"({low2} <= {high} and 100 * {high2} >= {PERCENT} * {low} and {100 + PERCENT} * shared >= {PERCENT} * {least} - {PERCENT * PERCENT / 100} * {high})"


def _opened(source: DataFrame, members: DataFrame, pairs: DataFrame, several: DataFrame, make, schema: str, pick: bool) -> DataFrame:
    """What ``make`` finds in pairs of groups, and within the groups ``several``.

    ``source`` holds (doc, n, tokens), ``members`` (doc, grp); with ``pick``, those of ``source`` that are not needed
    are left behind early. A group's members travel together, at most about GROUP of them.
    """
    wanted = pairs.select("grp").union(pairs.select("grp2")).union(several.select("grp")).distinct()
    seated = stored(members.join(wanted, "grp", "left_semi").select("doc", "grp"))
    chosen = Shipped(source.sparkSession, bitmap(seated, "doc")) if pick else None      # a megabyte

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(chosen.value, batch.column(0).to_numpy())))

    few = (source.mapInArrow(tidy(picked), source.schema) if pick else source).join(seated, "doc")
    bundles = stored(few.groupBy("grp").agg(F.collect_list(F.struct("doc", "n", "tokens")).alias("m")))
    if chosen:
        chosen.done()
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for r in range(batch.num_rows):
                sides = []
                for c in (2, 3):
                    m = batch.column(c)[r].values
                    lists = m.field(2)
                    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
                    sides.append((np.asarray(m.field(0)), np.asarray(m.field(1)), [flat[a:b] for a, b in zip(ends, ends[1:])]))
                found += make((batch.column(0)[r].as_py(), batch.column(1)[r].as_py()), *zip(*sides))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=names)

    across = pairs.join(bundles, "grp").join(bundles.select(F.col("grp").alias("grp2"), F.col("m").alias("m2")), "grp2")
    within = bundles.join(several, "grp", "left_semi").select("grp", F.col("grp").alias("grp2"), "m", F.col("m").alias("m2"))
    return across.select("grp", "grp2", "m", "m2").mapInArrow(tidy(run), schema).unionByName(within.mapInArrow(tidy(run), schema))


def _bounded_members(groups, ids, n, lists) -> list[tuple[int, int, int]]:
    """(group, group, document): the members of either side that have a partner within bounds on the other."""
    ok = _pairs_within_bounds(*lists, n) & (ids[0][:, None] != ids[1][None, :])
    return [(*groups, int(i)) for i in {*ids[0][ok.any(axis=1)].tolist(), *ids[1][ok.any(axis=0)].tolist()}]


def _linked_members(groups, ids, n, lists) -> list[tuple[int, int]]:
    return _links(lists, ids)
