"""Alignment of two tokenisations of the same texts, and how often their tokens meet in the corpus.

Both sides are byte ranges of one string. For each token start, an as-of merge by document finds the token of the other
side that covers it; the pairs of both directions are all overlaps, and starts that coincide cut the text into
groups (the ends before them coincide). Tokens of one group are linked.

Counts of linked id pairs are corpus-wide. A block of documents shares one dictionary of its distinct pairs; only
dictionaries are shuffled by pair, counted, and sent back to the documents of their block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondeo.llm.bpe import ByteEncoder, Vocabulary
from sondeo.llm.support import Shipped, _utf8_lengths, chunks, lighter_batches, stored, tidy, worker_cache

#: Characters of a block, and of the texts that are aligned at a time.
BLOCK_CHARS, CHUNK_CHARS = 16_000_000, 400_000
#: Links of a group that are written out at a time.
LINKS = 1 << 22


def piece_bytes(model) -> list[bytes]:
    """What each piece of a sentencepiece model stands for."""
    return [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(model.vocab_size())]


class PlainEncoder(ByteEncoder):
    """Strings of special tokens in a text are plain text."""

    def split(self, text: str) -> list[str]:
        return self.chunks(text)


class Sides:
    """Both tokenizers of a worker, and for each id of either its bytes, their number, and how it is written in a digest."""

    def __init__(self, encoder: PlainEncoder, model):
        self.encoder, self.model = encoder, model
        self.a = [t if i not in encoder.vocabulary.special.values() else b"" for i, t in enumerate(encoder.vocabulary.tokens)]
        self.b = piece_bytes(model)
        self.sizes = tuple(np.array([len(t) for t in side], dtype=np.int64) for side in (self.a, self.b))
        # four ways to write a token: A inside or at the end of its side, B inside or at the end of the group
        self.written = pa.array([f"{i}{end}".encode() for side, end in ((self.a, ","), (self.a, "|"), (self.b, ","), (self.b, ";")) for i in range(len(side))], pa.large_binary())
        self.tables = tuple(pa.array(side, pa.large_binary()) for side in (self.a, self.b))

    def tokens(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which texts have tokens, and of those: ids of A, ids of B, and how many each text has.

        A text has none if it is null or empty, or if either side's bytes are not those of a space and the text.
        """
        full = [i for i, x in enumerate(texts) if x]
        spaced = [" " + texts[i] for i in full]
        mine = [np.frombuffer(x, dtype="<u4").astype(np.int64) for x in self.encoder.encode_all(spaced)] if full else []
        theirs = self.model.encode([texts[i] for i in full], num_threads=1) if full else []
        theirs = [np.array(x, dtype=np.int64) for x in theirs]
        none = np.zeros(0, dtype=np.int64)
        back = [joined(table, np.concatenate([none, *side]), np.cumsum([len(x) for x in side])) for table, side in zip(self.tables, (mine, theirs))]
        same = [k for k, x in enumerate(spaced) if back[0][k] == (raw := x.encode()) and back[1][k] == raw]
        a, b = [mine[k] for k in same], [theirs[k] for k in same]
        return [full[k] for k in same], np.concatenate([none, *a]), np.concatenate([none, *b]), np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)


def joined(table: pa.Array, places: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Entries of ``table`` (bytes) written one after another; a new string begins after each of ``ends``."""
    if not len(places):
        return [b""] * len(ends)
    found = table.take(pa.array(places))
    _, offsets, data = found.buffers()
    raw = data.to_pybytes() if data else b""
    bounds = np.frombuffer(offsets, dtype=np.int64)[found.offset + np.append(0, ends).astype(np.int64)].tolist()
    return [raw[lo:hi] for lo, hi in zip(bounds, bounds[1:])]


def covering(sizes: tuple[np.ndarray, np.ndarray], docs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """For each token of either side the token of the other side that covers its start, and the starts.

    Texts lie one after another on one line of bytes, on both sides at the same place, so starts are in order;
    the merge is by document all the same.
    """
    at = tuple(np.cumsum(s) - s for s in sizes)
    sides = [pd.DataFrame({"doc": d, "at": x, "token": np.arange(len(x))}) for d, x in zip(docs, at)]
    left, right = (pd.merge_asof(x, y.rename(columns={"token": "other"}), on="at", by="doc")["other"].to_numpy() for x, y in (sides, sides[::-1]))
    return left, right, at


def grouped(left: np.ndarray, right: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token, numbered on both sides alike: a new one begins where a token and the one covering it start together."""
    return np.cumsum(at[1][left] == at[0]) - 1, np.cumsum(at[0][right] == at[1]) - 1


def overlaps(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All pairs of tokens whose bytes overlap, in order: the union of both directions."""
    n = len(right) or 1
    return np.unique(np.concatenate([np.arange(len(left)) * n + left, right * n + np.arange(len(right))]))


def linked_pairs(ids: tuple[np.ndarray, np.ndarray], groups: tuple[np.ndarray, np.ndarray], doc_of_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, pair of ids) of all links, in order, and how many links each has. A pair is one number: a << 32 | b.

    Groups are written out a bounded number of links at a time; a group of more links than that, by its distinct ids.
    """
    m, n = (np.bincount(g, minlength=len(doc_of_group)) for g in groups)
    first = np.cumsum(n) - n
    begin = np.cumsum(m) - m
    links = m * n
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    small = np.flatnonzero(links <= LINKS)
    total = np.cumsum(links[small])
    lo = 0
    while lo < len(small):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + LINKS, side="right")))
        g = small[lo:hi]
        tokens = np.repeat(begin[g], m[g]) + _counted(m[g])
        width = np.repeat(n[g], m[g])
        other = np.repeat(np.repeat(first[g], m[g]), width) + _counted(width)
        found.append(_distinct(np.repeat(np.repeat(doc_of_group[g], m[g]), width), np.repeat(ids[0][tokens], width) << 32 | ids[1][other], None))
        lo = hi
    for g in np.flatnonzero(links > LINKS):
        (xs, xn), (ys, yn) = (np.unique(side[s : s + k], return_counts=True) for side, s, k in ((ids[0], begin[g], m[g]), (ids[1], first[g], n[g])))
        for x, k in zip(xs.tolist(), xn.tolist()):
            found.append((np.full(len(ys), doc_of_group[g]), x << 32 | ys, k * yn))
    if len(found) == 1:
        return found[0]
    none = np.zeros(0, dtype=np.int64)
    return _distinct(*(np.concatenate([none, *x]) for x in (zip(*found) if found else ((), (), ()))))


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of ``sizes``, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _distinct(doc: np.ndarray, pair: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(pair, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, pair = doc[order], pair[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))[: len(doc)])
    sums = np.diff(np.append(new, len(doc))) if weight is None else np.add.reduceat(weight[order], new) if len(new) else weight[order]
    return doc[new], pair[new], sums


def written(ids: tuple[np.ndarray, np.ndarray], groups: tuple[np.ndarray, np.ndarray], bounds: tuple[np.ndarray, np.ndarray], sides: Sides) -> list[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    last = [np.append(g[1:] != g[:-1], True)[: len(g)] for g in groups]
    places = np.cumsum(np.bincount(groups[1])), np.cumsum(np.bincount(groups[0]))
    n = len(sides.a)
    line = np.zeros(len(ids[0]) + len(ids[1]), dtype=np.int64)
    line[np.arange(len(ids[0])) + np.append(0, places[0])[groups[0]]] = ids[0] + n * last[0]
    line[np.arange(len(ids[1])) + places[1][groups[1]]] = 2 * n + ids[1] + len(sides.b) * last[1]
    return [x[:-1] for x in joined(sides.written, line, bounds[0] + bounds[1])]


def aligned(docs: DataFrame, file: str, model_file: str, key: str, text: str, keep_groups: bool) -> DataFrame:
    """A row per document with its numbers and its distinct pairs (as places in its block's dictionary, and links of
    each, compressed), and a row per block and pair: in how many of the block's documents it is linked."""
    spark = docs.sparkSession
    lighter_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    with open(model_file, "rb") as source:
        shipped = Shipped(spark, (Vocabulary(file), source.read()))       # as large as the vocabularies
    names = ["block", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "held", "pair", "docs"]

    def sides_of_worker() -> Sides:
        import sentencepiece

        cache = worker_cache()
        if ("sides", file, model_file) not in cache:
            vocabulary, proto = shipped.value
            cache["sides", file, model_file] = Sides(PlainEncoder(vocabulary), sentencepiece.SentencePieceProcessor(model_proto=proto))
        return cache["sides", file, model_file]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = sides_of_worker()
        block, size, lots = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            lengths = _utf8_lengths(batch.column(1))
            for lo, hi in chunks(lengths, CHUNK_CHARS):
                lots.append((batch.column(0).slice(lo, hi - lo), *_lot(batch.column(1).slice(lo, hi - lo).to_pylist(), sides, keep_groups)))
                size += int(lengths[lo:hi].sum())
                if size >= BLOCK_CHARS:
                    yield from _block(block, lots)
                    block, size, lots = block + 1, 0, []
        if lots:
            yield from _block(block, lots)

    def _block(block: int, lots: list) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.unique(np.concatenate([p for *_, lot in lots for p, _ in lot]), return_counts=True)
        for keys, numbers, digests, groups, lot in lots:
            held = [zstandard.compress(np.concatenate([np.searchsorted(pairs, p), n]).astype("<u4").tobytes(), 1) for p, n in lot]
            none = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(none, block)), keys, *(pa.array(x) for x in numbers), pa.array(digests, pa.string()), pa.array(groups, pa.string()), pa.array(held, pa.binary()),
                 pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64())], names=names)
        none = len(pairs)
        if none:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(none, block)), pa.nulls(none, lots[0][0].type), *(pa.nulls(none, pa.int64()) for _ in range(4)), pa.nulls(none, pa.string()), pa.nulls(none, pa.string()),
                 pa.nulls(none, pa.binary()), pa.array(pairs), pa.array(counts.astype(np.int64))], names=names)

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        tidy(run), f"block long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, held binary, pair long, docs long")


def _lot(texts: list[str | None], sides: Sides, keep_groups: bool) -> tuple[list[np.ndarray], list[str], list[str | None], list[tuple[np.ndarray, np.ndarray]]]:
    """Of each text: numbers of tokens, groups and links; the digest of its groups; these if kept; its distinct pairs and their links."""
    which, a, b, na, nb = sides.tokens(texts)
    numbers = [np.zeros(len(texts), dtype=np.int64) for _ in range(4)]
    digests, kept = [""] * len(texts), [None if not keep_groups else ""] * len(texts)
    none = np.zeros(0, dtype=np.int64)
    held = [(none, none)] * len(texts)
    if not which:
        return numbers, digests, kept, held
    docs = tuple(np.repeat(np.arange(len(which)), n) for n in (na, nb))
    left, right, at = covering((sides.sizes[0][a], sides.sizes[1][b]), docs)
    groups = grouped(left, right, at)
    ends = np.cumsum(na), np.cumsum(nb)
    doc_of_group = docs[0][np.searchsorted(groups[0], np.arange(groups[0][-1] + 1))]
    links = np.bincount(groups[0]) * np.bincount(groups[1])
    doc, pair, times = linked_pairs((a, b), groups, doc_of_group)
    edges = np.searchsorted(doc, np.arange(len(which) + 1))
    for into, values in zip(numbers, (na, nb, np.bincount(doc_of_group, minlength=len(which)), np.bincount(doc_of_group, weights=links, minlength=len(which)).astype(np.int64))):
        into[which] = values
    for k, (i, line) in enumerate(zip(which, written((a, b), groups, ends, sides))):
        digests[i] = hashlib.sha256(line).hexdigest()
        held[i] = pair[edges[k] : edges[k + 1]], times[edges[k] : edges[k + 1]]
        if keep_groups:
            kept[i] = line.decode()
    return numbers, digests, kept, held


def align(docs: DataFrame, file: str, model_file: str, key: str = "doc_id", text: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: the key, ``n_a`` and ``n_b`` (tokens of a byte-level BPE file and of a sentencepiece
    model), ``n_groups``, ``n_links``, ``n_best`` (links whose pair of ids is in as many documents as any pair of its A id),
    ``count_sum`` (over links, the number of documents that hold the pair) and ``groups_sha256``; with ``keep_groups`` also
    ``groups``, as ``a1,a2|b1;a3|b2,b3``.

    Side A reads a space and the text, side B the text (its model adds the space); strings of special tokens are plain
    text. A text that is null or empty, or that a side does not give back byte for byte, has no tokens and zeros. Repeated
    rows are documents each. No rows give none; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    made = stored(aligned(docs, file, model_file, key, text, keep_groups))
    entries = made.filter("pair is not null").select("block", "pair", "docs")
    counted = stored(entries.withColumn("total", F.sum("docs").over(Window.partitionBy("pair"))).drop("docs"))
    a_of = F.shiftright("pair", 32)
    best = counted.groupBy(a_of.alias("a")).agg(F.max("total").alias("most")).toArrow()        # at most a row per id of A
    most = np.zeros(int(max([0, *best.column(0).to_pylist()])) + 1, dtype=np.int64)
    most[best.column(0).to_numpy()] = best.column(1).to_numpy()
    shipped = Shipped(spark, most)

    def finish(rows: pa.Table, entries: pa.Table) -> pa.Table:
        pairs, totals = (entries.column(c).to_numpy() for c in ("pair", "total"))
        totals = totals[np.argsort(pairs)]
        best = totals == shipped.value[np.sort(pairs) >> 32]
        held = [np.frombuffer(zstandard.decompress(x), dtype="<u4").astype(np.int64).reshape(2, -1) for x in rows.column("held").to_pylist()]
        scores = [(int(times[best[at]].sum()), int((times * totals[at]).sum())) for at, times in held]
        out = rows.select(["key", "n_a", "n_b", "n_groups", "n_links"]).rename_columns([key, "n_a", "n_b", "n_groups", "n_links"])
        out = out.append_column("n_best", pa.array([x for x, _ in scores], pa.int64())).append_column("count_sum", pa.array([x for _, x in scores], pa.int64()))
        out = out.append_column("groups_sha256", rows.column("groups_sha256"))
        return out.append_column("groups", rows.column("groups")) if keep_groups else out

    kind = docs.schema[key].dataType.simpleString()
    rows = made.filter("pair is null").drop("pair", "docs")
    schema = f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + (", groups string" if keep_groups else "")
    return rows.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(finish, schema)
