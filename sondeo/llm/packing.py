"""Best-fit packing of token pieces into sequences, by exact complements.

The lengths of all pieces form a table of at most ``capacity`` counts. The plan is made on that table:
a gap is filled exactly, by one piece, a pair or a triple whose lengths add up to it, as long as such
pieces are available, and what cannot be filled exactly is packed best fit. The plan says, for the n-th
piece of a length, where it goes; Spark numbers the pieces of each length and looks their places up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondeo.llm.bpe import Vocabulary, WordEncoder, worker_encoder
from sondeo.llm.support import CHUNK_CHARS, Shipped, _utf8_lengths, chunks, lighter_batches, stored, tidy

CAPACITY = 4096
SLICE_ROWS = 100_000     # pieces of one length that one task numbers


class Lengths:
    """How many pieces of each length are free, and as two numbers with a bit per length: which are, upwards and downwards.

    The second index makes sums a shift: the lengths a for which a and gap - a are both free are the common bits
    of the first and of the second moved by capacity - gap.
    """

    def __init__(self, free: list[int], capacity: int, up: int | None = None, down: int | None = None):
        self.free, self.capacity = free, capacity
        self.up = sum(1 << i for i, n in enumerate(free) if n) if up is None else up
        self.down = sum(1 << capacity - i for i, n in enumerate(free) if n) if down is None else down

    def copy(self) -> Lengths:
        return Lengths(self.free.copy(), self.capacity, self.up, self.down)

    def take(self, length: int, times: int = 1) -> None:
        self.free[length] -= times
        if not self.free[length]:
            self.up ^= 1 << length
            self.down ^= 1 << self.capacity - length

    def longest(self, most: int) -> int:
        """The longest free length up to ``most``, 0 if there is none."""
        return max(0, (self.up & (2 << most) - 1).bit_length() - 1) if most > 0 else 0

    def pair(self, gap: int) -> tuple[int, int] | None:
        both = self.up & self.down >> self.capacity - gap
        if gap % 2 == 0 and self.free[gap // 2] < 2:
            both &= ~(1 << gap // 2)
        a = both.bit_length() - 1
        return (a, gap - a) if a > 0 else None

    def triple(self, gap: int) -> tuple[int, int, int] | None:
        a = self.longest(gap - 2)
        while 3 * a >= gap:                     # a is the longest of the three
            self.free[a] -= 1
            if self.free[a]:
                found = self.pair(gap - a)
            else:
                up, down = self.up, self.down
                self.up ^= 1 << a
                self.down ^= 1 << self.capacity - a
                found = self.pair(gap - a)
                self.up, self.down = up, down
            self.free[a] += 1
            if found:
                return (a, *found)
            a = self.longest(a - 1)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.free[gap] else self.pair(gap) or self.triple(gap)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (how many sequences, the lengths in each) that use up ``counts`` (by length, up to ``capacity``).

    Longest pieces first. What is left of a sequence is filled exactly if one free piece, a pair or a triple
    has that length; otherwise the longest piece that fits goes in, and what is then left is looked at
    again, until nothing fits. A pattern is used as often as its scarcest length allows, so the number of patterns
    follows the number of distinct lengths, not of pieces.
    """
    left = Lengths([0, *counts[1:].tolist()], capacity)
    out: list[tuple[int, tuple[int, ...]]] = []
    while length := left.longest(capacity):
        now, chosen, gap = left.copy(), [length], capacity - length
        now.take(length)
        while gap:
            found = now.exact(gap) or ((one,) if (one := now.longest(gap)) else None)
            if not found:
                break
            for x in found:
                now.take(x)
            chosen += found
            gap -= sum(found)
        uses = {x: chosen.count(x) for x in chosen}
        times = min(left.free[x] // n for x, n in uses.items())
        for x, n in uses.items():
            left.take(x, n * times)
        out.append((times, tuple(sorted(chosen, reverse=True))))
    return out


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """One row per pattern and length: length, first rank, pieces of that length in a sequence, first sequence, offset in it.

    The pieces of a length are numbered from 0; rank r of a row's range goes to sequence
    first + (r - first rank) // pieces, at offset + length * ((r - first rank) % pieces).
    """
    rows, used, sequence = [], {}, 0
    for times, lengths in patterns:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            n = lengths.count(length)
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def tokenised(docs: DataFrame, file: str, key: str, text: str, capacity: int, end: int) -> DataFrame:
    """Pieces of every text: its ids and then ``end``, cut every ``capacity`` ids."""
    lighter_batches(docs.sparkSession)
    shipped = Shipped(docs.sparkSession, Vocabulary(file))      # as large as the vocabulary
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(WordEncoder, shipped, file)
        close = end.to_bytes(4, "little")
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in chunks(_utf8_lengths(texts), 2 * CHUNK_CHARS):
                owner, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encoder.encode_all([x or "" for x in texts.slice(lo, hi - lo).to_pylist()])):
                    ids += close
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        owner.append(lo + i)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(tidy(run), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 1) -> DataFrame:
    """Where each piece of each text goes: key, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A null or empty text is the single id ``end``; only texts beyond ``capacity`` ids are cut. Repeated
    rows are packed each. No rows give no rows. Columns beside key and text are ignored; a key named like a column of the
    result is refused. The pieces of a length are numbered within hashed
    slices of about ``SLICE_ROWS``, shifted by the sizes of the slices before, so that a very common length is no single
    task at any size of the table.
    """
    if key in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset", "_slices", "_first", "_slice", "_rank"):
        raise ValueError(f"the key {key} is named like a column that packing makes; rename it")
    spark = docs.sparkSession
    pieces = stored(tokenised(docs, file, key, text, capacity, end))
    lengths = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toArrow()      # at most capacity rows
    total = np.zeros(capacity + 1, dtype=np.int64)
    total[lengths.column(0).to_numpy()] = lengths.column(1).to_numpy()
    slices = -(-total // SLICE_ROWS)
    first = np.cumsum(slices) - slices                  # the slices of all lengths, one after another
    cut = F.broadcast(spark.createDataFrame(pa.table({"length": np.arange(capacity + 1), "_slices": slices, "_first": first})))
    hashed = F.pmod(F.xxhash64(F.col(key).cast("string"), "piece", "ids_crc32"), F.col("_slices"))
    sliced = pieces.join(cut, "length").withColumn("_slice", F.col("_first") + hashed)
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).toArrow()      # capacity rows, and one for SLICE_ROWS pieces
    counts = np.zeros(int(slices.sum()), dtype=np.int64)
    counts[sizes.column(0).to_numpy()] = sizes.column(1).to_numpy()
    # pieces of the same length in the slices before
    running = np.cumsum(counts) - counts
    before = running - np.repeat((np.cumsum(total) - total), slices)
    where = places(plan(total, capacity))
    shipped = Shipped(spark, (before, where))     # a number for each slice, and the plan
    numbered = sliced.withColumn("_rank", F.row_number().over(Window.partitionBy("_slice").orderBy(key, "piece", "ids_crc32")) - 1)
    names = [key, "piece", "start", "length", "ids_crc32"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, where = shipped.value
        code = where[:, 0] << 40 | where[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(3).to_numpy()
            rank = before[batch.column(5).to_numpy()] + batch.column(6).to_numpy()
            row = where[np.searchsorted(code, length << 40 | rank, side="right") - 1]
            since = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(row[:, 3] + since // row[:, 2]), pa.array(row[:, 4] + length * (since % row[:, 2]))],
                names=[*names, "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    return numbered.select(*names, "_slice", F.col("_rank").cast("long").alias("_rank")).mapInArrow(
        look_up, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
