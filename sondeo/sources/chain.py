"""sha256 of long files, split by split.

Every block of sha256 needs the state after the block before it, so a file cannot be hashed in parts that are merged. But the
state is eight numbers: the task of one split hands them to the task of the next. The k-th splits of all files are one
job; a task reads one split, and only states come to the driver.

Splits are those of Spark's text reader, which finds files wherever Spark does. Its lines end at the byte 0x0A and are taken as
bytes, not decoded.
"""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # executors need no copy of the package

BLOCK, MARK = 64, b"\xef\xbb\xbf"

#: Names of files that the text reader would unpack.
UNPACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd|xz)$"

#: Where the hash of a file stands: the chain after the blocks hashed, the bytes after them (the last one seen is always
#: among them), the number of bytes seen, and the start of the split they came from.
State = tuple[tuple[int, ...], bytes, int, int]


def _openssl() -> ctypes.CDLL | None:
    """The library behind hashlib, whose own objects cannot be stored and resumed; None where Python has another one."""
    try:
        import _hashlib

        library = ctypes.CDLL(getattr(_hashlib, "__file__", None))
        library.SHA256_Init.argtypes = [ctypes.c_void_p]
        library.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        return library
    except (ImportError, OSError, AttributeError):
        return None


def resumable() -> bool:
    return _openssl() is not None


def _compress(chain: tuple[int, ...], blocks: bytes) -> tuple[int, ...]:
    """The chain after whole blocks; an empty one is the start."""
    library, context = _openssl(), (ctypes.c_uint32 * 28)()      # SHA256_CTX of openssl/sha.h: the chain, then counts and a partial block
    if library is None:
        raise RuntimeError("a worker's Python has no OpenSSL with SHA256_Update, unlike the driver's")
    library.SHA256_Init(context)
    if chain:
        context[:8] = chain
    library.SHA256_Update(context, blocks, len(blocks))
    return tuple(context[:8])


def start(head: bytes = b"") -> State:
    return _compress((), b""), head, len(head), -1


def add(state: State, piece: bytes, split: int = 0) -> State:
    chain, rest, seen, last = state
    if split < last:
        raise RuntimeError(f"split {split} came after split {last}")
    data = rest + piece
    full = max(len(data) - 1, 0) // BLOCK * BLOCK
    return _compress(chain, data[:full]), data[full:], seen + len(piece), split


def digest(state: State, length: int) -> str | None:
    """The digest as hexadecimal text; None if other bytes were seen than a file of this length has.

    Every line was given the end that the last line of a file may lack.
    """
    chain, rest, seen, _ = state
    if seen not in (length, length + 1):
        return None
    rest = rest[:len(rest) - (seen - length)]
    padded = rest + b"\x80" + b"\0" * ((55 - length) % BLOCK) + (8 * length).to_bytes(8, "big")
    return "".join(f"{word:08x}" for word in _compress(chain, padded))


def _join_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(split, piece): lines of one split that follow each other as one cell."""
    for batch in batches:
        begins = batch.column("split").to_pylist()
        lines = batch.column("line").to_pylist()
        at = 0
        for i in range(1, len(begins) + 1):
            if i == len(begins) or begins[i] != begins[at]:
                yield pa.RecordBatch.from_arrays([pa.array([begins[at]], pa.int64()), pa.array([b"\n".join(lines[at:i]) + b"\n"], pa.binary())], ["split", "piece"])
                at = i


def literal(path: str) -> str:
    """A path with the signs of patterns escaped."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text([literal(path)], lineSep="\n").select(F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_join_lines, "split bigint, piece binary")


def _step(index: int, pieces: Iterable[Row], states: dict[int, State]) -> Iterator[tuple[int, State]]:
    state = states[index]
    for split, piece in pieces:
        state = add(state, bytes(piece), split)
    yield index, state


def _states(spark: SparkSession, paths: list[str], head: bytes) -> dict[str, State]:
    """The state of each file after all its splits."""
    sc = spark.sparkContext
    parts = [_pieces(spark, path).rdd for path in paths]
    counts = [part.getNumPartitions() for part in parts]
    offsets = list(accumulate(counts, initial=0))[:-1]
    splits = sc.union(parts)
    found = {path: start(head) for path in paths}
    for k in range(max(counts)):
        file_of = {offset + k: path for path, offset, n in zip(paths, offsets, counts) if k < n}
        states = {index: found[path] for index, path in file_of.items()}
        job = splits.mapPartitionsWithIndex(lambda index, pieces, states=states: _step(index, pieces, states))
        found.update((file_of[index], state) for index, state in sc.runJob(job, lambda done: done, sorted(file_of)))
    return found


def long_file_sha256(spark: SparkSession, lengths: dict[str, int]) -> dict[str, str]:
    """sha256 of each path, as hexadecimal text. ``lengths`` holds each file's bytes, by which the reading is checked.

    The text reader drops a byte order mark at the start of a file: where its three bytes are missing, the file is read again with them.
    """
    found: dict[str, str] = {}
    for head in (b"", MARK):
        open_ = [path for path in sorted(lengths) if path not in found]
        if open_:
            states = _states(spark, open_, head)
            found.update((path, done) for path in open_ if (done := digest(states[path], lengths[path])))
    if len(found) < len(lengths):
        raise RuntimeError(f"not read byte for byte: {sorted(set(lengths) - set(found))}")
    return found
