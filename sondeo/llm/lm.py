"""Language-model scores of texts by a log-bilinear model, learned with noise-contrastive estimation.

The vectors of the words before a place, weighted by distance, predict a vector; its product with a word's own vector, and
that word's bias, is the word's score. The vocabulary is every word of the training documents. It is taken in two steps: a
place has a class (the end of a text, one of the most frequent words of the corpus, or a bucket of all other words, told by
their spelling), and a bucket has words. A word of a bucket has vectors of its own at both ends: one that it adds to the
context vector of its bucket, and one that tilts its share of the bucket's counts by what the place predicts. A word that
training never showed has its bucket's vectors alone, so every text has a probability and no word is outside the vocabulary.

Learning never sums over classes or words: it tells true ones from noise. Scoring does: matrix products give the score of every
class at many places at once; within a bucket the ``HEADS`` most frequent words are summed one by one, all others by the mean
and the covariance of their vectors (:class:`Within`).

Words are counted over the whole corpus. A block of documents shares one dictionary of its words; only dictionaries are
shuffled by word, counted, and sent back to the documents of their block. Tasks learn on their own documents from common
weights, and their results are averaged, in two rounds: the first learns the classes on a part of the training documents, the
second classes and words on all of them. Vectors of words stay in tables: a block learns those of its dictionary, they are
averaged by word, by the uses in each block, and go back to the blocks that hold the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondeo.llm.support import Shipped, _utf8_lengths, chunks, freed, give_back, lighter_batches, shuffles_freed, stored, tidy

END = 0
#: Frequent words and buckets of the others: classes 1 to WORDS, and from there on.
WORDS, BUCKETS = 127, 128
#: Words before a place, size of vectors, noise words of a batch, places of a batch, places scored at a time (they fit a core's cache).
CONTEXT, WIDTH, NOISE, BATCH, SCORED = 3, 24, 64, 4096, 512
#: The least places of a batch, and the steps that a lot of few places is learned in.
LEAST_BATCH, STEPS = 256, 32
#: Characters of a block, and of the texts that are split at a time.
BLOCK_CHARS, CHUNK_CHARS = 16_000_000, 1_000_000
#: Parts of the training documents (by a hash of the key) that the rounds learn from, and their steps.
ROUNDS = ((0.15, 0.06), (1.0, 0.02))
#: Numbers of a vector that a word of a bucket has of its own, the step they are learned in, words that it is told from at a
#: place, and words of a bucket that are summed one by one.
OWN, OWN_RATE, OTHERS, HEADS = 8, 0.1, 4, 64
#: Entries of dictionaries whose vectors are averaged at a time.
SHARD = 250_000


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at blanks and the controls 9 to 13."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def bucket_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word[-2:], seed=5) % BUCKETS


class Places(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def dictionaries(docs: DataFrame, key: str, text: str, teaches: Column) -> DataFrame:
    """A row per document (its words as places in its block's dictionary, and whether the first round learns from it) and a row
    per block and word: hash, bucket, uses in training documents."""
    lighter_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = ["block", "key", "teaches", "early", "words", "place", "word", "bucket", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, places, counts = TaskContext.get().partitionId() << 32, 0, Places(), np.zeros(0, dtype=np.int64)
        for batch in batches:
            lengths = _utf8_lengths(batch.column(3))
            for lo, hi in chunks(lengths, CHUNK_CHARS):
                split = [words_of(x) for x in batch.column(3).slice(lo, hi - lo).to_pylist()]
                codes = [np.fromiter(map(places.__getitem__, x), dtype=np.uint32, count=len(x)) for x in split]
                teaching = batch.column(1).slice(lo, hi - lo)
                used = [c for c, t in zip(codes, teaching.to_pylist()) if t]
                more = np.bincount(np.concatenate(used), minlength=len(places)) if used else np.zeros(len(places), dtype=np.int64)
                more[: len(counts)] += counts
                counts = more
                none = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(none, block)), batch.column(0).slice(lo, none), teaching, batch.column(2).slice(lo, none), pa.array([zstandard.compress(c.tobytes(), 1) for c in codes], pa.binary()),
                     pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64())], names=names)
                size += int(lengths[lo:hi].sum())
                if size >= BLOCK_CHARS:
                    yield from dictionary(block, places, counts, batch.column(0).type)
                    block, size, places, counts = block + 1, 0, Places(), np.zeros(0, dtype=np.int64)
        if places:
            yield from dictionary(block, places, counts, batch.column(0).type)

    def dictionary(block: int, places: Places, counts: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        words = list(places)
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            none = len(part)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, part), dtype=np.uint64, count=none).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(none, block)), pa.nulls(none, kind), pa.nulls(none, pa.bool_()), pa.nulls(none, pa.bool_()), pa.nulls(none, pa.binary()), pa.array(np.arange(lo, lo + none, dtype=np.int32)),
                 pa.array(hashes), pa.array(np.array([bucket_of(w) for w in part], dtype=np.int32)), pa.array(counts[lo : lo + none])], names=names)

    share = F.pmod(F.xxhash64(docs[key].cast("string"), F.lit("round")), F.lit(1_000_003)) / 1_000_003.0
    early = F.coalesce(share < ROUNDS[0][0], F.lit(False))
    return docs.select(docs[key].alias("key"), teaches.alias("teaches"), early.alias("early"), docs[text].alias("text")).mapInArrow(
        tidy(run), f"block long, key {kind}, teaches boolean, early boolean, words binary, place int, word long, bucket int, n long")


@dataclass(frozen=True)
class Counts:
    """What the corpus says: frequent words (hashes, ascending, and the class of each), tokens and distinct words of each
    bucket beyond them, counts of the classes, all tokens (``tokens``), distinct ones (``distinct``), ends of texts, and the
    hashes (ascending) of the most frequent words of each bucket."""

    frequent: np.ndarray
    classes: np.ndarray
    bucket_tokens: np.ndarray
    bucket_words: np.ndarray
    uses: np.ndarray
    tokens: int
    distinct: int
    ends: int
    heads: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def base(self, c: np.ndarray) -> np.ndarray:
        """log10 of the smoothed share of tokens that occur ``c`` times in training."""
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def class_of(self, word: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.frequent, word), max(0, len(self.frequent) - 1))
        known = self.frequent[at] == word if len(self.frequent) else np.zeros(len(word), dtype=bool)
        return np.where(known, self.classes[at] if len(self.frequent) else 0, 1 + WORDS + bucket)

    def within(self, c: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its bucket; all words that training never showed have half a use."""
        return np.log10((c + 0.5) / (self.bucket_tokens[bucket] + 0.5 * (self.bucket_words[bucket] + 1)))


@dataclass
class Model:
    """Vectors of context words (one row more: before the text), weights by distance, vectors and biases of classes."""

    context: np.ndarray
    distance: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.distance, self.target, self.bias]

    @staticmethod
    def new(uses: np.ndarray, width: int = WIDTH, reach: int = CONTEXT, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        n = len(uses)
        bias = np.log((uses + 0.5) / (uses.sum() + 0.5 * n))
        return Model(*(x.astype(np.float32) for x in (rng.normal(0, 0.1, (n + 1, width)), np.full((reach, width), 1 / reach), rng.normal(0, 0.1, (n, width)), bias)))

    def predicted(self, before: np.ndarray, near: np.ndarray | None = None) -> np.ndarray:
        """What the classes ``before`` predict, with what the words of which they are add (``near``: own vectors)."""
        out = self.context[before[:, 0]] * self.distance[0]
        for k in range(1, before.shape[1]):
            out += self.context[before[:, k]] * self.distance[k]
        if near is not None:
            out[:, :OWN] += np.einsum("nkd,kd->nd", near, self.distance[:, :OWN])
        return out

    def log10(self, before: np.ndarray, classes: np.ndarray, predicted: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each class after the ones before it (or at places where ``predicted`` is), normalised over all classes."""
        out = np.zeros(len(classes))
        weights = np.vstack([self.target.T, self.bias[None]])       # the bias goes along in the product
        ones = np.ones(len(self.bias), dtype=np.float32)
        for lo in range(0, len(classes), SCORED):
            mine = classes[lo : lo + SCORED]
            q = np.ones((len(mine), len(weights)), dtype=np.float32)
            q[:, :-1] = self.predicted(before[lo : lo + SCORED]) if predicted is None else predicted[lo : lo + SCORED]
            scores = q @ weights
            chosen, top = scores[np.arange(len(mine)), mine].astype(np.float64), 0.0
            if max(scores.max(), -scores.min()) > 60:               # beyond what exp can hold
                top = scores.max(axis=1)
                scores -= top[:, None]
            out[lo : lo + SCORED] = chosen - top - np.log((np.exp(scores, out=scores) @ ones).astype(np.float64))
        return out / np.log(10)

    def learn(self, before: np.ndarray, classes: np.ndarray, noise: np.ndarray, rate: float, rng: np.random.Generator, state: list[np.ndarray],
              own: Own | None = None, near: np.ndarray | None = None, words: np.ndarray | None = None) -> None:
        """One batch of noise-contrastive estimation: the true class against ``NOISE`` drawn from ``noise`` (shares), by Adagrad;
        with ``own`` also the true word of a bucket (``words`` and ``near`` are rows of ``own``) against others of the bucket."""
        n, drawn = len(classes), rng.choice(len(noise), NOISE, p=noise)
        odds = np.log(NOISE * noise).astype(np.float32)
        added = None if own is None else own.context[near]
        q = self.predicted(before, added)
        true, false = self.target[classes], self.target[drawn]
        g_true = _sigmoid(_dots(q, true) + (self.bias - odds)[classes]) - 1
        g_false = _sigmoid(q @ false.T + (self.bias - odds)[drawn])
        dq = g_true[:, None] * true + g_false @ false
        target, bias = _summed(classes, g_true[:, None] * q, len(noise)), np.bincount(classes, weights=g_true, minlength=len(noise))
        np.add.at(target, drawn, g_false.T @ q)
        np.add.at(bias, drawn, g_false.sum(axis=0))
        if own is not None:
            own.learn_target(q, dq, words, classes)
        context, distance = np.zeros_like(self.context), np.zeros_like(self.distance)
        for k in range(before.shape[1]):
            context += _summed(before[:, k], dq * self.distance[k], len(self.context))
            distance[k] = np.einsum("nd,nd->d", self.context[before[:, k]], dq)
        if own is not None:
            distance[:, :OWN] += np.einsum("nkd,nd->kd", added, dq[:, :OWN])
            own.learn_context(near, dq, self.distance)
        for part, grad, seen in zip(self.parts(), (context, distance, target, bias), state):
            grad = (grad / n).astype(np.float32)
            seen += grad ** 2
            part -= rate * grad / (np.sqrt(seen) + 1e-6)


@dataclass
class Own:
    """Vectors of the words of a dictionary: what each adds to the context vector of its bucket, and what tilts its share of the
    bucket (``OWN`` numbers for the first ones of what is predicted, and a bias). The last row stays 0: no word of a bucket."""

    context: np.ndarray
    target: np.ndarray
    seen: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def new(words: int) -> Own:
        """All 0: a word begins as its bucket's share of the counts."""
        return Own(np.zeros((words + 1, OWN), dtype=np.float32), np.zeros((words + 1, OWN + 1), dtype=np.float32))

    def tilt(self, words: np.ndarray, predicted: np.ndarray) -> np.ndarray:
        theta = self.target[words]
        return _dots(theta[:, :OWN], predicted[:, :OWN]) + theta[:, OWN]

    def learn_target(self, q: np.ndarray, dq: np.ndarray, words: np.ndarray, buckets: np.ndarray) -> None:
        """Each true word of a bucket against the next ``OTHERS`` words of the bucket in the batch: these are drawn by the shares of the
        bucket, so that the odds of the two are the tilt alone."""
        at = np.flatnonzero(words != len(self.target) - 1)
        if not len(at):
            return
        at = at[np.argsort(buckets[at].astype(np.uint16), kind="stable")]
        found, place = buckets[at], np.arange(len(at))
        begin = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        size = np.diff(np.append(begin, len(at)))
        begin, size = np.repeat(begin, size), np.repeat(size, size)
        q1 = np.ones((len(at), OWN + 1), dtype=np.float32)
        q1[:, :OWN] = q[at, :OWN]
        true, odds = self.target[words[at]], np.float32(np.log(OTHERS))
        g = _sigmoid(_dots(true, q1) - odds) - 1
        grads, more = g[:, None] * q1, g[:, None] * true
        for k in range(1, OTHERS + 1):
            other = begin + (place - begin + k) % size          # each place is the k-th other of one
            false = true[other]
            g = _sigmoid(_dots(false, q1) - odds)
            grads[other] += g[:, None] * q1
            more += g[:, None] * false
        dq[at, :OWN] += more[:, :OWN]
        self._step(1, words[at], grads)

    def learn_context(self, near: np.ndarray, dq: np.ndarray, distance: np.ndarray) -> None:
        rows = near.ravel()
        at = np.flatnonzero(rows != len(self.context) - 1)
        if len(at):
            self._step(0, rows[at], (dq[:, None, :OWN] * distance[None, :, :OWN]).reshape(-1, OWN)[at])

    def _step(self, which: int, rows: np.ndarray, grads: np.ndarray) -> None:
        """Adagrad on the rows that occur; each has its own sums, which begin with 1."""
        if not self.seen:
            self.seen = [np.ones_like(self.context), np.ones_like(self.target)]
        part, seen = (self.context, self.target)[which], self.seen[which]
        order = np.argsort(rows.astype(np.int32))
        found = rows[order]
        begin = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        at, grad = found[begin], np.add.reduceat(grads[order], begin, axis=0)
        sums = seen[at] + grad ** 2
        seen[at] = sums
        part[at] -= OWN_RATE * grad / np.sqrt(sums)


@dataclass(frozen=True)
class Within:
    """The sum, over all words of a bucket, of share times e^tilt: by word for the most frequent ones (bucket, share, target
    vector, by bucket), and for the rest of each bucket by their share in all, mean and covariance (as if the tilt were normal)."""

    bucket: np.ndarray
    share: np.ndarray
    target: np.ndarray
    rest: np.ndarray
    mean: np.ndarray
    covariance: np.ndarray

    @staticmethod
    def of(heads: np.ndarray, moments: np.ndarray, unseen: np.ndarray) -> Within:
        """``heads``: a row per word (bucket, share, target vector). ``moments``: per bucket the sums, over its other words, of share, share
        times target, and share times target times target. ``unseen``: the share of each bucket's unseen words, without a tilt."""
        heads = heads[np.argsort(heads[:, 0], kind="stable")]
        n, rest = OWN + 1, moments[:, 0] + unseen
        mean = moments[:, 1 : 1 + n] / rest[:, None]
        covariance = moments[:, 1 + n :].reshape(-1, n, n) / rest[:, None, None] - mean[:, :, None] * mean[:, None, :]
        return Within(heads[:, 0].astype(np.int64), heads[:, 1].astype(np.float32), heads[:, 2:].astype(np.float32), rest, mean.astype(np.float32), covariance.astype(np.float32))

    def log(self, buckets: np.ndarray, predicted: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buckets))
        order = np.argsort(buckets.astype(np.uint16), kind="stable")
        edges, heads = (np.searchsorted(x, np.arange(len(self.rest) + 1)) for x in (buckets[order], self.bucket))
        for b in np.flatnonzero(np.diff(edges)):
            at = order[edges[b] : edges[b + 1]]
            q1 = np.ones((len(at), OWN + 1), dtype=np.float32)
            q1[:, :OWN] = predicted[at, :OWN]
            mine = slice(heads[b], heads[b + 1])
            tilts = q1 @ self.target[mine].T
            others = q1 @ self.mean[b] + _dots(q1 @ self.covariance[b], q1) / 2
            if max(tilts.max(initial=0), others.max()) > 60:        # beyond what exp can hold
                tilts, others = np.minimum(tilts, 60), np.minimum(others, 60)
            out[at] = np.log(np.exp(tilts, out=tilts) @ self.share[mine] + self.rest[b] * np.exp(others.astype(np.float64)))
        return out


def packed(vectors: np.ndarray) -> bytes:
    """Rows of floats, a byte a number, by the largest of the row."""
    most = (np.abs(vectors).max(axis=1, initial=0) / 127).astype(np.float32)
    return most.tobytes() + np.rint(vectors / np.where(most > 0, most, 1)[:, None]).astype(np.int8).tobytes()


def unpacked(blob: bytes, width: int = 2 * OWN + 1) -> np.ndarray:
    n = len(blob) // (4 + width)
    return np.frombuffer(blob, dtype=np.int8, offset=4 * n).reshape(n, width) * np.frombuffer(blob, dtype=np.float32, count=n)[:, None]


def batch_of(places: int) -> int:
    """Places of a batch: fewer where there are few in all, so that a small corpus is learned in ``STEPS`` steps too."""
    return min(BATCH, max(LEAST_BATCH, places // STEPS))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.clip(x, -30, 30)
    np.exp(np.negative(out, out=out), out=out)
    out += 1
    return np.reciprocal(out, out=out)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products row by row."""
    return np.einsum("nd,nd->n", a, b)


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row number."""
    out = np.zeros((n, values.shape[1]), dtype=np.float32)
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    found = rows[order]
    begin = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    out[found[begin]] = np.add.reduceat(values[order], begin, axis=0)
    return out


def places_of(texts: list[np.ndarray], start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts with their ends (``end``), and before each the ``CONTEXT`` words that precede it, nearest first
    (``start`` before the text)."""
    gap = np.full(CONTEXT, start, dtype=np.int64)
    line = np.concatenate([x for t in texts for x in (gap, t, [end])]).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes + CONTEXT)
    at = np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
    return np.stack([line[at - k - 1] for k in range(CONTEXT)], axis=1), line[at]


@dataclass(frozen=True)
class Block:
    """A block of documents (a table: key, teaches, early, n_tokens, n_known, base_score, words) and its dictionary: hashes, classes, uses
    in the block's and in all training documents."""

    docs: pa.Table
    words: np.ndarray
    classes: np.ndarray
    uses: np.ndarray
    total: np.ndarray

    SCHEMA = "block long, docs binary, words binary, classes binary, uses binary, total binary"

    def row(self, block: int) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.docs.schema) as out:
            out.write_table(self.docs)
        blobs = [zstandard.compress(x.astype(t).tobytes(), 1) for x, t in ((self.words, np.int64), (self.classes, np.uint16), (self.uses, np.int64), (self.total, np.int64))]
        return pa.table([pa.array([block]), *(pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), *blobs))], names=["block", "docs", "words", "classes", "uses", "total"])

    @staticmethod
    def read(table: pa.Table | pa.RecordBatch, i: int) -> Block:
        docs, *blobs = (table.column(c)[i].as_buffer() for c in ("docs", "words", "classes", "uses", "total"))
        kinds = (np.int64, np.uint16, np.int64, np.int64)
        return Block(pa.ipc.open_stream(docs).read_all(), *(np.frombuffer(zstandard.decompress(x), dtype=t) for x, t in zip(blobs, kinds)))

    def own_rows(self) -> np.ndarray:
        """The place in the dictionary of each word of a bucket that training showed, and of all else (also a text's end and what is
        before it) the row of no word."""
        none = len(self.words)
        return np.append(np.where((self.classes > WORDS) & (self.total > 0), np.arange(none), none), [none, none])

    def lots(self, chosen: np.ndarray, start: int, most: int = 140_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of chosen documents, at most about ``most`` places at a time: which they are, the classes before each place and its own, and the
        words (rows of own vectors) before it and its own."""
        none = len(self.words)
        classes, rows, blobs = np.append(self.classes, [END, start]).astype(np.int64), self.own_rows(), self.docs.column("words")
        sizes = self.docs.column("n_tokens").to_numpy()
        which = np.flatnonzero(chosen)
        for lo, hi in chunks(sizes[which], most):
            mine = which[lo:hi]
            texts = [np.frombuffer(zstandard.decompress(blobs[int(i)].as_py()), dtype=np.uint32) for i in mine]
            near, words = places_of(texts, none + 1, none)
            yield mine, classes[near], classes[words], rows[near], words


def blocks(rows: DataFrame, entries: DataFrame, counts: Counts) -> DataFrame:
    """A row per block: its documents with their numbers of tokens and of known ones and the base score, and its dictionary."""
    def finish(texts: pa.Table, words: pa.Table) -> pa.Table:
        give_back()
        order = np.argsort(words.column("place").to_numpy())
        total, bucket, word, uses = (words.column(c).to_numpy()[order] for c in ("total", "bucket", "word", "n"))
        base, known = counts.base(total), total > 0
        end, out = float(counts.base(np.array([counts.ends]))[0]), []
        for blob in texts.column("words").to_pylist():
            at = np.frombuffer(zstandard.decompress(blob), dtype=np.uint32)
            out.append((len(at) + 1, int(known[at].sum()) + (counts.ends > 0), float(base[at].sum()) + end))
        made = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))]
        names = ["key", "teaches", "early", "n_tokens", "n_known", "base_score", "words"]
        docs = pa.Table.from_arrays([*(texts.column(c) for c in names[:3]), *made, texts.column("words")], names=names)
        return Block(docs, word, counts.class_of(word, bucket), uses, total).row(texts.column("block")[0].as_py())

    return rows.groupBy("block").cogroup(entries.groupBy("block")).applyInArrow(finish, Block.SCHEMA)


def corpus_counts(counted: DataFrame, ends: int) -> Counts:
    """``counted`` holds a row per block and word, ``first`` where the word has not come before."""
    once = counted.filter("first and total > 0")
    top = once.orderBy(F.desc("total"), "word").limit(WORDS).select("word", "total", "bucket").toArrow()
    by_bucket = once.groupBy("bucket").agg(F.sum("total").alias("tokens"), F.count(F.lit(1)).alias("words")).toArrow()     # a row per bucket
    tokens, words = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    tokens[by_bucket.column("bucket").to_numpy()], words[by_bucket.column("bucket").to_numpy()] = by_bucket.column("tokens").to_numpy(), by_bucket.column("words").to_numpy()
    all_tokens, all_words = int(tokens.sum()) + ends, int(words.sum()) + (ends > 0)
    by_use = Window.partitionBy("bucket").orderBy(F.desc("total"), "word")
    heads = once.withColumn("rank", F.row_number().over(by_use)).filter(F.col("rank") <= HEADS).select("word").toArrow().column(0).to_numpy()     # HEADS rows per bucket
    hashes, uses, bucket = (top.column(c).to_numpy() for c in ("word", "total", "bucket"))
    np.subtract.at(tokens, bucket, uses)
    np.subtract.at(words, bucket, 1)
    order = np.argsort(hashes)
    class_uses = np.concatenate([[ends], uses, np.zeros(WORDS - len(uses), dtype=np.int64), tokens])
    return Counts(hashes[order], order + 1, tokens, words, class_uses, all_tokens, all_words, ends, np.setdiff1d(heads, hashes))


def _added(rows: DataFrame) -> list:
    """The sums (vectors of doubles) and heads of all rows, added up and strung together in tasks: one row at most."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total, heads = 0.0, None, []
        for batch in batches:
            for w, blob, more in zip(*(batch.column(c).to_pylist() for c in ("weight", "sums", "heads"))):
                weight, total = weight + w, np.frombuffer(blob) + (0 if total is None else total)
                heads.append(more)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total.tobytes()], pa.binary()), pa.array([b"".join(heads)], pa.binary()), pa.array([0], pa.int32())], names=["weight", "sums", "heads", "task"])

    schema = "weight double, sums binary, heads binary, task int"
    some = rows.select("weight", "sums", "heads", "task").repartition(16, "task").mapInArrow(add, schema)
    return some.coalesce(1).mapInArrow(add, schema).collect()


LEARNED = "shard int, block long, words binary, buckets binary, uses binary, vectors binary, weight double, sums binary, heads binary, task int"


def train(texts: DataFrame, counts: Counts, shards: int) -> tuple[Model, Within, DataFrame]:
    """A model from the blocks of ``texts``, what the words of its buckets add up to, and for each block and shard the vectors of the
    words of the block, in the order of :func:`sent`.

    In each round every task learns on its documents from the common weights; results are averaged, weighing by places, and those of
    words by their uses in each block. What reaches the driver is one model, moments of buckets and ``HEADS`` words of each.
    """
    spark, model = texts.sparkSession, Model.new(counts.uses)
    noise = (counts.uses + 0.5) / (counts.uses.sum() + 0.5 * len(counts.uses))
    for high, rate in ROUNDS:
        last = high == ROUNDS[-1][0]
        shipped = Shipped(spark, (model, noise))

        def learn(batches: Iterator[pa.RecordBatch], shipped=shipped, rate=rate, last=last) -> Iterator[pa.RecordBatch]:
            model, noise = shipped.value
            parts = [x.copy() for x in model.parts()]
            mine, rng = Model(*parts), np.random.default_rng(TaskContext.get().partitionId())
            state, places = [np.full_like(x, 1e-6) for x in parts], 0
            for batch in batches:
                for i in range(batch.num_rows):
                    block = Block.read(batch, i)
                    teaches, early = (block.docs.column(c).to_numpy() for c in ("teaches", "early"))
                    own = Own.new(len(block.words)) if last else None
                    rows = block.own_rows()
                    for _, before, classes, near, words in block.lots(teaches if last else teaches & early, len(noise)):
                        words = rows[words]
                        order, size = rng.permutation(len(classes)), batch_of(len(classes))
                        for lo in range(0, len(order), size):
                            at = order[lo : lo + size]
                            more = (own, near[at], words[at]) if last else ()
                            mine.learn(before[at], classes[at], noise, rate, rng, state, *more)
                        places += len(classes)
                    if last:
                        yield from vectors(batch.column("block")[i].as_py(), block, own)
            if places:
                flat = np.concatenate([x.ravel() for x in mine.parts()]).astype(np.float64)
                task = TaskContext.get().partitionId()
                yield learned(-1 - task % 16, weight=float(places), sums=(flat * places).tobytes(), task=task)

        def vectors(block: int, held: Block, own: Own) -> Iterator[pa.RecordBatch]:
            every = np.concatenate([own.context, own.target], axis=1)
            for shard, at in sent(held, shards):
                yield learned(shard, block, held.words[at].tobytes(), (held.classes[at] - 1 - WORDS).astype(np.uint8).tobytes(), zstandard.compress(held.uses[at].astype(np.int64).tobytes(), 1), packed(every[at]))

        each = stored(texts.mapInArrow(tidy(learn), LEARNED))
        rows = _added(each.filter("shard < 0"))
        if rows:
            flat, cut = np.frombuffer(rows[0]["sums"]) / rows[0]["weight"], 0
            for part in model.parts():
                part[...] = flat[cut : cut + part.size].reshape(part.shape)
                cut += part.size
        shipped.done()

    def settle(table: pa.Table) -> pa.Table:
        give_back()
        return settled(table, counts)

    back = stored(each.filter("shard >= 0").groupBy("shard").applyInArrow(settle, LEARNED))
    freed(each)
    width = 1 + (OWN + 1) * (OWN + 2)
    rows = _added(back.filter("block is null"))
    moments = np.frombuffer(rows[0]["sums"]).reshape(BUCKETS, width) if rows else np.zeros((BUCKETS, width))
    heads = np.frombuffer(rows[0]["heads"] if rows else b"").reshape(-1, 2 + OWN + 1)
    unseen = 10 ** counts.within(np.zeros(BUCKETS), np.arange(BUCKETS))
    return model, Within.of(heads, moments, unseen), back.filter("block is not null").select("shard", "block", "vectors")


def learned(shard: int, block: int | None = None, words: bytes = b"", buckets: bytes = b"", uses: bytes = b"", vectors: bytes = b"",
            weight: float = 0.0, sums: bytes = b"", heads: bytes = b"", task: int = 0) -> pa.RecordBatch:
    """A row of ``LEARNED``."""
    blobs = [pa.array([x], pa.binary()) for x in (words, buckets, uses, vectors)]
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), *blobs, pa.array([weight]), pa.array([sums], pa.binary()), pa.array([heads], pa.binary()), pa.array([task], pa.int32())],
        names=["shard", "block", "words", "buckets", "uses", "vectors", "weight", "sums", "heads", "task"])


def sent(block: Block, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the words of buckets that training showed, by shard, always in the same order."""
    at = np.flatnonzero((block.classes > WORDS) & (block.total > 0))
    shard = (block.words[at].view(np.uint64) >> np.uint64(20)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
    for s in np.flatnonzero(np.diff(edges)):
        yield int(s), at[order[edges[s] : edges[s + 1]]]


def settled(table: pa.Table, counts: Counts) -> pa.Table:
    """Of one shard, the vectors of each word averaged over its blocks by uses and sent back to each, and what its words add to the
    sums of their buckets (a row without a block)."""
    words, buckets, uses, vectors = [], [], [], []
    for w, b, u, v in zip(*(table.column(c).to_pylist() for c in ("words", "buckets", "uses", "vectors"))):
        words.append(np.frombuffer(w, dtype=np.int64))
        buckets.append(np.frombuffer(b, dtype=np.uint8))
        uses.append(np.frombuffer(zstandard.decompress(u), dtype=np.int64))
        vectors.append(unpacked(v))
    ends = np.cumsum([len(x) for x in words])
    word, first, at = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
    bucket, use = np.concatenate(buckets)[first].astype(np.int64), np.concatenate(uses)
    order = np.argsort(at, kind="stable")
    begin = np.searchsorted(at[order], np.arange(len(word)))
    total = np.add.reduceat(use[order], begin)
    every = np.concatenate(vectors)
    every *= use[:, None].astype(np.float32)
    mean = np.add.reduceat(every[order], begin, axis=0) / total[:, None].astype(np.float32)
    del vectors, every
    mean = unpacked(packed(mean))
    shard = table.column("shard")[0].as_py()
    rows = [learned(shard, b, vectors=packed(mean[x])) for b, x in zip(table.column("block").to_pylist(), np.split(at, ends[:-1]))]
    share, target = 10 ** counts.within(total, bucket), mean[:, OWN:].astype(np.float64)
    head = np.isin(word, counts.heads)
    heads = np.concatenate([bucket[:, None], share[:, None], target], axis=1)[head]
    sums = np.zeros((BUCKETS, 1 + (OWN + 1) * (OWN + 2)))
    for b in np.unique(bucket[~head]):
        mine = ~head & (bucket == b)
        x, s = target[mine], share[mine]
        sums[b] = np.concatenate([[s.sum()], s @ x, ((x * s[:, None]).T @ x).ravel()])
    return pa.Table.from_batches([*rows, learned(shard, None, sums=sums.tobytes(), heads=heads.tobytes(), task=shard)])


def score(docs: DataFrame, teaches: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, ``teaches``, ``n_tokens`` (words and one end), ``n_known`` (those that training
    documents hold), ``train_tokens`` (tokens of all training documents), ``base_score`` (log10 probability by smoothed
    counts of single tokens) and ``score`` (by the model).

    ``teaches`` says which rows are training documents (null: not). A null or empty text is the end alone. Repeated rows
    count each. No rows give none; other columns are ignored, whatever their names. Without training documents the
    model is the one that training starts from. Words are told apart by 64-bit hashes; two of 10^9 different words share
    one with a chance of about 3 percent.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    same = Window.partitionBy("word")
    with shuffles_freed(spark):
        made = stored(dictionaries(docs, key, text, F.coalesce(teaches, F.lit(False))))
        entries = made.filter("word is not null").select("block", "place", "word", "bucket", "n")
        counted = entries.withColumn("total", F.sum("n").over(same)).withColumn("first", F.row_number().over(same.orderBy("block")) == 1)
        counted = stored(counted)
        rows = stored(made.filter("word is null").select("block", "key", "teaches", "early", "words"))
        freed(made)
        counts = corpus_counts(counted, rows.filter("teaches").count())
        shards = 1 + counted.count() // SHARD
        texts = stored(blocks(rows, counted.select("block", "place", "word", "bucket", "n", "total"), counts))
        freed(rows, counted)
        model, within, vectors = train(texts, counts, shards)
    shipped = Shipped(spark, (model, within))

    def judge(held: pa.Table, vectors: pa.Table) -> pa.Table:
        give_back()
        model, within = shipped.value
        out = [_scores(Block.read(held, i), vectors, model, within, counts, shards) for i in range(held.num_rows)]
        return pa.concat_tables(out).rename_columns([key, "teaches", "n_tokens", "n_known", "base_score", "score"])

    found = texts.groupBy("block").cogroup(vectors.groupBy("block")).applyInArrow(
        judge, f"`{key}` {kind}, teaches boolean, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("train_tokens", F.lit(counts.tokens).cast("long"))


def _scores(block: Block, vectors: pa.Table, model: Model, within: Within, counts: Counts, shards: int) -> pa.Table:
    """The documents of a block with their scores; ``vectors`` holds those of its words, a row per shard."""
    own, came = Own.new(len(block.words)), dict(zip(vectors.column("shard").to_pylist(), vectors.column("vectors").to_pylist()))
    for shard, at in sent(block, shards):
        both = unpacked(came[shard])
        own.context[at], own.target[at] = both[:, :OWN], both[:, OWN:]
    buckets = block.classes.astype(np.int64) - 1 - WORDS
    share = np.append(np.where(buckets >= 0, counts.within(block.total, np.maximum(buckets, 0)), 0.0), 0.0)
    rows, score = block.own_rows(), np.zeros(block.docs.num_rows)
    for mine, before, classes, near, words in block.lots(np.ones(len(score), dtype=bool), len(model.bias)):
        q = model.predicted(before, own.context[near])
        found, tail = model.log10(before, classes, q), np.flatnonzero(classes > WORDS)
        q = q[tail, :OWN]
        tilt = own.tilt(rows[words[tail]], q) - within.log(classes[tail] - 1 - WORDS, q)
        found[tail] += np.minimum(share[words[tail]] + tilt / np.log(10), 0)
        sizes = block.docs.column("n_tokens").to_numpy()[mine]
        score[mine] = np.add.reduceat(found, np.cumsum(sizes) - sizes)
    return block.docs.select(["key", "teaches", "n_tokens", "n_known", "base_score"]).append_column("score", pa.array(score))
