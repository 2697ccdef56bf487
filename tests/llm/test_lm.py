"""Language-model scores: counts against plain Python, gradients against differences, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondeo.llm import lm, support
from sondeo.llm.catalogue import QUERIES
from sondeo.llm.support import fold


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows):
    """(key, n_tokens, n_known, train_tokens, base_score) by the contract; rows are (key, text, teaches)."""
    uses, ends = Counter(), sum(t for *_, t in rows)
    for _, x, t in rows:
        uses.update(words(x) if t else ())
    tokens, distinct = sum(uses.values()) + ends, len(uses) + (ends > 0)
    share = lambda c: math.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
    for k, x, _ in rows:
        w = words(x)
        yield k, len(w) + 1, sum(uses[y] > 0 for y in w) + (ends > 0), tokens, sum(share(uses[y]) for y in w) + share(ends)


def same(got, rows):
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    for mine, want in zip(sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=order), sorted(brute(rows), key=order)):
        assert mine[:4] == want[:4] and mine[4] == pytest.approx(want[4], rel=1e-9, abs=1e-9)


def test_query_counts_exactly(spark, sf, documents):
    got = QUERIES["op13_lm_score"](spark, sf).collect()
    texts = [(r["doc_id"], r["text"]) for r in documents.collect()]
    same(got, [(k, t, zlib.crc32(str(k).encode()) % 5 != 1) for k, t in texts])
    assert {r["doc_id"]: r["held_out"] for r in got} == {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in texts}


@pytest.mark.parametrize("scale, gain", [("sf0.001", 0.02), ("sf0.01", 0.15)])
def test_held_out_texts_are_likelier_than_by_single_words(spark, scale, gain):
    held = QUERIES["op13_lm_score"](spark, f"/root/testdata/{scale}").filter("held_out").collect()
    n = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] for r in held) / n > sum(r["base_score"] for r in held) / n + gain


@pytest.mark.parametrize("places", [1, 200, 10_000, 131_072, 300_000])
def test_few_places_are_learned_in_many_steps(places):
    size = lm.batch_of(places)
    assert lm.LEAST_BATCH <= size <= lm.BATCH and (size == lm.LEAST_BATCH or places // size >= lm.STEPS)


def test_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 40_000)
    docs = odd.withColumns({c: F.lit(1) for c in ("block", "key", "words", "word", "place", "teaches", "n_tokens", "bucket")})
    got = lm.score(docs, F.col("doc_id") % 2 == 0).collect()
    same(got, [(r["doc_id"], r["text"], r["doc_id"] is not None and r["doc_id"] % 2 == 0) for r in docs.collect()])
    assert len(got) == docs.count() and all(r["score"] < 0 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (0, 1, 2, 3)}) == 1        # no words: the end alone
    assert lm.score(none, F.lit(True)).collect() == []
    untaught = lm.score(odd, F.lit(False)).collect()
    same(untaught, [(r["doc_id"], r["text"], False) for r in odd.collect()])


def test_probabilities_add_up(spark, documents):
    """Of the next word, over all classes and over the words of a bucket with one share for unseen ones."""
    rng = np.random.default_rng(2)
    uses = rng.integers(0, 50, 1 + lm.WORDS + lm.BUCKETS)
    model = lm.Model.new(uses)
    before = rng.integers(0, len(uses) + 1, (3, lm.CONTEXT))
    for row in before:
        every = model.log10(np.repeat(row[None], len(uses), axis=0), np.arange(len(uses)))
        assert (10 ** every).sum() == pytest.approx(1, abs=1e-5)
    counts = lm.Counts(np.array([5]), np.array([1]), np.array([7, 0]), np.array([3, 0]), uses, 20, 5, 2)
    assert (10 ** counts.within(np.array([4, 2, 1, 0]), np.zeros(4, dtype=int))).sum() == pytest.approx(1)


def test_learning_follows_the_gradient():
    """A step moves every weight against the numerical gradient of the noise-contrastive loss."""
    rng = np.random.default_rng(4)
    n = 9
    model = lm.Model.new(rng.integers(1, 9, n), width=4)
    before, classes, noise = rng.integers(0, n + 1, (20, lm.CONTEXT)), rng.integers(0, n, 20), np.full(n, 1 / n)
    drawn = np.random.default_rng(1).choice(n, lm.NOISE, p=noise)

    def loss():
        q = model.predicted(before).astype(float)
        odds = np.log(lm.NOISE * noise)
        true = (q * model.target[classes]).sum(axis=1) + model.bias[classes] - odds[classes]
        false = q @ model.target[drawn].T + model.bias[drawn] - odds[drawn]
        return (np.log1p(np.exp(-true)).sum() + np.log1p(np.exp(false)).sum()) / len(classes)

    slopes = []
    for part in model.parts():
        slope = np.zeros(part.shape)
        for at in np.ndindex(part.shape):
            old, sides = part[at], []
            for move in (1e-2, -1e-2):
                part[at] = old + move
                sides.append(loss())
            part[at] = old
            slope[at] = (sides[0] - sides[1]) / 2e-2
        slopes.append(slope)
    state = [np.zeros_like(x) for x in model.parts()]
    model.learn(before, classes, noise, 1e-6, np.random.default_rng(1), state)
    for slope, seen in zip(slopes, state):
        assert np.allclose(np.sqrt(seen), np.abs(slope), rtol=0.02, atol=2e-3)


def test_every_word_is_learned_not_its_bucket(spark):
    """Words of one bucket, beyond all frequent ones and used alike, are told apart by the words around them."""
    rng = np.random.default_rng(3)
    kinds = [[f"{kind}{i}zz" for i in range(25)] for kind in "pq"]
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 60)), True) for i in range(400)]
    rows += [(1000 + i, " ".join([f"common{i}"] * 2000), True) for i in range(lm.WORDS + 5)]
    pure = [rng.choice(kinds[i % 2], 40) for i in range(40)]
    mixed = [rng.permutation(np.concatenate([x[half], y[half]])) for x, y in zip(pure[::2], pure[1::2]) for half in (slice(20), slice(20, 40))]
    rows += [(2000 + 1000 * k + i, " ".join(x), False) for k, some in enumerate((pure, mixed)) for i, x in enumerate(some)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, teaches boolean").coalesce(1)
    got = lm.score(docs, F.col("teaches")).collect()
    assert lm.bucket_of(b"p1zz") == lm.bucket_of(b"q24zz")
    held = [[r for r in got if r["doc_id"] // 1000 == k] for k in (2, 3)]
    base, score = ([sum(r[c] for r in some) for some in held] for c in ("base_score", "score"))
    assert base[0] == pytest.approx(base[1]) and score[0] > score[1] + 0.05 * 40 * 40


def test_vectors_of_a_word_are_those_of_all_blocks(spark, documents, monkeypatch):
    """Every word of the training documents has vectors, the same in all blocks that hold it, and nothing else has."""
    monkeypatch.setattr(lm, "BLOCK_CHARS", 100_000)
    monkeypatch.setattr(lm, "CHUNK_CHARS", 50_000)
    monkeypatch.setattr(lm, "SHARD", 2_000)
    kept, train = {}, lm.train

    def watched(texts, counts, shards):
        kept.update(texts=texts, counts=counts, shards=shards, made=train(texts, counts, shards))
        return kept["made"]

    monkeypatch.setattr(lm, "train", watched)
    docs = documents.select("doc_id", "text", (fold(F.col("doc_id")) != 1).alias("teaches"))
    lm.score(docs, F.col("teaches")).collect()
    model, within, back = kept["made"]
    assert kept["shards"] > 1
    rows, found = kept["texts"].toArrow(), {}
    sent_back = {(r["block"], r["shard"]): r["vectors"] for r in back.collect()}
    assert rows.num_rows > 1
    for i in range(rows.num_rows):
        block = lm.Block.read(rows, i)
        for shard, at in lm.sent(block, kept["shards"]):
            vectors = lm.unpacked(sent_back.pop((rows.column("block")[i].as_py(), shard)))
            for word, bucket, total, v in zip(block.words[at], block.classes[at].astype(int) - 1 - lm.WORDS, block.total[at], vectors):
                assert np.array_equal(found.setdefault(int(word), (bucket, total, v))[2], v)
    assert not sent_back
    used = Counter(w for r in docs.collect() if r["teaches"] for w in words(r["text"]))
    assert len(found) == len(used) - lm.WORDS and all(np.abs(v).max() > 0 for _, _, v in found.values())

    counts = kept["counts"]
    bucket, total, vectors = (np.array(x) for x in zip(*found.values()))
    share, unseen = 10 ** counts.within(total, bucket), 10 ** counts.within(np.zeros(lm.BUCKETS), np.arange(lm.BUCKETS))
    q = model.predicted(np.random.default_rng(1).integers(0, 1 + lm.WORDS + lm.BUCKETS, (500, lm.CONTEXT)))
    for b in range(0, lm.BUCKETS, 16):
        tilts = np.exp(np.hstack([q[:, : lm.OWN], np.ones((500, 1))]) @ vectors[bucket == b][:, lm.OWN :].T)
        off = np.exp(within.log(np.full(500, b), q)) / (tilts @ share[bucket == b] + unseen[b]) - 1
        assert abs(off.mean()) < 0.02 and np.abs(off).max() < 0.3


def test_words_learn_against_the_slope():
    """A step on the vectors of words moves each against the numerical slope of the loss: true words against their bucket's others."""
    rng = np.random.default_rng(5)
    n, places = 12, 30
    words, buckets = rng.integers(0, n + 1, places), rng.integers(0, 3, places)
    own = lm.Own(rng.normal(0, 0.3, (n + 1, lm.OWN)), rng.normal(0, 0.3, (n + 1, lm.OWN + 1)))
    own.context[n], own.target[n] = 0, 0
    q, target = rng.normal(0, 1, (places, lm.WIDTH)), own.target.copy()
    groups = [[i for i in range(places) if words[i] != n and buckets[i] == b] for b in range(3)]

    def loss(theta, q):
        total, odds = 0.0, math.log(lm.OTHERS)
        for group in groups:
            for j, i in enumerate(group):
                tilt = lambda w: theta[w, : lm.OWN] @ q[i, : lm.OWN] + theta[w, lm.OWN]
                total += np.log1p(np.exp(odds - tilt(words[i])))
                total += sum(np.log1p(np.exp(tilt(words[group[(j + k) % len(group)]]) - odds)) for k in range(1, lm.OTHERS + 1))
        return total

    dq = np.zeros((places, lm.WIDTH))
    own.learn_target(q.astype(np.float32), dq, words, buckets)

    def slope(of, x):
        out = np.zeros(x.shape)
        for at in np.ndindex(x.shape):
            sides = []
            for move in (1e-4, -1e-4):
                y = x.copy()
                y[at] += move
                sides.append(of(y))
            out[at] = (sides[0] - sides[1]) / 2e-4
        return out

    want = slope(lambda t: loss(t, q), target)
    want[n] = 0
    assert np.allclose(own.target - target, -lm.OWN_RATE * want / np.sqrt(1 + want ** 2), atol=1e-4)
    assert np.allclose(dq, slope(lambda x: loss(target, x), q), atol=1e-3)
    near, distance = rng.integers(0, n + 1, (places, lm.CONTEXT)), rng.normal(0, 1, (lm.CONTEXT, lm.WIDTH))
    before, grad = own.context.copy(), np.zeros_like(own.context)
    own.learn_context(near, dq, distance)
    for i, k in np.ndindex(near.shape):
        if near[i, k] != n:
            grad[near[i, k]] += dq[i, : lm.OWN] * distance[k, : lm.OWN]
    assert np.allclose(own.context - before, -lm.OWN_RATE * grad / np.sqrt(1 + grad ** 2), atol=1e-4)


def test_stores_go_when_they_are_read_no_more(spark, tmp_path, monkeypatch):
    folder, name = tmp_path / "a b", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folder.mkdir()
    monkeypatch.setattr(support, "shared_folder", lambda spark: str(folder))
    kept, gone, empty = (support.stored(spark.range(n)) for n in (5, 6, 0))
    support.freed(gone, empty)
    assert kept.count() == 5 and len(list(folder.iterdir())) == 1
    was = spark.conf.get(name, None)
    with support.shuffles_freed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == was
