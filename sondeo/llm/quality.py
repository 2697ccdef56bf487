"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages. Each passage is encoded; a gated attention, learned from labels of whole
documents, weighs the passages; the weighted representation gives the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.support import Shipped, code_points, map_texts, mix, segment_sums, stored, taught, thinned, worker_cache

PASSAGE_CHARS = 800
SHAPE_BUCKETS = 96
STATISTICS = 12


def shape_tables() -> tuple[np.ndarray, np.ndarray]:
    """Character class of each code point of the basic plane (32 classes), and a bucket for each class trigram."""
    cache = worker_cache()
    if "shapes" not in cache:
        kind = np.zeros(0x10000, dtype=np.int32)
        for c in range(0x10000):
            if 0xD800 <= c < 0xE000:
                continue
            x = chr(c)
            kind[c] = 1 if x.islower() else 2 if x.isupper() else 3 if x.isdigit() else 4 if x == "\n" else 5 if x.isspace() else 6 if x.isalpha() else 7
        for i, x in enumerate("""!"#$%&'()*+,-./:;<=>?@[]_|~"""[:24]):
            kind[ord(x)] = 8 + i
        buckets = (mix(np.arange(32 ** 3, dtype=np.uint64) + np.uint64(77)) % np.uint64(SHAPE_BUCKETS)).astype(np.int32)
        cache["shapes"] = kind, buckets
    return cache["shapes"]


def encode_passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """One row of features per passage of about 800 characters, cut anywhere but never dropped; where each
    text's passages begin. A null or empty text is one passage of zeros.

    Features: rates of classes and of repeated words, and a hashed histogram of character-class trigrams.
    """
    kinds, buckets = shape_tables()
    points, starts = code_points([x or "" for x in texts])
    lengths = np.diff(starts)
    counts = np.maximum(1, -(-lengths // PASSAGE_CHARS))
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(counts, out=first[1:])
    total = int(first[-1])
    out = np.zeros((total, STATISTICS + SHAPE_BUCKETS), dtype=np.float32)
    if not len(points):
        return out, first
    owner = np.repeat(np.arange(len(texts)), lengths)
    passage = first[owner] + (np.arange(len(points)) - starts[owner]) // PASSAGE_CHARS
    kind = kinds[np.minimum(points, 0xFFFF)]
    kind[points > 0xFFFF] = 6
    edges = np.searchsorted(passage, np.arange(total + 1))
    chars = np.maximum(1, np.diff(edges)).astype(np.float32)
    for i, k in enumerate((1, 2, 3, 4, 5)):
        out[:, i] = segment_sums((kind == k).astype(np.int32), edges) / chars
    out[:, 5] = segment_sums((kind >= 7).astype(np.int32), edges) / chars
    if len(points) > 2:
        tri = buckets[kind[:-2] * 1024 + kind[1:-1] * 32 + kind[2:]]
        inside = passage[:-2] == passage[2:]
        histogram = np.bincount(passage[:-2][inside] * SHAPE_BUCKETS + tri[inside], minlength=total * SHAPE_BUCKETS)
        out[:, STATISTICS:] = np.sqrt(histogram.reshape(total, SHAPE_BUCKETS) / chars[:, None])
    # words: a word belongs to the passage of its first character
    solid = (kind != 4) & (kind != 5)
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | (owner[1:] != owner[:-1])
    at = np.flatnonzero(opens)
    if len(at):
        place = np.arange(len(points)) - np.maximum.accumulate(np.where(opens, np.arange(len(points)), 0))
        value = np.where(solid, mix(points.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(24))), np.uint64(0))
        words = np.add.reduceat(value, at)
        home = passage[at]
        w_edges = np.searchsorted(home, np.arange(total + 1))
        n = np.maximum(1, np.diff(w_edges)).astype(np.float32)
        for i, lag in enumerate((1, 2, 3)):
            same = np.zeros(len(words), dtype=np.int32)
            if len(words) > lag:
                same[lag:] = (words[lag:] == words[:-lag]) & (home[lag:] == home[:-lag])
            out[:, 6 + i] = segment_sums(same, w_edges) / n
        order = np.lexsort((words, home))
        again = np.zeros(len(words), dtype=np.int32)
        again[1:] = (words[order][1:] == words[order][:-1]) & (home[order][1:] == home[order][:-1])
        out[:, 9] = segment_sums(again, w_edges) / n
        out[:, 10] = np.minimum(1.0, np.diff(edges) / n / 20)
    out[:, 11] = np.minimum(1.0, np.log1p(np.diff(edges)) / 8)
    return out, first


@dataclass(frozen=True)
class AttentionModel:
    """Scale of the features, encoder W, gate V and U, attention w, and the last layer c."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict]:
        p = self.weights
        h = np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ p["W"] + p["bW"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), np.diff(first)))
        a = e / np.repeat(np.add.reduceat(e, first[:-1]), np.diff(first))
        z = np.add.reduceat(h * a[:, None], first[:-1], axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return score, {"h": h, "t": t, "s": s, "a": a, "z": z}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, first = encode_passages(texts)
        return self.forward(x, first)[0].astype(np.float64)


def fit(x: np.ndarray, first: np.ndarray, labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, rate: float = 0.01,
        batch: int = 256, seed: int = 7) -> AttentionModel:
    """Adam on the cross entropy of bags, both classes weighing alike. Without both classes the score is their share."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = {"W": rng.normal(0, d ** -0.5, (d, hidden)), "bW": np.zeros(hidden), "V": rng.normal(0, hidden ** -0.5, (hidden, gate)),
         "U": rng.normal(0, hidden ** -0.5, (hidden, gate)), "w": rng.normal(0, 0.1, gate), "c": rng.normal(0, 0.1, hidden), "b": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    model = AttentionModel(mean, scale, p)
    share = labels.mean() if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        p["c"] *= 0
        p["b"] += np.log((share * len(labels) + 1) / ((1 - share) * len(labels) + 1))
        return model
    cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), batch):
            bags = np.sort(order[lo : lo + batch])
            sizes = first[bags + 1] - first[bags]
            at = np.zeros(len(bags) + 1, dtype=np.int64)
            np.cumsum(sizes, out=at[1:])
            rows = np.arange(at[-1]) - np.repeat(at[:-1], sizes) + np.repeat(first[bags], sizes)
            score, k = model.forward(x[rows], at)
            g = ((score - labels[bags]) * cost[bags] / len(bags)).astype(np.float32)
            dz = np.repeat(g[:, None] * p["c"], sizes, axis=0)
            da = (dz * k["h"]).sum(axis=1)
            de = k["a"] * (da - np.repeat(np.add.reduceat(da * k["a"], at[:-1]), sizes))
            dt, ds = de[:, None] * p["w"] * k["s"] * (1 - k["t"] ** 2), de[:, None] * p["w"] * k["t"] * k["s"] * (1 - k["s"])
            dh = (dz * k["a"][:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - k["h"] ** 2)
            scaled = ((x[rows] - mean) / scale).clip(-8, 8)
            grad = {"W": scaled.T @ dh, "bW": dh.sum(axis=0), "V": k["h"].T @ dt, "U": k["h"].T @ ds,
                    "w": (k["t"] * k["s"]).T @ de, "c": k["z"].T @ g, "b": g.sum(keepdims=True)}
            step += 1
            for name, v in p.items():
                m, q = moments[name]
                full = grad[name] + 1e-4 * v * (name != "b")
                m += 0.1 * (full - m)
                q += 0.001 * (full ** 2 - q)
                v -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.999 ** step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          docs_per_class: int = 2500, most_passages: int = 256, passages: int = 200_000) -> AttentionModel:
    """A model from rows of ``docs`` whose key has a non-null 0/1 label (several labels of a key: the smallest).

    The driver gets a bounded table whatever the corpus: about ``docs_per_class`` labelled keys of each class, chosen by
    a hash of the key, one text for each; of a text, at most ``most_passages`` passages evenly spaced over all of it; and about
    ``passages`` in all, beyond which the hash leaves out further keys. A null text counts as empty.
    """
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("int").alias("_label"))
    chosen = stored(taught(docs, thinned(marks, F.col("_key"), docs_per_class, "_label"), key, text))
    held = F.least(F.lit(most_passages), F.ceil(F.length("_text") / PASSAGE_CHARS) + 1)
    share = F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit("passages")), F.lit(1_000_003)) / 1_000_003.0
    total = chosen.agg(F.sum(held).alias("n")).first()["n"] or 1

    def encode(texts):
        x, first = encode_passages(texts)
        bags = [np.arange(a, b) if b - a <= most_passages else a + np.arange(most_passages) * (b - a) // most_passages for a, b in zip(first[:-1], first[1:])]
        return {"x": pa.array([x[at].tobytes() for at in bags], pa.binary())}

    rows = map_texts(chosen.filter(share < passages / total), encode, "x binary", ["_key", "_label"], "_text").collect()
    rows.sort(key=lambda r: (r["_key"], r["x"]))
    width = STATISTICS + SHAPE_BUCKETS
    bags = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, width) for r in rows]
    first = np.zeros(len(bags) + 1, dtype=np.int64)
    np.cumsum([len(b) for b in bags], out=first[1:])
    return fit(np.vstack(bags) if bags else np.zeros((1, width), np.float32), first, np.array([r["_label"] for r in rows], dtype=np.float32))


def score(docs: DataFrame, model: AttentionModel, key: str = "doc_id", text: str = "text", keep: list[str] | None = None,
          threshold: float = 0.3) -> DataFrame:
    """Columns ``keep`` (default: the key), ``score`` (0 to 1) and ``predicted`` (1 where the score reaches ``threshold``).

    Null and empty texts are scored as one empty passage.
    """
    shipped = Shipped(docs.sparkSession, model)   # a few thousand numbers

    def run(texts):
        scores = shipped.value.score(texts)
        return {"score": pa.array(scores, pa.float64()), "predicted": pa.array((scores >= threshold).astype(np.int32), pa.int32())}

    return map_texts(docs, run, "score double, predicted int", keep or [key], text)
