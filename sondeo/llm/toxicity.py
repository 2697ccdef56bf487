"""Toxicity by a classifier chain: categories are predicted one after another, each linear model seeing the
probabilities of those before it. Later models are trained on out-of-fold predictions of the earlier ones."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.support import Shipped, fold, map_texts, stored, taught, thinned

# Words that make a toxic training document an example of a category. The last category of the
# chain is the label itself, whatever its language and words.
CATEGORY_WORDS = {
    "insult": ("idiot", "moron", "loser", "clown", "scum", "trash"),
    "contempt": ("stupid", "worthless", "pathetic", "disgusting"),
}
CATEGORIES = (*CATEGORY_WORDS, "toxic")
FOLDS = 5
STEMS = (4, 6)
WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str | None) -> set[str]:
    """Distinct lower-cased words of a text, and their beginnings of 4 and of 6 letters (marked by a star)."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


@dataclass(frozen=True)
class Chain:
    """A vocabulary with rows of weights, and for each category its weights, those of earlier categories, and a bias."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """A row per text: the probability of each category."""
        known = self.vocabulary.keys()
        sums = np.zeros((len(texts), len(CATEGORIES)))
        for i, x in enumerate(texts):
            if hits := features_of(x) & known:
                sums[i] = self.weights[[self.vocabulary[f] for f in hits]].sum(axis=0)
        out = np.zeros_like(sums)
        for c in range(len(CATEGORIES)):
            out[:, c] = _sigmoid(sums[:, c] + out[:, :c] @ self.earlier[c, :c] + self.bias[c])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, penalty: float = 2e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Regularised logistic regression on sparse 0/1 features (rows, cols) and dense ``extra``, by Adam, both classes alike."""
    w, e, b = np.zeros(width), np.zeros(extra.shape[1]), 0.0
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return w, e, float(np.log(share / (1 - share)))
    cost = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    state = [np.zeros(width + extra.shape[1] + 1) for _ in range(2)]
    for t in range(1, steps + 1):
        score = np.bincount(rows, weights=w[cols], minlength=len(y)) + extra @ e + b
        g = (_sigmoid(score) - y) * cost / len(y)
        grad = np.concatenate([np.bincount(cols, weights=g[rows], minlength=width) + penalty * w, extra.T @ g + penalty * e, [g.sum()]])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad ** 2
        move = 0.1 * (state[0] / (1 - 0.9 ** t)) / (np.sqrt(state[1] / (1 - 0.999 ** t)) + 1e-8)
        w, e, b = w - move[:width], e - move[width:-1], b - float(move[-1])
    return w, e, b


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          docs_per_class: int = 6000, vocabulary: int = 6000, min_docs: int = 5) -> Chain:
    """A chain from the rows of ``docs`` whose key has a non-null 0/1 label (several labels of a key: the largest).

    Read are about ``docs_per_class`` labelled keys of each class, chosen by a hash of the key, one whole text for each. Tasks count features; the ``vocabulary`` features that
    differ most between the classes (smoothed log odds, in units of its deviation) of those in at least
    ``min_docs`` documents are kept, so the driver's tables stay bounded. Folds are by the key's hash.
    """
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_label"))
    chosen = stored(taught(docs, thinned(marks, F.col("_key"), docs_per_class, "_label"), key, text).withColumn("_fold", fold(F.col("_key"))))

    def count(batches):
        seen: Counter = Counter()
        bad: Counter = Counter()
        n = np.zeros(2, dtype=np.int64)
        for batch in batches:
            for y, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = features_of(x)
                n[y] += 1
                (bad if y else seen).update(found)
        names = list(set(seen) | set(bad))
        for lo in range(0, len(names), 50_000):
            part = names[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[x] for x in part], pa.int64()), pa.array([bad[x] for x in part], pa.int64())], names=["f", "clean", "toxic"])
        yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), pa.array(n[:1]), pa.array(n[1:])], names=["f", "clean", "toxic"])

    counted = chosen.select("_label", "_text").mapInArrow(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counted.filter("f = ''").first()
    a, b = (total["clean"], total["toxic"]) if total else (0, 0)
    if not a or not b:
        return Chain({}, np.zeros((0, len(CATEGORIES))), np.zeros((len(CATEGORIES),) * 2), np.full(len(CATEGORIES), 3.0 if b else -3.0))
    odds = F.log((F.col("toxic") + 0.5) / (b - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (a - F.col("clean") + 0.5))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = counted.filter((F.col("f") != "") & (F.col("clean") + F.col("toxic") >= min_docs)).orderBy(F.desc(F.abs(odds / spread)), "f").limit(vocabulary).select("f").toArrow()
    places = {f: i for i, f in enumerate(best.column(0).to_pylist())}
    shipped = Shipped(docs.sparkSession, places)      # at most ``vocabulary`` words

    def encode(texts):
        known = shipped.value
        found = [features_of(x) for x in texts]
        hits = [np.array(sorted(known[f] for f in x & known.keys()), dtype=np.int32) for x in found]
        marks = [[bool(x & set(words)) for x in found] for words in CATEGORY_WORDS.values()]
        return {"hits": pa.array([h.tobytes() for h in hits], pa.binary())} | {f"is_{c}": pa.array(m, pa.bool_()) for c, m in zip(CATEGORY_WORDS, marks)}

    shape = "hits binary, " + ", ".join(f"is_{c} boolean" for c in CATEGORY_WORDS)
    rows = sorted(map_texts(chosen, encode, shape, ["_key", "_label", "_fold"], "_text").collect(), key=lambda r: (str(r["_key"]), r["hits"]))
    return _fit([np.frombuffer(r["hits"], dtype=np.int32) for r in rows], np.array([[r["_label"] and r[f"is_{c}"] for c in CATEGORY_WORDS] + [r["_label"]] for r in rows], dtype=float), np.array([r["_fold"] for r in rows]), places)


def _fit(hits: list[np.ndarray], y: np.ndarray, folds: np.ndarray, places: dict[str, int]) -> Chain:
    n, width = len(CATEGORIES), len(places)
    rows, cols = np.repeat(np.arange(len(hits)), [len(h) for h in hits]), np.concatenate(hits)
    weights, earlier, bias = np.zeros((width, n)), np.zeros((n, n)), np.zeros(n)
    out_of_fold = np.zeros((len(hits), n))
    for c in range(n):
        seen = out_of_fold[:, :c]
        w, e, b = _logistic(rows, cols, seen, y[:, c], width)
        weights[:, c], earlier[c, :c], bias[c] = w, e, b
        for f in range(FOLDS) if c < n - 1 else ():
            train, test = folds != f, folds == f
            at = np.cumsum(train) - 1
            inside = train[rows]
            w, e, b = _logistic(at[rows[inside]], cols[inside], seen[train], y[train, c], width)
            score = np.bincount(rows, weights=w[cols], minlength=len(hits)) + seen @ e + b
            out_of_fold[test, c] = _sigmoid(score)[test]
    return Chain(places, weights, earlier, bias)


def score(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: the key, a probability for each earlier category, ``score`` (the probability of
    ``toxic``) and ``toxic`` (does the score reach ``threshold``?). A text that is null or has no word has no feature."""
    shipped = Shipped(docs.sparkSession, chain)       # bounded by its vocabulary

    def run(texts):
        p = shipped.value.predict(texts)
        return {f"p_{c}": pa.array(p[:, i]) for i, c in enumerate(CATEGORY_WORDS)} | {"score": pa.array(p[:, -1]), "toxic": pa.array(p[:, -1] >= threshold)}

    return map_texts(docs, run, ", ".join(f"p_{c} double" for c in CATEGORY_WORDS) + ", score double, toxic boolean", [key], text)
