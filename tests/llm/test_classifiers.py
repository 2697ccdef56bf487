"""Language, quality and toxicity: held-out accuracy, and defined results for odd input."""

import numpy as np
import pytest

from sondeo.llm import langid, quality, toxicity
from sondeo.llm.catalogue import QUERIES, trained_on

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op2_language_id"](spark, SF).join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(documents, odd, none):
    filters = langid.learn(trained_on(documents))
    rows = langid.identify(odd, filters).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 3, 9))
    assert all(by[i]["lang_pred"] in filters.languages for i in (4, 5, 8, 13))
    assert langid.identify(none, filters).collect() == []
    empty = langid.learn(none)
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}


def test_language_filters_correct_for_false_positives(documents):
    filters = langid.learn(documents, bits=1 << 12)             # crowded: most positions are taken
    assert filters.rates.min() > 0.01
    texts = [r["text"] for r in documents.limit(100).collect()]
    langs = [r["lang"] for r in documents.limit(100).collect()]
    assert np.mean([a == b for a, b in zip(filters.predict(texts)[0], langs)]) >= 0.95


def test_batches_do_not_change_a_prediction(documents):
    filters = langid.learn(documents)
    texts = [r["text"] for r in documents.limit(40).collect()] + [None, "", "é"]
    together = filters.predict(texts)
    alone = [filters.predict([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and np.allclose(together[1], [a[1][0] for a in alone])
    model = quality.fit(*quality.encode_passages(texts), np.arange(len(texts)) % 2)
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts], atol=1e-5)


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op5_quality"](spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.93
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_quality_attention_finds_the_bad_passage():
    good, bad = "the quick brown fox jumps over a lazy dog near the old river bank. ", "BUY!!! $$$ NOW!!! *** "
    rng = np.random.default_rng(0)
    texts = [good * int(rng.integers(20, 60)) + (bad * 40 if i % 2 else "") + good * int(rng.integers(20, 60)) for i in range(80)]
    labels = np.array([1 - i % 2 for i in range(80)], dtype=np.float32)
    x, first = quality.encode_passages(texts)
    model = quality.fit(x, first, labels)
    score, inner = model.forward(x, first)
    assert ((score > 0.5) == (labels == 1)).all()
    assert np.allclose(np.add.reduceat(inner["a"], first[:-1]), 1, atol=1e-4)


def test_quality_of_odd_rows(documents, labels, odd, none):
    model = quality.learn(trained_on(documents), labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({round(r["score"], 6) for r in rows if r["doc_id"] in (0, 1)}) == 1
    assert quality.score(none, model).collect() == []
    untaught = quality.learn(none, labels)
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, untaught).collect())


def test_every_character_belongs_to_a_passage():
    texts = ["", "a", "b" * 799, "c" * 800, "d" * 801, "e" * 5000]
    x, first = quality.encode_passages(texts)
    assert np.diff(first).tolist() == [1, 1, 1, 1, 2, 7] and np.isfinite(x).all()


@pytest.fixture(scope="module")
def chain(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return toxicity.learn(trained_on(docs), labels)


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F_label("toxic"))
    found = toxicity.score(docs, toxicity.learn(trained_on(docs), labels.withColumnRenamed("is_toxic", "toxic")))
    held = docs.select("doc_id").exceptAll(trained_on(docs).select("doc_id"))
    rows = found.join(held, "doc_id").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r["is_toxic"]]
    clean = [r for r in rows if not r["is_toxic"]]
    assert np.mean([r["toxic"] for r in toxic]) >= 0.75 and np.mean([r["toxic"] for r in clean]) <= 0.03


def F_label(name):
    from pyspark.sql import functions as F

    return F.col(name).alias(f"is_{name}")


def test_toxicity_chain_passes_probabilities_on(chain):
    assert chain.earlier.shape == (3, 3) and np.allclose(chain.earlier, np.tril(chain.earlier, -1)) and chain.earlier[2, :2].any()
    p = chain.predict(["you idiot clown moron pathetic stupid", "the and of in to", None, ""])
    assert p[0, 2] > 0.5 > p[1, 2] and ((0 <= p) & (p <= 1)).all()
    assert np.allclose(p[2], p[3])


def test_toxicity_of_odd_rows(chain, labels, odd, none):
    assert toxicity.score(odd, chain).count() == odd.count()
    assert toxicity.score(none, chain).collect() == []
    untaught = toxicity.learn(none, labels)
    assert not any(r["toxic"] for r in toxicity.score(odd, untaught).collect())
