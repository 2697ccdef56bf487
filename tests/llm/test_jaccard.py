"""The Jaccard join and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from sondeo.llm import jaccard, support
from sondeo.llm.catalogue import QUERIES
from sondeo.llm.components import components
from tests.llm.conftest import ODD_TEXTS

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    sets, root = {}, {}
    for key, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
        sets[key] = {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        root[key] = key

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_against_brute_force(spark, sf, documents):
    want = brute([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert got(QUERIES["op8_jaccard_join"](spark, sf)) == want
    assert any(c != k for k, (_, c) in want.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_families_of_copies_against_brute_force(spark, seed):
    """Families around the threshold, one of them larger than a group, and a passage that all share."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(30)]
    rows = []
    for family in range(25):
        text = [rnd.choice(words) for _ in range(rnd.randint(3, 120))] + (passage if family % 3 else [])
        for _ in range(150 if family == 0 else rnd.randint(1, 8)):
            copy = list(text)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((rnd.randrange(10 ** 6) * 1000 + len(rows), " ".join(copy)))
    assert got(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_exactly_at_the_threshold(spark):
    """8 shared of 10 shingles link, 7 of 9 do not."""
    words = [f"v{i}" for i in range(40)]
    rows = [(5, " ".join(words[:13])), (3, " ".join(["p", *words[1:12], "q"])), (11, " ".join(words[20:32])), (12, " ".join(words[20:33] + ["z"]))]
    assert got(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_rows(spark, odd, none):
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    want = brute(list(enumerate(ODD_TEXTS)))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert want[7] == (2, 6) and want[0] == (0, 0) and want[1] == (0, 1)
    assert jaccard.jaccard_components(none).collect() == []


def test_bounds_never_reject_a_link():
    for n in range(1, 400):
        assert n - jaccard.prefix_length(n) + 1 == -(-80 * n // 100)


def test_components_of_hubs_and_chains(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    links = spark.createDataFrame([*chain, *hub, (1000, 1000), (7, 6), (None, 3), (2001, 2001)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(200)}, 2001: 2001}
    assert components(links.limit(0)).collect() == []


def test_a_bitmap_tells_row_numbers_of_many_partitions_apart(spark):
    keys = np.array([0, 1, -1, 42, 2**63 - 1, -(2**63), 7 << 33 | 5], dtype=np.int64)
    df = spark.createDataFrame(pa.table({"k": keys}))
    assert [r[0] for r in df.select(F.xxhash64("k")).collect()] == support.xxhash64_of_longs(keys).tolist()
    rows = (np.arange(100, dtype=np.int64)[:, None] << 33 | np.arange(2_000)).ravel()
    some = rows[::50]
    marked = support.in_bitmap(support.bitmap(spark.createDataFrame(pa.table({"k": some})), "k"), rows)
    assert marked[::50].all() and marked.sum() < 1.1 * len(some)
    assert not support.in_bitmap(support.bitmap(df.filter("false"), "k"), rows).any()
