"""Near duplicates and nearest neighbours against brute force."""

import numpy as np
import pytest

from sondeo.llm import ann, neardup
from sondeo.llm.catalogue import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, id long, unit string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 5, "u") for i, v in rows], SCHEMA)


def brute_links(ids, x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= threshold
    np.fill_diagonal(linked, False)
    root = dict(zip(ids, ids))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in zip(*np.nonzero(linked)):
        a, b = find(ids[i]), find(ids[j])
        root[max(a, b)] = min(a, b)
    return {i: (int(n), find(i)) for i, n in zip(ids, linked.sum(axis=1))}


@pytest.fixture(scope="module")
def clustered():
    """Scattered vectors, pairs, a chain, and a group larger than any list, all distinct."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 32))
    near = lambda v, n, by: v + by * rng.standard_normal((n, 32))
    chain = [base[5]]
    for _ in range(6):
        chain.append(chain[-1] + 0.26 * rng.standard_normal(32) * np.linalg.norm(chain[-1]) / 32 ** 0.5)
    x = np.vstack([base, near(base[0], 150, 0.05), near(base[1], 1, 0.1), near(base[2], 3, 0.15), np.array(chain[1:])]).astype(np.float32).astype(float)
    return np.arange(len(x)) * 7 + 3, x


def test_near_duplicates_against_brute_force(spark, clustered):
    ids, x = clustered
    got = neardup.near_duplicates(frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)])).collect()
    want = brute_links(ids.tolist(), x)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(9, [1.0, 0.0]), (4, [1.0, 0.0]), (7, [2.0, -0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (8, [None, 1.0]),
            (10, [0.0, 1.0]), (10, [0.0, 1.0]), (None, [1.0, 0.0])]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame(spark, rows)).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 5, 6, 8)]
    assert got == sorted([(4, 2, 4, True), (9, 2, 4, False), (7, 2, 4, False), (10, 1, 10, True), (10, 1, 10, True), (None, 0, None, False), *alone], key=str)
    assert neardup.near_duplicates(frame(spark, [])).collect() == []


def test_audit_counts_vectors_not_links(spark):
    """A large family whose links are all held does not hide a pair that is missed."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.standard_normal(24) + 0.02 * rng.standard_normal((600, 24)), np.repeat(rng.standard_normal((10, 24)), 2, axis=0) + 0.01 * rng.standard_normal((20, 24))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "id long, unit array<double>")
    whole = [(i, 0 if i < 600 else i - i % 2) for i in range(620)]
    held = lambda rows: neardup._audit(nodes, spark.createDataFrame(rows, "node long, component long"), 0.95)
    assert held(whole) == 1.0
    assert held(whole[:-2]) == 0.9
    assert held(whole[:1] + whole[2:]) < neardup.AUDIT_RECALL      # one of the family left out


def test_short_recall_is_told(spark, monkeypatch):
    found = neardup._exact_links
    monkeypatch.setattr(neardup, "_exact_links", lambda *a: found(*a).filter("a <> 0"))
    data = frame(spark, [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.01, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.01])])
    with pytest.raises(RuntimeError, match="after 2 rounds only 0.5"):
        neardup.near_duplicates(data, rounds=2)


def brute_nearest(ids, x, q, k):
    s = x[q] @ x.T
    out = {}
    for row, i in zip(s, q):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-row[j], ids[j]))[:k]
        out[ids[i]] = [ids[j] for j in order]
    return out


def test_nearest_neighbours_recall_and_scores(spark, vectors, sf):
    rows = vectors.orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=float)
    want = brute_nearest(ids, x, [i for i, v in enumerate(ids) if v % 20 == 0], 20)
    got = {}
    for r in QUERIES["op6_cross_polytope"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == set(want)
    assert np.mean([len({r["vec_id"] for r in got[q]} & set(want[q])) / 20 for q in want]) >= 0.9
    place = {v: i for i, v in enumerate(ids)}
    for q, found in got.items():
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        assert all(abs(r["score"] - x[place[q]] @ x[place[r["vec_id"]]]) < 1e-12 for r in found)


def test_nearest_neighbours_of_unequal_lengths(spark):
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((400, 12)) * rng.uniform(0.2, 3, (400, 1))).astype(np.float32).astype(float)
    data = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    want = brute_nearest(list(range(400)), x, range(0, 400, 20), 5)
    got = {}
    for r in ann.search(data, data.filter("vec_id % 20 = 0"), k=5, tables=10, probes=16).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & set(want[q])) / 5 for q in want]) >= 0.9


def test_nearest_neighbours_of_few_and_odd_rows(spark):
    nan = float("nan")
    data = frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (20, [nan, 1.0])])
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(data, data.filter("vec_id % 20 = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 3, -1.0)]      # ties to the smaller id; all there are
    assert ann.search(frame(spark, []), frame(spark, [])).collect() == []
