"""The Merkle manifest against plain Python and against its SQL."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sondeo.llm import merkle
from sondeo.llm.catalogue import QUERIES, SQL
from tests.agreement import compare, connect

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(x):
    return sha256(x.encode()).hexdigest()


def leaf(row, lower=False):
    values = [row[f] for f in FIELDS]
    if lower and values[-1] is not None:
        values[-1] = "".join(c.lower() if "A" <= c <= "Z" else c for c in values[-1])
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    for nodes in levels[:-1]:
        low = at - at % 16
        yield "".join(nodes[low:at]), "".join(nodes[at + 1 : low + 16])
        at //= 16


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of each row, by the contract."""
    sources = {}
    for r in rows:
        bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        sources.setdefault(r["source"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)), r["doc_id"], leaf(r, bad)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[0][2] for x in sorted(sources[s], key=lambda x: x[0])]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for at, (order, key, other) in enumerate(sorted(sources[s], key=lambda x: x[0])):
            path = [*siblings(trees[s], at), *siblings(top, i)]
            end = other
            for a, b in path:
                end = h(a + end + b)
            out.append((key, order[2], trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in path)), end, end == top[-1][0]))
    return out


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def found(docs, **more):
    return merkle.manifest(docs, tampered=merkle.tampered_rows(), changed={"text": merkle.lowered(F.col("text"))}, **more)


def test_query_agrees_with_sql_and_plain_python(spark, sf, documents):
    problem, n = compare(spark, connect(sf), QUERIES["op11_merkle_manifest"], SQL["op11_merkle_manifest"], sf)
    assert problem is None and n == documents.count()
    got = QUERIES["op11_merkle_manifest"](spark, sf).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute([r.asDict() for r in documents.collect()]), key=key)
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows_and_many_superblocks(spark, monkeypatch, seed):
    # superblocks of 16 make trees of several superblocks, of exactly one, and of a lone leaf
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "SPAN", 16)
    texts = [None, "", "ABC", "Äb\x00C", "x" * 50_000]
    rows = [(i, ("hot", "hot", "b", None)[i % 4], "en" if i % 3 else None, i if i % 2 else None, texts[i * seed % 5]) for i in range(700)]
    rows += [(3, "hot", "en", 3, "ABC"), (3, "hot", "en", 3, "ABC"), (3, "hot", "en", 3, "other"), (None, "hot", None, None, "Q"), (None, None, None, None, None)]
    rows += [(5000, "lone", "en", 1, "AbC"), (5001, "", "en", 1, "z")] + [(6000 + i, "sixteen", "en", 1, "T") for i in range(16)] + [(7000 + i, f"s{i}", None, 1, "t") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(1) for c in ("tree", "pos", "node", "size", "leaf", "block", "key")})
    got = found(docs, keep_path=True).collect()
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(brute([r.asDict() for r in docs.collect()]), key=key)
    assert all((merkle.folded(r["leaf"], r["path"]) == r["root"]) for r in got)


def test_no_rows_and_one_row(spark):
    shape = "doc_id long, source string, lang string, n_chars long, text string"
    assert found(spark.createDataFrame([], shape)).collect() == []
    rows = [(1, "a", None, 2, "T")]
    got = found(spark.createDataFrame(rows, shape)).collect()
    assert [tuple(r) for r in got] == brute([dict(zip(FIELDS, rows[0]))]) and got[0]["root"] == got[0]["leaf"] and got[0]["proof_sha256"] == h("")
