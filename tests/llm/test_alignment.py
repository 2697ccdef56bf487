"""Cross-tokenizer alignment against plain Python with both libraries."""

import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sondeo.llm import alignment
from sondeo.llm.bpe import Vocabulary, byte_characters
from sondeo.llm.catalogue import QUERIES
from tests.llm.conftest import ODD_TEXTS

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = ["<|endoftext|> a <s> b </s>", "▁a▁b", "<0x0A> \n x", "日本 " * 300, "� x", "á é ﬁ", " lead", "tail ", "a" * 3000, "\x00"]


def groups_of(text, library, model):
    """Groups of (ids of A, ids of B), or None where there are no tokens."""
    if not text:
        return None
    place = {c: b for b, c in enumerate(byte_characters())}
    e = library.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(place[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
    b = [(i, bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()) for i in model.encode(text)]
    raw = (" " + text).encode()
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return None
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in cuts]
    for side in (0, 1):
        for (i, _), end in zip((a, b)[side], ends[side]):
            out[bisect.bisect_left(cuts, end)][side].append(i)
    return out


def brute(rows):
    library, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    groups = [(k, groups_of(t, library, model)) for k, t in rows]
    uses, top = Counter(), defaultdict(int)
    for _, g in groups:
        uses.update({(i, j) for xs, ys in g or () for i in xs for j in ys})
    for (i, _), n in uses.items():
        top[i] = max(top[i], n)
    for k, g in groups:
        if g is None:
            yield k, 0, 0, 0, 0, 0, 0, ""
            continue
        links = [(i, j) for xs, ys in g for i in xs for j in ys]
        line = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        yield (k, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(uses[x] == top[x[0]] for x in links), sum(uses[x] for x in links),
               hashlib.sha256(line.encode()).hexdigest())


def same(got, rows):
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted((tuple(r)[:8] for r in got), key=order) == sorted(brute(rows), key=order)


def test_query(spark, sf, documents):
    same(QUERIES["op12_token_alignment"](spark, sf).collect(), [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_odd_texts_small_blocks_and_large_groups(spark, odd, none, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(alignment, "LINKS", 6)
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(AWKWARD)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more).withColumns({c: F.lit(1) for c in ("block", "key", "pair", "docs", "n_a", "groups")})
    got = alignment.align(docs, A, B, keep_groups=True).collect()
    same(got, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got if r["groups_sha256"])
    assert len(ODD_TEXTS) + 2 + len(AWKWARD) == len(got)
    assert alignment.align(none, A, B).collect() == []
    nulls = alignment.align(odd.withColumn("text", F.lit(None).cast("string")), A, B).collect()
    assert {tuple(r)[1:] for r in nulls} == {(0, 0, 0, 0, 0, 0, "")}


def test_covering_tokens_give_all_overlaps():
    rng = np.random.default_rng(5)
    for _ in range(50):
        cuts = [np.unique(np.append(rng.integers(1, 60, 15), 60)) for _ in range(2)]
        sizes = tuple(np.diff(np.append(0, c)) for c in cuts)
        left, right, at = alignment.covering(sizes, tuple(np.zeros(len(s), dtype=np.int64) for s in sizes))
        spans = [list(zip(a.tolist(), (a + s).tolist())) for a, s in zip(at, sizes)]
        want = [i * len(spans[1]) + j for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
        assert alignment.overlaps(left, right).tolist() == want
        groups = alignment.grouped(left, right, at)
        common = np.intersect1d(*cuts)
        assert all(np.array_equal(g, np.searchsorted(common, c)) for g, c in zip(groups, cuts))


def test_a_special_token_on_a_line_of_its_own_is_plain_text():
    library, encoder = Tokenizer.from_file(A), alignment.PlainEncoder(Vocabulary(A))
    library.encode_special_tokens = True
    text = "x\n<|endoftext|>\ny"
    assert np.frombuffer(encoder.encode_all([text])[0], dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_entries_are_joined_text_by_text():
    table = pa.array([b"a", b"", b"bc"], pa.large_binary())
    assert alignment.joined(table, np.array([0, 2, 1, 2, 2]), np.array([2, 2, 3, 5])) == [b"abc", b"", b"", b"bcbc"]
    assert alignment.joined(table, np.array([1, 1]), np.array([1, 2])) == [b"", b""]
    assert alignment.joined(table, np.zeros(0, dtype=np.int64), np.array([0, 0])) == [b"", b""] and alignment.joined(table, np.zeros(0, dtype=np.int64), np.zeros(0)) == []
