"""Encoding, decoding and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sondeo.llm import bpe, packing
from sondeo.llm.catalogue import QUERIES
from tests.llm.conftest import ODD_TEXTS

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
AWKWARD = ["  ", "a \n b", "x\n\ny", " a ", "<|endoftext|>hi <|endoftext|>", "<|startoftext|> Hello <|endoftext|>!?", "ab" * 4000, "ΣΑΣ İstanbul \x1c q\x1fz \x85",
           "🎉🎉 👩‍👩‍👧", "it's we'll I'd DON'T 'S", "é é ﬁ", " x　y \xa0 z", "a\r\nb\r\n", "!!! ... --- ??"]


def random_texts(n):
    rnd = random.Random(3)
    letters = list(" \n\tabcABCéü'sllΣσ1239.,!?\x1c\x85 日🎉-_")
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("file, kind", [(BYTES, bpe.ByteEncoder), (WORDS, bpe.WordEncoder)])
def test_ids_equal_the_library(file, kind):
    library, vocabulary = Tokenizer.from_file(file), bpe.Vocabulary(file)
    texts = [x or "" for x in ODD_TEXTS] + AWKWARD + random_texts(1500)
    for x, ids in zip(texts, kind(vocabulary).encode_all(texts)):
        want = library.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want, x[:60]
        if kind is bpe.ByteEncoder:
            assert vocabulary.decode(np.array(want, dtype=np.int64)) == library.decode(want, skip_special_tokens=False)


def test_the_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    library, encoder = Tokenizer.from_file(BYTES), bpe.ByteEncoder(bpe.Vocabulary(BYTES))
    texts = random_texts(60)
    for x in texts + texts:
        assert np.frombuffer(encoder.encode_all([x])[0], dtype="<u4").tolist() == library.encode(x, add_special_tokens=False).ids
    assert len(encoder.old) < 200


def test_the_memory_of_pieces_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 50_000)
    library, encoder = Tokenizer.from_file(BYTES), bpe.ByteEncoder(bpe.Vocabulary(BYTES))
    for x in random_texts(600):
        assert np.frombuffer(encoder.encode_all([x])[0], dtype="<u4").tolist() == library.encode(x, add_special_tokens=False).ids
        assert all(sum(bpe.PIECE_BYTES + len(k) + len(v) for k, v in part.items()) <= 60_000 for part in (encoder.old, encoder.new))
    encoder.forget()
    assert not encoder.old and encoder.new


def test_cuts_are_forced_only_where_no_token_spans():
    v = bpe.Vocabulary(BYTES)
    inside = {(a, b) for i, t in enumerate(v.tokens) if i not in v.special.values() for a, b in zip(t, t[1:])}
    assert inside == {(i >> 8, i & 255) for i in np.flatnonzero(v.together).tolist()} and not v.together.all()


def test_bytes_that_are_no_text_decode_as_the_library_does():
    library, v = Tokenizer.from_file(BYTES), bpe.Vocabulary(BYTES)
    rng = np.random.default_rng(1)
    for _ in range(200):
        ids = rng.integers(0, 256, 12).tolist() + [50256]
        assert v.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_round_trip_query(spark, sf, documents):
    library = Tokenizer.from_file(BYTES)
    got = {r["doc_id"]: r for r in QUERIES["op3_bpe_round_trip"](spark, sf).collect()}
    for r in documents.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        mine = got[r["doc_id"]]
        assert mine["n_tokens"] == len(ids) and mine["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_of_odd_rows(odd, none):
    rows = bpe.round_trip(odd, BYTES, keep_ids=True).collect()
    assert len(rows) == odd.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1)} == {0}
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)
    assert bpe.round_trip(none, BYTES).collect() == []


def check_packing(rows, texts, capacity=4096):
    library = Tokenizer.from_file(WORDS)
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        documents.setdefault(r["doc_id"], []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    for key, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted(documents[key], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"]) for r in pieces] == [(i, i * capacity) for i in range(-(-len(ids) // capacity))]
        for r in pieces:
            part = ids[r["start"] : r["start"] + capacity]
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    return len(sequences), -(-sum(r["length"] for r in rows) // capacity)


def test_packing_query(spark, sf, documents):
    rows = QUERIES["op10_best_fit_packing"](spark, sf).collect()
    used, least = check_packing(rows, {r["doc_id"]: r["text"] for r in documents.collect()})
    assert used <= least + 1


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), WORDS).collect()
    check_packing(rows, dict(enumerate(ODD_TEXTS)))
    assert packing.pack(odd, WORDS).count() == len(rows) + 2                    # repeated rows and null keys are packed too
    assert packing.pack(none, WORDS).collect() == []


def least_bins(lengths, capacity):
    """A bound no packing beats: pieces that cannot share a sequence, and what the others need beyond their gaps."""
    best = -(-int(lengths.sum()) // capacity)
    for a in range(capacity // 2 + 1):
        alone, large = lengths[lengths > capacity - a], lengths[(lengths <= capacity - a) & (lengths > capacity / 2)]
        small = lengths[(lengths >= a) & (lengths <= capacity / 2)]
        over = int(small.sum()) - (len(large) * capacity - int(large.sum()))
        best = max(best, len(alone) + len(large) + max(0, -(-over // capacity)))
    return best


def test_plans_use_exact_complements():
    counts = np.zeros(101, dtype=np.int64)
    counts[[60, 40]] = 5, 5                     # pairs
    counts[[50, 30, 20]] += (3, 3, 3)           # triples
    assert sum(n for n, _ in packing.plan(counts, 100)) == 8
    rng = np.random.default_rng(2)
    for _ in range(20):
        counts = np.bincount(rng.integers(1, 101, 300), minlength=101)
        patterns = packing.plan(counts, 100)
        used = np.zeros(101, dtype=np.int64)
        for times, lengths in patterns:
            assert sum(lengths) <= 100
            np.add.at(used, list(lengths), times)
        assert (used == counts).all()
        assert sum(n for n, _ in patterns) <= 1.02 * least_bins(np.repeat(np.arange(101), counts), 100)


@pytest.mark.parametrize("file", [BYTES, WORDS])
def test_long_pieces_are_cut_where_cuts_are_forced(file, monkeypatch):
    """Only fragments without a forced cut meet the heap, and the ids are those of the piece merged as a whole."""
    v, whole, seen = bpe.Vocabulary(file), bpe.Vocabulary.merge_long, []
    monkeypatch.setattr(bpe.Vocabulary, "merge_long", lambda self, ids: seen.append(len(ids)) or whole(self, ids))
    rnd = random.Random(9)
    signs = "ABCXYZabcxyz0189+/日本語テキスト"
    pieces = ["".join(rnd.choice(signs) for _ in range(3000)).encode(), b"ab", ("a" * 700 + "日q" * 40 + "b" * 800).encode(), b""]
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in v.encode_pieces(pieces)]
    sizes = []
    for p, ids in zip(pieces, got):
        raw = np.frombuffer(p, dtype=np.uint8).astype(np.int64)
        first = v.first[raw]
        first[-1:] = v.last[raw[-1:]]
        assert ids == whole(v, first.tolist())
        cuts = np.flatnonzero(~v.together[raw[:-1] << 8 | raw[1:]]) + 1
        sizes += np.diff([0, *cuts, len(raw)]).tolist()
    assert sorted(seen) == sorted(n for n in sizes if n > bpe.LONG_PIECE) and max(seen, default=0) < 3000


def test_common_lengths_are_numbered_in_slices(spark, monkeypatch):
    """Few pieces a slice: every length falls into many of them, and places still have neither gaps nor overlaps."""
    monkeypatch.setattr(packing, "SLICE_ROWS", 7)
    texts = ["one two three"] * 200 + ["word " * n for n in range(60)] + [None] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "first long, text string")
    rows = packing.pack(docs, WORDS, key="first", capacity=40).collect()
    assert {r["first"] for r in rows} == set(range(len(texts)))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 40
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 40) + 2


@pytest.mark.parametrize("file, kind", [(BYTES, bpe.ByteEncoder), (WORDS, bpe.WordEncoder)])
def test_a_special_token_in_other_letters_is_plain_text(file, kind):
    library, encoder = Tokenizer.from_file(file), kind(bpe.Vocabulary(file))
    for x in ["a <|STARTOFTEXT|> b", "<|ENDOFTEXT|>", "x <|EndOfText|>y", "x\n<|endoftext|>\n<|ENDOFTEXT|>"]:
        assert np.frombuffer(encoder.encode_all([x])[0], dtype="<u4").tolist() == library.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("file, kind", [(BYTES, bpe.ByteEncoder), (WORDS, bpe.WordEncoder)])
def test_words_are_cut_from_their_signs_and_encoded_once(file, kind):
    texts = ["so word, (word) word. été! été;", "x\xa0word \xa0 a’b, don’t 'll’s word×2 no\u0301 ﬁ1 ſ' ß's"]
    encoder = kind(bpe.Vocabulary(file))
    assert [x.strip() for x in encoder.chunks(texts[0])] == ["so", "word", ",", "(", "word", ")", "word", ".", "été", "!", "été", ";"]
    for x in texts + [x or "" for x in ODD_TEXTS] + AWKWARD:
        chunks = encoder.chunks(encoder.normal(x))
        assert [y for c in chunks for y in encoder.pieces(c)] == encoder.pieces(encoder.normal(x))
        assert all(encoder.pieces(c) == [c] for c in chunks if bpe.LATIN(c))
    library = Tokenizer.from_file(file)
    for x, ids in zip(texts, encoder.encode_all(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(x, add_special_tokens=False).ids
