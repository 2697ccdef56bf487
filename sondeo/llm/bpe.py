"""Byte-pair encoding and decoding with the vocabulary of a public tokenizer.

Forced-boundary splitting: two neighbouring bytes that no vocabulary token holds side by side can never be
merged over, so a text may be cut between them; each fragment is encoded by itself (once for all its
occurrences in a worker), and the ids are put together again.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.support import Shipped, map_texts, worker_cache

NO_MERGE = 1 << 60
SHIFT = 20
#: Pieces of text that a worker remembers with their ids: two generations of at most this many each, and of about so many
#: bytes. The older one lasts no longer than the task.
REMEMBERED, REMEMBERED_BYTES = 250_000, 16 << 20
#: What a remembered piece takes beside its characters and ids.
PIECE_BYTES = 200
LONGEST_REMEMBERED = 40
#: Fragments beyond this many bytes are merged one by one with a heap.
LONG_PIECE = 300
#: White space to Python, not to the vocabularies.
ODD = "\x1c\x1d\x1e\x1f"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Vocabulary:
    """Merges, ids and byte strings of a ``tokenizers`` JSON file holding a byte-level BPE model.

    ``file`` must be readable where the object is made (the driver); tasks get the object itself.
    """

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as source:
            description = json.load(source)
        model = description["model"]
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        characters = byte_characters()
        self.suffix = suffix
        self.first = np.array([vocabulary[c] for c in characters], dtype=np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in characters], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in description["added_tokens"]}
        self.ranks: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault(vocabulary[a] << SHIFT | vocabulary[b], rank << SHIFT | vocabulary[a + b])
        self._hash_table()
        place = {c: b for b, c in enumerate(characters)}
        self.tokens: list[bytes] = [b""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for token, number in vocabulary.items():
            plain = token.removesuffix(suffix) if suffix else token
            self.tokens[number] = bytes(place[c] for c in plain) if all(c in place for c in plain) else token.encode()
        together = np.zeros(1 << 16, dtype=bool)
        for token in self.tokens:
            if len(token) > 1:
                together[[a << 8 | b for a, b in zip(token, token[1:])]] = True
        self.together = together          # does some token hold the two bytes side by side?
        for token, number in self.special.items():
            self.tokens[number] = token.encode()
        self.special_pattern = "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and result of merging each pair of ids, in one number; ``NO_MERGE`` where there is none."""
        code = a << SHIFT | b
        out = np.full(len(code), NO_MERGE, dtype=np.int64)
        at, slot = np.arange(len(code)), self._slot(code)
        while len(at):
            key = self.keys[slot]
            hit = key == code[at]
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (key >= 0)
            at, slot = at[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int64)

    def _hash_table(self) -> None:
        self.keys, self.values = np.full(1 << 18, -1, dtype=np.int64), np.zeros(1 << 18, dtype=np.int64)
        codes, values = (np.fromiter(x, dtype=np.int64, count=len(self.ranks)) for x in (self.ranks.keys(), self.ranks.values()))
        for code, value, slot in zip(codes.tolist(), values.tolist(), self._slot(codes).tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (len(self.keys) - 1)
            self.keys[slot], self.values[slot] = code, value

    def merge_segments(self, ids: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apply the merges within each run of equal ``segment`` (ascending), all runs at once.

        Every round merges one pair in each run: the earliest learned, the leftmost among equals.
        Returns ids and segments; runs that are done leave the working arrays.
        """
        done: list[tuple[np.ndarray, np.ndarray]] = []
        code = np.full(len(ids), NO_MERGE, dtype=np.int64)
        inside = np.flatnonzero(segment[1:] == segment[:-1])
        code[inside] = self.lookup(ids[inside], ids[inside + 1])
        while len(ids):
            starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            sizes = np.diff(np.append(starts, len(ids)))
            best = np.minimum.reduceat(code, starts)
            live = best != NO_MERGE
            if live.mean() < 0.7:
                stay = np.repeat(live, sizes)
                done.append((ids[~stay], segment[~stay]))
                ids, segment, code = ids[stay], segment[stay], code[stay]
                continue
            at = np.flatnonzero((code == np.repeat(best, sizes)) & (code != NO_MERGE))
            at = at[np.append(True, segment[at[1:]] != segment[at[:-1]])]
            made = code[at] & ((1 << SHIFT) - 1)
            ids[at] = made
            code[at] = NO_MERGE
            right = at + 2 < len(ids)
            right[right] = segment[at[right] + 2] == segment[at[right]]
            code[at[right]] = self.lookup(made[right], ids[at[right] + 2])
            left = at > 0
            left[left] = segment[at[left] - 1] == segment[at[left]]
            code[at[left] - 1] = self.lookup(ids[at[left] - 1], made[left])
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, segment, code = ids[keep], segment[keep], code[keep]
        if not done:
            return ids, segment
        ids, segment = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(segment, kind="stable")
        return ids[order], segment[order]

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same for one run, with a heap and linked places: its time hardly exceeds its length."""
        get, n = self.ranks.get, len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(code, i) for i in range(n - 1) if (code := get(ids[i] << SHIFT | ids[i + 1], NO_MERGE)) != NO_MERGE]
        heapq.heapify(heap)
        while heap:
            code, i = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or get(ids[i] << SHIFT | ids[j], NO_MERGE) != code:
                continue
            ids[i], alive[j] = code & ((1 << SHIFT) - 1), False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (found := get(ids[left] << SHIFT | ids[right], NO_MERGE)) != NO_MERGE:
                    heapq.heappush(heap, (found, left))
        return [x for x, keep in zip(ids, alive) if keep]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, in 32 bits each, little-endian.

        Pieces are cut wherever two bytes meet that no token holds side by side. The fragments are
        encoded independently, all at once, and their ids put together again. (Where the last
        character of a word has ids of its own, the cut stays right: its tokens are tokens too.)
        """
        lengths = np.array([len(x) for x in pieces], dtype=np.int64)
        if not len(lengths):
            return []
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(pieces)), lengths)
        ends = np.cumsum(lengths)
        ids = self.first[raw]
        ids[ends[lengths > 0] - 1] = self.last[raw[ends[lengths > 0] - 1]]
        cut = np.zeros(len(raw), dtype=bool)
        cut[1:] = (owner[1:] != owner[:-1]) | ~self.together[raw[:-1] << 8 | raw[1:]]
        fragment = np.cumsum(cut)
        begin = np.flatnonzero(np.append(True, cut[1:]))[: len(raw)]
        sizes = np.diff(np.append(begin, len(raw)))
        long = (sizes > LONG_PIECE)[fragment]
        numbers, part = self.merge_segments(ids[~long], fragment[~long])
        if long.any():
            extra = [(self.merge_long(ids[begin[f] : begin[f] + sizes[f]].tolist()), f) for f in np.flatnonzero(sizes > LONG_PIECE)]
            numbers = np.concatenate([numbers, *(np.array(x, dtype=np.int64) for x, _ in extra)])
            part = np.concatenate([part, *(np.full(len(x), f) for x, f in extra)])
            order = np.argsort(part, kind="stable")
            numbers, part = numbers[order], part[order]
        whose = owner[begin][part]
        flat = numbers.astype("<u4").tobytes()
        bounds = (np.searchsorted(whose, np.arange(len(pieces) + 1)) * 4).tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``, special tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


class Encoder:
    """Texts to ids, as the library does without adding special tokens. Subclasses say how a text falls into pieces.

    Pieces met before are looked up; all new ones of a list of texts are encoded together.
    """

    PIECES: str
    PLAIN: re.Pattern

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.special_ids = {x: y.to_bytes(4, "little") for x, y in vocabulary.special.items()}
        self.pieces = regex.compile(self.PIECES).findall
        self.special = re.compile(vocabulary.special_pattern).split if vocabulary.special else None
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def forget(self) -> None:
        """Keep the newer generation only."""
        self.old = {}

    def normal(self, text: str) -> str:
        return text

    def chunks(self, text: str) -> list[str]:
        """``text`` (without special tokens) cut at places where pieces end. A chunk that ``LATIN`` matches is one piece;
        where letters or signs are others, all up to the next white space is one chunk."""
        return self.pieces(text) if any(x in text for x in ODD) else self.PLAIN.findall(text)

    def split(self, text: str) -> list[str]:
        """The chunks of a text, strings of special tokens among them."""
        special = self.vocabulary.special
        if special and any(token in text for token in special):
            return [y for x in self.special(text) for y in ([x] if x in special else self.chunks(self.normal(x)))]
        return self.chunks(self.normal(text))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian in 32 bits each."""
        split = [self.split(x) for x in texts]
        fresh = set().union(*split).difference(self.new)
        local = {x: self.old[x] for x in fresh & self.old.keys()}
        missing = fresh.difference(local)
        coded = {x: self.special_ids[x] for x in missing & self.special_ids.keys()}
        parts = {x: self.pieces(x) for x in missing if not x.isascii() and not LATIN(x) and x not in coded}
        pieces = missing.difference(parts, coded).union(*parts.values())
        for held in (self.new, local):       # a piece is a chunk, too
            coded.update((x, held[x]) for x in pieces & held.keys())
        pieces = list(pieces.difference(coded))
        coded.update(zip(pieces, self.vocabulary.encode_pieces([x.encode() for x in pieces])))
        coded.update([(x, b"".join(map(coded.__getitem__, part))) for x, part in parts.items()])
        local.update(coded)
        more = PIECE_BYTES * len(local) + sum(map(len, local)) + sum(map(len, local.values()))
        if len(self.new) + len(local) > REMEMBERED or self.size + more > REMEMBERED_BYTES:
            self.old, self.new, self.size = self.new, {}, 0
        self.size += more
        known = {**self.old, **local} if not self.new else self.new
        known.update(local)
        out = [b"".join(map(known.__getitem__, x)) for x in split]
        if known is not self.new:
            self.new.update(local)
        for x in [x for x in local if len(x) > LONGEST_REMEMBERED]:
            self.new.pop(x, None)
        return out


#: Latin letters beyond ASCII that every version of Unicode has; ASCII signs and controls that are no white space; what must
#: not follow a run that is to end where it does; contractions.
MORE, SIGNS, SHORT = "À-ÖØ-öø-ſ", r"[!-/:-@\[-`{-~\x00-\x08\x0e-\x1b\x7f]", r"'(?:s|t|re|ve|m|ll|d)"
WHOLE = rf"(?![^\x00-\x7f{MORE}])"
LATIN = re.compile(rf"[\x00-\x7f{MORE}]*").fullmatch


class ByteEncoder(Encoder):
    """Pieces of a byte-level vocabulary: a word with the blank before it, a number, a run of signs, white space."""

    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
    PLAIN = re.compile(rf" ?[A-Za-z{MORE}]++{WHOLE}|{SHORT}| ?[0-9]++{WHOLE}| ?{SIGNS}++{WHOLE}| ?\S+|\s+(?!\S)|\s+")


class WordEncoder(Encoder):
    """Pieces of a vocabulary with marked word ends: lower-cased words, digits, runs of signs; white space is dropped."""

    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
    PLAIN = re.compile(rf"[a-z{MORE}]++{WHOLE}|{SHORT}|[0-9]|{SIGNS}++{WHOLE}|\S+")

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()    # character by character: no final sigma


def worker_encoder(kind: type, shipped, name: str):
    """The worker's own encoder over a broadcast vocabulary; what it remembers outlives the task."""
    cache = worker_cache()
    key = (kind.__name__, name)
    if key not in cache:
        cache[key] = kind(shipped.value)
    return cache[key]


def round_trip(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every text, decode the ids again, and return what became of both.

    Columns: the key, ``n_tokens``, ``ids_sha256`` (of ids as little-endian unsigned 32-bit numbers),
    ``decoded_sha256`` (of the decoded text in UTF-8), and with ``keep_ids`` the array ``ids``. Equal to
    the library's ``encode(text, add_special_tokens=False)`` and ``decode(ids, skip_special_tokens=False)``;
    strings of special tokens in a text become those tokens. A null text counts as empty; repeated rows
    give repeated rows.
    """
    shipped = Shipped(docs.sparkSession, Vocabulary(file))      # as large as the vocabulary

    def run(texts):
        encoder = worker_encoder(ByteEncoder, shipped, file)
        sizes, of_ids, of_text, kept = [], [], [], []
        for ids in encoder.encode_all([x or "" for x in texts]):
            numbers = np.frombuffer(ids, dtype="<u4")
            sizes.append(len(numbers))
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_text.append(hashlib.sha256(encoder.vocabulary.decode(numbers).encode()).hexdigest())
            if keep_ids:
                kept.append(numbers.astype(np.int32))
        made = {"n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}
        return made | ({"ids": pa.array(kept, pa.list_(pa.int32()))} if keep_ids else {})

    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else ""), [key], text)
