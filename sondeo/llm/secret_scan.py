"""Secret scans: keywords by Aho-Corasick, regular expressions anchored at the hits, then embedded checksums.

Offsets are code points of the text, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from sondeo.llm.support import map_texts, worker_cache

#: Kinds in the order that breaks ties of spans; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "card")

# What the kinds look like. A match that fails its test is dropped after it has taken its place.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
NPM = re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
CARD = re.compile(r"(?:card|visa|mastercard)[ :=#]{1,3}((?:[0-9][ -]?){12,18}[0-9])(?![0-9])", re.IGNORECASE | re.ASCII)
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "card": "card", "visa": "card", "mastercard": "card",
}
LEAST_HEX = 32
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """CRC-32 of ``body`` in six base-62 digits, as GitHub and npm append it to their tokens."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


def luhn(number: str) -> bool:
    """Does the last digit of a card number check the others?"""
    digits = [int(x) for x in number if x.isdigit()]
    return len(digits) >= 13 and any(digits) and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _automaton():
    cache = worker_cache()
    if "keywords" not in cache:
        machine = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            machine.add_word(word, (len(word), kind))
        machine.make_automaton()
        cache["keywords"] = machine
    return cache["keywords"]


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start, then by the order of ``KINDS``.

    Base kinds are taken leftmost and without overlap within a kind, tests afterwards: ``assign`` needs a
    value of 8 characters, ``access`` 16 characters, ``hex`` 32. Added kinds count only where their
    checksum is right: GitHub and npm tokens (CRC-32 in base 62), card numbers (Luhn).
    """
    raw = text.encode("utf-8", "surrogatepass").lower()      # ASCII only: lengths stay
    plain = len(raw) == len(text)
    hits = [(end - n + 1, kind) for end, (n, kind) in _automaton().iter(raw.decode("latin-1"))]
    if not plain and hits:
        hits.sort()
        shifted, seen, count = [], 0, 0
        for at, kind in hits:                                # byte offsets to code points, left to right
            count += sum((b & 0xC0) != 0x80 for b in raw[seen:at]) if at - seen < 64 else len(raw[seen:at].decode("utf-8", "surrogatepass"))
            seen = at
            shifted.append((count, kind))
        hits = shifted
    found: list[tuple[int, int, str]] = []
    past = dict.fromkeys(KINDS, 0)
    for at, kind in sorted(hits):
        if at < past[kind]:
            continue
        if kind == "assign" and (m := ASSIGN.match(text, at)):
            past[kind] = m.end()
            if len(m[2]) >= 8:
                found.append((at, m.end(), kind))
        elif kind == "access" and (m := ACCESS.match(text, at)):
            past[kind] = m.end()
            if m.end() - at >= 16:
                found.append((at, m.end(), kind))
        elif kind in ("github", "npm") and (m := (GITHUB if kind == "github" else NPM).match(text, at)):
            past[kind] = m.end()
            body = m[0].partition("_")[2]
            if checksum62(body[:30]) == body[30:]:
                found.append((at, m.end(), kind))
        elif kind == "card" and (m := CARD.match(text, at)):
            past[kind] = m.end()
            if luhn(m[1]):
                found.append((m.start(1), m.end(1), kind))
    # a run of 32 hex characters covers a multiple of 32: only those places can lie in one
    step, last = LEAST_HEX, 0
    for at in [i * step for i, c in enumerate(text[::step]) if c in "0123456789abcdef"]:
        if at < last:
            continue
        end = HEX.match(text, at).end()
        start = at
        while start > last and text[start - 1] in "0123456789abcdef":
            start -= 1
        last = end
        if end - start >= LEAST_HEX:
            found.append((start, end, "hex"))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda x: (x[0], order[x[2]], x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, counts of the base kinds, ``base_sha256`` of the base spans and
    ``spans`` with all of them. A null text counts as empty."""
    base = KINDS[:3]

    def run(texts):
        all_spans = [find_secrets(x or "") for x in texts]
        made = {f"n_{k}": pa.array([sum(s[2] == k for s in spans) for spans in all_spans], pa.int64()) for k in base}
        kept = [joined([s for s in spans if s[2] in base]) for spans in all_spans]
        return made | {"base_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept]), "spans": pa.array([joined(x) for x in all_spans], pa.string())}

    return map_texts(docs, run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", [key], text)


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Overlapping spans united, under the kind that comes first."""
    out: list[tuple[int, int, str]] = []
    for start, end, kind in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), out[-1][2])
        else:
            out.append((start, end, kind))
    return out


def redact(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and the text with every secret replaced by ``[kind]``; a null text stays null. ``keep`` may hold
    columns of any name but the text's."""
    made = "clean"
    while made in keep:
        made += "_"

    def run(texts):
        cleaned = []
        for x in texts:
            spans = merged(find_secrets(x)) if x else []
            if spans:
                ends = [0, *(s[1] for s in spans)]
                x = "".join(f"{x[a:start]}[{kind}]" for a, (start, _, kind) in zip(ends, spans)) + x[ends[-1] :]
            cleaned.append(x)
        return {made: pa.array(cleaned, pa.string())}

    return map_texts(docs, run, f"{made} string", keep, text).withColumnRenamed(made, text)
