"""Text predicates and normalisers as column expressions (no UDF, all in codegen)."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sondeo.functions import vocabulary as V


def as_text(c: Column) -> Column:
    return c.cast("string")


def is_placeholder(c: Column, zero: bool = False) -> Column:
    """Null, or a stand-in for "no data". A bare ``0`` counts only with ``zero=True``."""
    words = [w for w in V.PLACEHOLDERS if zero or w != "0"]
    return c.isNull() | F.lower(F.trim(as_text(c))).isin(words)


def clean_category(c: Column, zero: bool = False) -> Column:
    """Trimmed label, NULL when it is a placeholder (a ``0`` only with ``zero=True``)."""
    trimmed = F.trim(as_text(c))
    return F.when(~is_placeholder(trimmed, zero), trimmed)


@cache
def fold_table() -> tuple[str, str, dict[str, str], str]:
    """What Unicode's compatibility decomposition, marks left out, makes of characters beyond ASCII, where letters or digits of
    ASCII come of it: those that become one character (and, in the same order, which), those that become several, and those
    (beside marks) that are nothing but a mark."""
    singles, several, marks = {}, {}, []
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x20000)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if not plain and not unicodedata.category(chr(code)).startswith("M"):
            marks.append(chr(code))
        if plain != chr(code) and any("a" <= x <= "z" or "0" <= x <= "9" for x in plain):
            (singles if len(plain) == 1 else several)[chr(code)] = plain
    return "".join(singles), "".join(singles.values()), several, "".join(marks)


def _beyond_ascii(chars: str, more: str = "") -> str:
    """A regex class of ``chars``, as ranges, and ``more``: the test for ASCII comes first, so that common letters cost one look."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    listed = "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in spans)
    return rf"[\x{{80}}-\x{{10FFFF}}&&[{more}{listed}]]"


def fold_accents(c: Column) -> Column:
    """Lower case without accents, whether they are part of a letter or follow it; ligatures and other compatibility
    characters (wide, superscript, circled) become the letters and digits they stand for."""
    letters, plain, several, marks = fold_table()
    lower = F.lower(c)
    text = F.translate(F.regexp_replace(lower, rf"{_beyond_ascii(marks, chr(92) + 'p{M}')}+", ""), letters, plain)
    spread = _beyond_ascii("".join(several))
    known = F.split(F.lit("\n".join(several.values())), "\n")      # constants of the plan
    # Cut before the characters that become several: what lies between two of them stays as it is.
    first = lambda x: F.get(known, F.instr(F.lit("".join(several)), F.left(x, F.lit(1))) - 1)
    spelt = F.array_join(F.transform(
        F.split(text, f"(?={spread})"), lambda x: F.when(x.rlike(f"^{spread}"), F.concat(first(x), F.substring(x, 2, 2**31 - 1))).otherwise(x)), "")
    # Texts of ASCII alone have nothing to fold.
    return F.when(F.length(lower) == F.octet_length(lower), lower).when(text.rlike(spread), spelt).otherwise(text)


def semantic_text(c: Column) -> Column:
    """Comparison key: lower case, unaccented, words separated by single spaces."""
    words = F.regexp_replace(fold_accents(as_text(c)), r"[^a-z0-9]+", " ")
    return F.coalesce(F.trim(words), F.lit(""))


def compact_key(c: Column) -> Column:
    """Comparison key without separators, upper case."""
    return F.upper(F.coalesce(F.regexp_replace(fold_accents(as_text(c)), r"[^a-z0-9]+", ""), F.lit("")))


def repair_mojibake(c: Column) -> Column:
    """Undo known encoding damage. Opt-in: some entries also occur in healthy text."""
    fixed = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), V.MOJIBAKE.items(), c)
    return F.trim(F.regexp_replace(fixed, r"\s+", " "))


def clean_text(c: Column, repair: bool = False) -> Column:
    """One line, single-spaced; null words and NULL become the empty string."""
    # A blank that stands alone stays: prose is full of them.
    text = F.regexp_replace(as_text(c), r"_x000d_|[\t\n\x0B\f\r]\s*| \s+", " ")
    text = F.trim(F.regexp_replace(repair_mojibake(text) if repair else text, r" {2,}", " "))
    return F.coalesce(F.regexp_replace(text, f"(?i)^(?:{'|'.join(V.NULL_WORDS)})$", ""), F.lit(""))


# Two letters or digits somewhere, and more than a filler word between trimmed marks.
READABLE = (
    rf"(?isU)^(?![ _\-./]*(?:{'|'.join(V.NOISE_WORDS)})[ _\-./]*$)"
    r"(?=[^\p{L}\p{N}]*[\p{L}\p{N}][^\p{L}\p{N}]*[\p{L}\p{N}])"
)


def is_noise(c: Column) -> Column:
    """Nothing to read: empty, at most one letter or digit, or a filler word."""
    return ~is_readable(clean_text(c))


def is_readable(text: Column) -> Column:
    """Something to read in a text that is clean already."""
    return text.rlike(READABLE)


def is_sentence(c: Column) -> Column:
    """Eight words or more, or 55 characters or more."""
    return reads_as_sentence(clean_text(c))


def reads_as_sentence(text: Column) -> Column:
    """``is_sentence`` of a text that is clean already; a long one is not taken apart."""
    return (text != "") & ((F.length(text) >= 55) | (F.size(F.split(text, " ")) >= 8))


def is_time_label(c: Column) -> Column:
    """Month names, week / quarter / period words, a 20xx year or a d/m date."""
    short = "|".join(w for w in V.TIME_LABELS if len(w) <= 3)
    long = "|".join(w for w in V.TIME_LABELS if len(w) > 3)
    key = semantic_text(c)
    return (
        key.rlike(rf"\b(?:{short})\b|{long}|\b20\d{{2}}\b")
        | as_text(c).rlike(r"\b\d{1,2}[/-]\d{1,2}([/-]\d{2,4})?\b")
    )


def contains_any(c: Column, words) -> Column:
    quoted = "|".join(rf"\Q{w}\E" for w in words)
    return F.coalesce(F.lower(as_text(c)).rlike(quoted), F.lit(False))
