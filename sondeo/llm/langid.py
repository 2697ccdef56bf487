"""Language identification by n-gram filters whose every position holds a bit for each language.

An n-gram is hashed to a few positions of one table; the AND of the words found there has a bit for each
language that contains the n-gram (a Bloom filter for every language, sliced by bit, read at once).
A text belongs to the language with the largest popcount after false positives are taken off.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondeo.llm.support import Shipped, code_points, map_texts, mix, segment_sums, thinned, tidy, worker_cache

UNKNOWN = "und"
ORDERS = (2, 3, 4)
SURE = 6


@dataclass(frozen=True)
class LanguageFilters:
    """``words``: a 64-bit word of languages for each position; ``rates``: false positives by language."""

    languages: tuple[str, ...]
    words: np.ndarray
    rates: np.ndarray
    hashes: int

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its share of the corrected popcounts.

        A text that is null or has no letter is ``und`` with score 0; so is every text when no language
        was learned. Where no n-gram is known, and in ties, the most frequent language of training wins.
        """
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """What :meth:`predict` gives, and whether any language has more known n-grams than false positives explain:
        more than ``SURE`` standard deviations above the number expected of them."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        hits = np.zeros((len(self.languages), len(texts)))
        grams = np.zeros(len(texts))
        letters, starts, rows = letter_runs(texts)
        mask_bits = np.uint64(len(self.words) - 1)
        for n in ORDERS:
            codes, at = ngrams(letters, starts, n)
            grams += np.diff(at)
            found = self.words[(codes & mask_bits).astype(np.int64)]
            for k in range(1, self.hashes):
                found = found & self.words[((codes >> np.uint64(20 * k)) & mask_bits).astype(np.int64)]
            for i in range(len(self.languages)):
                hits[i] += segment_sums(((found >> found.dtype.type(i)) & found.dtype.type(1)).astype(np.int32), at)
        false = grams * self.rates[:, None]
        corrected = np.maximum(0.0, (hits - false) / (1 - self.rates[:, None]))
        best = np.argmax(corrected, axis=0)
        total = corrected.sum(axis=0)
        score = np.where(total > 0, corrected[best, np.arange(len(texts))] / np.where(total > 0, total, 1), 1 / len(self.languages))
        known = rows > 0
        shown = (hits > false + SURE * np.sqrt(false)).any(axis=0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0), known & shown


def letter_table() -> np.ndarray:
    """For each code point of the basic plane: is it a letter?"""
    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x10000)])
    return cache["letters"]


def letter_runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters of each text with a 0 between words and at both ends; starts; letters by text.

    Beyond the basic plane every code point counts as a letter when Python says so.
    """
    points, starts = code_points([f" {x.lower()} " if x else " " for x in texts])
    low = np.minimum(points, 0xFFFF)
    is_letter = letter_table()[low]
    for i in np.flatnonzero(points > 0xFFFF):
        is_letter[i] = chr(points[i]).isalpha()
    keep = is_letter.copy()
    keep[0:1] = True
    keep[1:] |= is_letter[:-1]          # the first gap after a word stays, as a 0
    keep[starts[:-1]] = True
    kept = np.zeros(len(keep) + 1, dtype=np.int64)
    np.cumsum(keep, out=kept[1:])
    return np.where(is_letter, points, 0)[keep].astype(np.uint64), kept[starts], segment_sums(is_letter.astype(np.int32), starts)


def ngrams(letters: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within words (a word's ends count as one gap each), and where each text's begin."""
    if len(letters) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(starts), dtype=np.int64)
    size = len(letters) - n + 1
    whole = np.ones(size, dtype=bool)
    for k in range(1, n - 1):
        whole &= letters[k : k + size] != 0
    if n == 2:
        whole &= (letters[:size] != 0) & (letters[1:] != 0)
    code = letters[:size].copy()
    for k in range(1, n):
        code = code * np.uint64(1_000_003) + letters[k : k + size]
    kept = np.zeros(size + 1, dtype=np.int64)
    np.cumsum(whole, out=kept[1:])
    # a window over two texts would hold two gaps in a row, one of them inside, and is dropped above
    at = kept[np.minimum(starts, size)]
    return mix(code[whole] + np.uint64(n)), at


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int = 3000,
          min_docs: int = 3, share: float = 0.25, bits: int = 1 << 20, hashes: int = 3, grams_per_language: int = 30_000) -> LanguageFilters:
    """Filters from the labelled rows of ``docs``; rows with null text or language teach nothing.

    At most about ``docs_per_language`` documents of each language are read (a hash of ``key`` chooses
    them). A language contains an n-gram that at least ``min_docs`` of its documents have, with a
    relative frequency of at least ``share`` of the greatest among all languages; the
    ``grams_per_language`` most frequent are kept, so the table stays small. Up to 64 languages.
    """
    labelled = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    sample = thinned(labelled, F.col("_key"), docs_per_language, "_lang")

    def grams_of(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for one in sorted(set(langs)):
                mine = [t for t, x in zip(texts, langs) if x == one]
                letters, starts, _ = letter_runs(mine)
                for n in ORDERS:
                    codes, at = ngrams(letters, starts, n)
                    doc = np.repeat(np.arange(len(mine)), np.diff(at))
                    order = np.lexsort((doc, codes))
                    codes, doc = codes[order], doc[order]
                    first = np.ones(len(codes), dtype=bool)
                    first[1:] = codes[1:] != codes[:-1]
                    fresh = first.copy()
                    fresh[1:] |= doc[1:] != doc[:-1]
                    begin = np.flatnonzero(first)
                    if len(begin):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([one] * len(begin)), pa.array(np.full(len(begin), n, dtype=np.int32)), pa.array(codes[begin].view(np.int64)),
                             pa.array(np.diff(np.append(begin, len(codes)))), pa.array(np.add.reduceat(fresh.astype(np.int64), begin))],
                            names=["lang", "n", "gram", "uses", "docs"])

    counted = (
        sample.select("_lang", "_text").mapInArrow(tidy(grams_of), "lang string, n int, gram long, uses long, docs long")
        .groupBy("lang", "n", "gram").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))
    )
    totals = counted.groupBy("lang", "n").agg(F.sum("uses").alias("total"))
    rated = counted.join(F.broadcast(totals), ["lang", "n"]).withColumn("rate", F.col("uses") / F.col("total"))
    most = rated.groupBy("gram").agg(F.max("rate").alias("most"))
    member = rated.filter(F.col("docs") >= min_docs).join(most, "gram").filter(F.col("rate") >= share * F.col("most"))
    sizes = sample.groupBy("_lang").count().collect()
    languages = tuple(r["_lang"] for r in sorted(sizes, key=lambda r: (-r["count"], r["_lang"])))
    if len(languages) > 64:
        raise ValueError(f"{len(languages)} languages; a word holds 64")

    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "gram"))
    kept = member.withColumn("place", place).filter(F.col("place") <= grams_per_language).select("lang", "gram").toArrow()      # bounded
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    words = np.zeros(bits, dtype=kind)
    codes, langs = kept.column("gram").to_numpy().view(np.uint64), np.array(kept.column("lang").to_pylist(), dtype=object)
    for i, language in enumerate(languages):
        mine = codes[langs == language]
        for k in range(hashes):
            words[((mine >> np.uint64(20 * k)) & np.uint64(bits - 1)).astype(np.int64)] |= kind(1 << i)
    rates = np.array([(((words >> kind(i)) & kind(1)).mean()) ** hashes for i in range(len(languages))])
    return LanguageFilters(languages, words, rates, hashes)


def identify(docs: DataFrame, filters: LanguageFilters, key: str = "doc_id", text: str = "text", keep: list[str] | None = None,
             shown: str | None = None) -> DataFrame:
    """Columns ``keep`` (default: the key), ``lang_pred`` and ``score`` for every row; see :meth:`LanguageFilters.predict`.

    With ``shown``, a boolean of that name besides: do n-grams speak for a learned language? See :meth:`LanguageFilters.judge`.
    """
    shipped = Shipped(docs.sparkSession, filters)   # one table of fixed size

    def predict(texts):
        langs, scores, evident = shipped.value.judge(texts)
        made = {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
        return made | {shown: pa.array(evident, pa.bool_())} if shown else made

    return map_texts(docs, predict, "lang_pred string, score double" + (f", {shown} boolean" if shown else ""), keep or [key], text)
