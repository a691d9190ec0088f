"""Language identification with language-bitmask n-gram filters.

Each language keeps a Bloom filter of the byte n-grams that are usual in it. The filters are bit-sliced: one table of
masks per hash function, with bit ``k`` of a slot set if language ``k``'s filter has that slot, so one lookup per hash
function and an AND return all languages that contain an n-gram. A mask is as wide as the languages need: one word of up
to 64 bits, or several. A text's n-grams are counted by language (popcounts of the masks' bits); each count is corrected
for the false positives that the filter's fill makes expected, and the largest decides.

Which n-grams are usual is learned from a bounded sample of labelled rows, ``sample_per_language`` of each language,
taken in the order of a hash of text: equal texts cannot crowd out others, as only one of them is taken. The filters are
made as large as the n-grams of that sample need.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, cut, unused

N = 5
#: Slots of each filter for an n-gram of the language that has most, at least, and slots of the smallest filter.
SLOTS_PER_GRAM = 4
LEAST_BITS, MOST_BITS = 16, 32
HASHES = 2
_PIECE = 1 << 18
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_ODD = 0x9E3779B97F4A7C15
#: ASCII letters stay (as lower case), all other ASCII bytes become a space; bytes of longer characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded(text: str) -> bytes:
    """Lower-case words of a text as UTF-8, parted and surrounded by single spaces."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" "


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each run of ``N`` bytes."""
    n = data.size - N + 1
    if n < 1:
        return np.empty(0, np.uint64)
    packed = np.zeros(n, np.uint64)
    for k in range(N):
        packed = (packed << np.uint64(8)) | data[k : k + n]
    packed *= np.uint64(_ODD)
    packed = (packed ^ (packed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return packed ^ (packed >> np.uint64(32))


def _slots(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The slot by hash function ``k``: its own bits of the hash, so that functions are independent."""
    return ((h >> np.uint64(64 - bits * (k + 1))) & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class Filters:
    """Bit-sliced filters: ``tables[k][slot]`` is a mask of languages, a row of words; ``false_rate[i]`` is that of
    language ``i``; a filter has two to the power of ``bits`` slots."""

    languages: list[str]
    tables: list[np.ndarray] = field(default_factory=list)
    false_rate: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bits: int = LEAST_BITS

    def masks(self, h: np.ndarray) -> np.ndarray:
        out = self.tables[0][_slots(h, 0, self.bits)]
        for k in range(1, HASHES):
            out = out & self.tables[k][_slots(h, k, self.bits)]
        return out

    def shares(self, text: str) -> np.ndarray:
        """By language, the corrected share of a text's n-grams that its filter contains."""
        data = np.frombuffer(folded(text), np.uint8)
        size = max(data.size - N + 1, 0)
        counts = np.zeros(len(self.languages))
        width = 8 * self.tables[0].itemsize
        for at in range(0, size, _PIECE):  # a very long text is counted piece by piece
            masks = self.masks(gram_hashes(data[at : at + _PIECE + N - 1]))
            for i in range(len(self.languages)):
                counts[i] += np.count_nonzero(masks[:, i // width] & masks.dtype.type(1 << i % width))
        corrected = (counts - size * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9)
        return np.clip(corrected / max(size, 1), 0, 1)


def build(usual: dict[str, np.ndarray]) -> Filters:
    """Filters from each language's n-gram hashes, of any number of languages."""
    languages = sorted(usual, key=lambda s: s.encode())
    word = next((t for t in (np.uint8, np.uint16, np.uint32) if len(languages) <= 8 * t().itemsize), np.uint64)
    width = 8 * word().itemsize
    largest = max((u.size for u in usual.values()), default=0)
    bits = min(MOST_BITS, max(LEAST_BITS, (SLOTS_PER_GRAM * largest).bit_length()))
    tables = [np.zeros((1 << bits, max(1, -(-len(languages) // width))), word) for _ in range(HASHES)]
    out = Filters(languages, tables, np.zeros(len(languages)), bits)
    for i, name in enumerate(languages):
        rate = 1.0
        for k in range(HASHES):
            slots = np.unique(_slots(usual[name], k, bits))
            tables[k][slots, i // width] |= word(1 << i % width)
            rate *= slots.size / (1 << bits)
        out.false_rate[i] = rate
    return out


def _least_hashes(rows: DataFrame, n: int) -> DataFrame:
    """``lang, h``: the ``n`` least distinct hashes of each language of ``rows`` (``lang, h``).

    Each task passes on no more than ``n`` of a language. What is left is counted by the hash's first bits, and only the
    bins that hold the least ``n`` are ranked, so a language of very many texts is no one task's.
    """

    def least(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in it:
            coded = b.column("lang").dictionary_encode()
            codes, hs = coded.indices.to_numpy(), b.column("h").to_numpy()
            for code, name in enumerate(coded.dictionary.to_pylist()):
                held[name] = np.unique(np.concatenate((held.get(name, hs[:0]), hs[codes == code])))[:n]
        for name, hs in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * hs.size, pa.string()), pa.array(hs, pa.int64())], ["lang", "h"])

    few = cut(rows.mapInArrow(least, "lang string, h long").distinct().withColumn("bin", F.shiftright("h", 56)))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = few.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).where(F.coalesce("before", F.lit(0)) < n).select("lang", "bin")
    ranked = few.join(F.broadcast(bins), ["lang", "bin"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))  # 256 bins a language at most
    return ranked.where(F.col("rank") <= n).select("lang", "h")


def learn(labelled: DataFrame, sample_per_language: int = 1500, least_docs: int = 2) -> Filters:
    """Filters from rows with ``text`` and ``lang``; rows with a null in either are not used.

    At most ``sample_per_language`` distinct texts of a language are read. An n-gram is usual in a language if at least
    ``least_docs`` of them (1 if there are fewer than 20) have it.
    """
    rows = labelled.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("h"))
    taken = rows.join(F.broadcast(_least_hashes(rows.select("lang", "h"), sample_per_language)), ["lang", "h"])  # rows: languages x sample_per_language

    def grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            names, hs, gs = b.column("lang").to_pylist(), b.column("h").to_pylist(), []
            for t in b.column("text"):
                gs.append(np.unique(gram_hashes(np.frombuffer(folded(t.as_py()), np.uint8))).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(hs, pa.int64()), pa.array(gs, pa.list_(pa.int64()))], ["lang", "h", "grams"])

    seen = taken.select("lang", "h", "text").mapInArrow(grams, "lang string, h long, grams array<bigint>").dropDuplicates(["lang", "h"])
    totals = seen.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    counted = seen.select("lang", F.explode("grams").alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    kept = counted.join(F.broadcast(totals), "lang").where(F.col("n") >= F.when(F.col("n_docs") < 20, 1).otherwise(least_docs))
    arrow = kept.select("lang", "gram").toArrow()  # bounded by the sample's texts
    names, found = arrow.column("lang").combine_chunks().dictionary_encode(), arrow.column("gram").to_numpy().view(np.uint64)
    codes = (names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names).indices.to_numpy()
    return build({name: found[codes == i] for i, name in enumerate(names.dictionary.to_pylist())})


def predict(text: str | None, filters: Filters) -> tuple[str, float]:
    """Language and score of one text: ``und`` and 0 if it is null or has no letter.

    The score is the corrected share of the text's n-grams in the winner's filter. Ties go to the first language in
    code-point order. Without any learned language every text is ``und``.
    """
    if text is None or not filters.languages or not _LETTER.search(text):
        return UNDETERMINED, 0.0
    shares = filters.shares(text)
    best = int(shares.argmax())
    return filters.languages[best], float(shares[best])


def identify(docs: DataFrame, filters: Filters, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with a predicted language and a score (0 to 1), from the whole of ``text``.

    Rows may repeat and any column may be null; an empty table gives no rows. Columns of ``docs`` with the new names
    are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # as large as the sample's n-grams and the languages need

    @F.pandas_udf("lang string, score double")
    def judged(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in it:
            yield pd.DataFrame([predict(t, sent.value) for t in texts], columns=["lang", "score"])

    (both,) = unused(docs, "__judged")
    others = [c for c in docs.columns if c.lower() not in (lang_col.lower(), score_col.lower())]
    return docs.withColumn(both, judged("text")).select(*others, F.col(both)["lang"].alias(lang_col), F.col(both)["score"].alias(score_col))


def n_grams(text: str | None) -> int:
    """N-grams that a text's score rests on; 0 for null."""
    return max(len(folded(text or "")) - N + 1, 0)


def count_n_grams(text: Column) -> Column:
    """:func:`n_grams` as a column."""

    @F.pandas_udf("long")
    def counted(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series([n_grams(t) for t in texts], dtype="int64")

    return counted(text)


def held_out(fold: int = 2, of: int = 4) -> Column:
    """The rows whose labels are never learned; false for a null id, which :func:`learnable` leaves out too."""
    return F.coalesce(crc_of_id("doc_id") % of == fold, F.lit(False))


def learnable(fold: int = 2, of: int = 4) -> Column:
    """The rows whose labels may be learned: of a known id outside the fold."""
    return F.col("doc_id").isNotNull() & ~held_out(fold, of)
