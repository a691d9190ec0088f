"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits, one for each bit of XXH64 that is set in over half of a text's three-word shingles.
Fingerprints within two bits are linked. They are cut into two segments of 32 bits: two bits of difference leave either
at most one in the high segment or none in the low one, so the ball of radius one about the high segment and the low
segment itself, looked up in a table of each segment, reach every link; complete distances decide.

A table entry that very many fingerprints share would make pairs with the square of their number. Such entries are
linked exactly without pairs: fingerprints under one entry are within two bits if and only if balls of radius one about
the other segment meet, so every point of those balls links its fingerprints to the least of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, unused
from .components import components

SEED = 42
SHINGLE = 3
#: Bytes of a text that are read at once, about.
BLOCK = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: A table entry of more fingerprints than this is linked by ball points rather than by pairs.
LARGE_ENTRY = 64


def _blocks(data: bytes) -> Iterator[bytes]:
    """Stretches of a long text, cut at white space."""
    at = 0
    while at < len(data):
        cut_at = _SPACE.search(data, at + BLOCK)
        end = cut_at.start() if cut_at else len(data)
        yield data[at:end]
        at = end


def _bit_counts(words: list[bytes]) -> tuple[np.ndarray, int]:
    """How many shingles of a run of words set each bit, and the number of shingles."""
    n = len(words) - SHINGLE + 1
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts, n


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text; 0 for null and for a text without words. A very long text is read
    stretch by stretch."""
    data = text.encode("utf-8", "surrogatepass").lower() if text else b""
    words: list[bytes] = []
    counts, n = np.zeros(64, np.int64), 0
    for block in _blocks(data):
        words += block.split()
        if len(words) >= SHINGLE:
            more, k = _bit_counts(words)
            counts, n, words = counts + more, n + k, words[1 - SHINGLE :]
    if n == 0:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *carry: str) -> DataFrame:
    """``carry`` columns and ``fp`` (the fingerprint as a signed long) of every row of ``docs``, from ``text``."""
    fields = [f for c in carry for f in docs.schema.fields if f.name == c]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "fp long"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(fps)], [*carry, "fp"])

    return docs.select(*carry, "text").mapInArrow(batches, schema)


def links(fps: DataFrame, large: int = LARGE_ENTRY) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``, no repeats) of distance 1 or 2.

    Links may stand for others by way of a third fingerprint, but join the same components as all of them would.
    """
    low = F.lit(0xFFFFFFFF)
    segments = F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(low))
    entries = fps.select("fp", F.posexplode(segments).alias("seg", "value"))
    sizes = entries.groupBy("seg", "value").count().where(F.col("count") > 1).select("seg", "value", (F.col("count") > large).alias("big"))
    filled = cut(entries.join(sizes, ["seg", "value"]).select("seg", "value", "fp", "big"))
    # A lone fingerprint's entry can still be reached from a neighbour's ball, so the high table is probed whole.
    high = entries.where("seg = 0").select("value", F.col("fp").alias("b"))
    big_high = filled.where("seg = 0 and big").select("value").distinct()
    bits = F.sequence(F.lit(0), F.lit(31))
    value = F.shiftrightunsigned("fp", 32)
    # Of two high segments one bit apart, the one without the bit probes.
    unset = F.filter(bits, lambda i: F.getbit(value, i) == 0)
    ball = F.transform(unset, lambda i: value.bitwiseOR(F.expr("1L").cast("long") * F.pow(F.lit(2), i).cast("long")))
    probes = fps.select(F.col("fp").alias("a"), F.explode(ball).alias("value"))
    # Large entries are taken out of both sides before they meet, as none of their pairs may be made.
    small = lambda side: side.join(big_high, "value", "left_anti")
    near_small = small(probes).join(small(high), "value").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")
    same = filled.where("not big")
    paired = same.alias("x").join(same.alias("y"), ["seg", "value"]).where("x.fp < y.fp").where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 2).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    # Entries of many fingerprints: points of balls about the other segment.
    other = F.when(F.col("seg") == 0, F.col("fp").bitwiseAND(low)).otherwise(F.shiftrightunsigned("fp", 32))
    around = F.concat(F.array(other), F.transform(bits, lambda i: other.bitwiseXOR(F.pow(F.lit(2), i).cast("long"))))
    points = filled.where("big").select("seg", "value", "fp", F.explode(around).alias("point"))
    callers = probes.join(big_high, "value").select(F.lit(0).alias("seg"), "value", F.col("a").alias("fp"), F.col("a").bitwiseAND(low).alias("point"))
    points = points.unionByName(callers)
    least = points.groupBy("seg", "value", "point").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    starred = points.join(least, ["seg", "value", "point"]).where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return near_small.union(paired).union(starred)


def _clusters(marked: DataFrame) -> DataFrame:
    """``fp, component`` of every distinct fingerprint, ``component`` the least fingerprint reachable."""
    distinct = cut(marked.select("fp").distinct())
    found = components(links(distinct))
    return distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs`` (``doc_id, text``).

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` the smallest doc_id reachable by links of at most two
    differing bits, the row's own included. Null and wordless texts have fingerprint zero and link like any other.
    Rows may repeat, ids too. A null doc_id is never a component's id unless no member has another. An empty table
    gives no rows. Other columns are not read.
    """
    marked = cut(fingerprints(docs, "doc_id"))
    member = _clusters(marked)
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    heads = member.join(firsts, "fp").groupBy("component").agg(F.min("first").alias("component_id"))
    ids = member.join(heads, "component").select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, null last, of repeated ids the first row.

    ``docs`` must be a stored table: rows are told apart by their place in its scan. All columns stay as they are.
    """
    (row,) = unused(docs, "__row")
    placed = docs.withColumn(row, F.monotonically_increasing_id())
    marked = cut(fingerprints(placed, "doc_id", row))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("row"))
    firsts = marked.groupBy("fp").agg(F.min(order).alias("first"))
    kept = _clusters(marked).join(firsts, "fp").groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return placed.join(kept, row, "left_semi").select(*docs.columns)
