"""Benchmark decontamination by greedy string tiling.

Texts are runs of words: ASCII letters in lower case, digits and bytes of longer characters, parted by anything else.
A document meets a benchmark item where they share a seed, a run of ``MIN_MATCH`` words. For each such pair, greedy
string tiling marks the longest matches that do not overlap, found for falling lengths by running Karp-Rabin hashes,
in both texts; the share of the item's words that tiles cover is its coverage. Tiles may come in any order, so passages
put in another order are still covered.

Every tile consists of seeds, so only words of the document inside seeds of that item are tiled; other words cannot
be in a tile. An item of fewer words than a seed is met only by a document that consists of just its words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_MATCH = 5
COVERAGE = 0.5
#: Bytes of benchmark text in one block: each block is sent to all executors and takes one pass over the documents.
BLOCK_BYTES = 16 << 20
_BLOOM_BITS = 22
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_B1 = 0x9E3779B97F4A7C15
_B2 = 0xC2B2AE3D27D4EB4F


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_FOLD).split()


def _inverse_powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_PIECE = 1 << 18


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS:
        _POWERS[base] = _inverse_powers(_PIECE + 1, base)
    return _POWERS[base]


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word, from polynomial sums over the words' joined bytes."""
    if not ws:
        return np.empty(0, np.uint64)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lengths)
    if ends[-1] > _PIECE:  # longer than the table of powers: in pieces of whole words
        if len(ws) == 1:
            return np.array([xxhash.xxh64_intdigest(ws[0])], np.uint64)
        half = len(ws) // 2
        return np.concatenate((word_hashes(ws[:half]), word_hashes(ws[half:])))
    data = np.frombuffer(b"".join(ws), np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = _powers(_B1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * up[: data.size], dtype=np.uint64)))
    starts = ends - lengths
    return _mixed((sums[ends] - sums[starts]) * down[starts])


def seed_hashes(h: np.ndarray, size: int = MIN_MATCH) -> np.ndarray:
    """A hash for each run of ``size`` words, from the words' hashes."""
    n = h.size - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(_B2) + h[k : k + n]
    return _mixed(out)


class _Sequence:
    """Word hashes with marks, and running Karp-Rabin hashes of its windows from prefix sums modulo 2^64."""

    def __init__(self, x: np.ndarray, marked: np.ndarray | None = None):
        self.x = x
        self.marked = np.zeros(x.size, bool) if marked is None else marked
        up, self._down = _powers(_B2) if x.size <= _PIECE else _inverse_powers(x.size + 1, _B2)
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up[: x.size], dtype=np.uint64)))
        self.settle()

    def settle(self) -> None:
        """Take new marks into account."""
        self._taken = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.marked)))

    def windows(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the unmarked windows of length ``s`` and their hashes."""
        n = self.x.size - s + 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self._taken[s:] == self._taken[:n])
        return at, (self._sums[at + s] - self._sums[at]) * self._down[at]

    def free(self, i: int, s: int) -> bool:
        """Whether a window that was unmarked before tiles of its own length ``s`` were marked still is."""
        return not (self.marked[i] or self.marked[i + s - 1])


def _meet(p: _Sequence, t: _Sequence, s: int) -> bool:
    ours, theirs = p.windows(s)[1], t.windows(s)[1]
    if not ours.size or not theirs.size:
        return False
    ours = np.sort(ours)
    return bool((ours[np.minimum(np.searchsorted(ours, theirs), ours.size - 1)] == theirs).any())


def _longest(p: _Sequence, t: _Sequence, least: int, most: int) -> int:
    """The greatest length from ``least`` to ``most`` of which unmarked windows of both have a hash in common, or 0.

    Windows that meet hold shorter ones that meet, so lengths are doubled and then halved.
    """
    if most < least or not _meet(p, t, least):
        return 0
    low, high = least, most + 1
    while low + 1 < high:
        s = min(2 * low, (low + high) // 2) if high == most + 1 else (low + high) // 2
        if _meet(p, t, s):
            low = s
        else:
            high = s
    return low


def tile(pattern: np.ndarray, text: np.ndarray, least: int = MIN_MATCH, blocked: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (pattern start, text start, length) of greedy string tiling of two arrays of word hashes, longest first.

    Again and again the longest match of unmarked words is marked, of those of one length the first in the pattern,
    then in the text; no tile is shorter than ``least``. ``blocked`` places of the text are in no tile. A level of one
    length takes time in proportion to both sequences, however often the text repeats what the pattern has.
    """
    p, t = _Sequence(pattern), _Sequence(text, None if blocked is None else blocked.copy())
    tiles: list[tuple[int, int, int]] = []
    s = _longest(p, t, least, min(pattern.size, text.size))
    while s:
        starts, hashes = p.windows(s)
        at, theirs = t.windows(s)
        met = np.isin(theirs, hashes)
        places: dict[int, list[int]] = defaultdict(list)
        for h, j in zip(theirs[met].tolist(), at[met].tolist(), strict=True):
            places[h].append(j)
        begun: dict[int, int] = {}  # places before it are marked, and stay so
        for i, h in zip(starts.tolist(), hashes.tolist(), strict=True):
            if h not in places or not p.free(i, s):
                continue
            k = begun.get(h, 0)
            while k < len(places[h]) and not t.free(places[h][k], s):
                k += 1
            begun[h] = k
            for j in places[h][k:]:
                if t.free(j, s) and np.array_equal(p.x[i : i + s], t.x[j : j + s]):
                    tiles.append((i, j, s))
                    p.marked[i : i + s] = t.marked[j : j + s] = True
                    break
        p.settle()
        t.settle()
        s = _longest(p, t, least, s - 1)
    return tiles


class Items:
    """Benchmark items of one block, given as (key, text), with an index of their seeds."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.keys_of: list[object] = []
        self.hashes: list[np.ndarray] = []
        self.seeds: list[np.ndarray] = []
        owners: dict[int, list[int]] = defaultdict(list)
        self.short: dict[bytes, list[int]] = defaultdict(list)
        for key, text in items:
            h = word_hashes(words(text))
            if not h.size:
                continue
            n = len(self.keys_of)
            self.keys_of.append(key)
            self.hashes.append(h)
            self.seeds.append(seed_hashes(h))
            if h.size < MIN_MATCH:
                self.short[h.tobytes()].append(n)
            for x in np.unique(self.seeds[-1]).tolist():
                owners[x].append(n)
        self.owners = dict(owners)
        self.keys = np.array(sorted(self.owners), np.uint64)
        self.bloom = np.zeros(1 << _BLOOM_BITS, bool)
        self.bloom[(self.keys >> np.uint64(64 - _BLOOM_BITS)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of a document's seeds that items have, and the seeds."""
        seeds = seed_hashes(h)
        at = np.flatnonzero(self.bloom[(seeds >> np.uint64(64 - _BLOOM_BITS)).astype(np.int64)])
        if at.size and self.keys.size:
            place = np.minimum(np.searchsorted(self.keys, seeds[at]), self.keys.size - 1)
            at = at[self.keys[place] == seeds[at]]
        return at, seeds[at]

    def coverages(self, text: str | None, least: float = 0.0) -> list[tuple[int, float, int, int]]:
        """(item, coverage, tiles, words covered) of each item that shares a seed with a text and is covered by at least
        the share ``least``. An item shorter than a seed is met only by a text that has its words and no others."""
        h = word_hashes(words(text))
        if h.size < MIN_MATCH:
            return [(n, 1.0, 1, h.size) for n in self.short.get(h.tobytes(), ())] if h.size else []
        at, seeds = self.hits(h)
        if not at.size:
            return []
        order = np.argsort(seeds, kind="stable")
        found, first = np.unique(seeds[order], return_index=True)
        places = dict(zip(found.tolist(), np.split(at[order], first[1:]), strict=True))
        of_item: dict[int, list[int]] = defaultdict(list)
        for x in found.tolist():
            for item in self.owners[x]:
                of_item[item].append(x)
        out = []
        for item, own in sorted(of_item.items()):
            pattern = self.hashes[item]
            # Tiles consist of seeds, so they cover no more of the item than its seeds that the text has.
            if _covered(np.flatnonzero(np.isin(self.seeds[item], np.array(own, np.uint64))), pattern.size).sum() < least * pattern.size:
                continue
            # Words of the document inside seeds of this item; a blocked place parts the runs.
            inside = np.flatnonzero(_covered(np.concatenate([places[x] for x in own]), h.size))
            gaps = np.flatnonzero(np.diff(inside) > 1) + 1
            tiles = tile(pattern, np.insert(h[inside], gaps, np.uint64(0)), MIN_MATCH, np.insert(np.zeros(inside.size, bool), gaps, True))
            covered = sum(k for _, _, k in tiles)
            if covered >= least * pattern.size:
                out.append((item, covered / pattern.size, len(tiles), covered))
        return out


def _covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words are inside the seeds at ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + MIN_MATCH, n), -1)
    return np.cumsum(change[:-1]) > 0


def _in_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """(key, text) of the distinct texts of ``benchmark``, in blocks of about ``block_bytes``."""
    texts = benchmark.where("text is not null").select("text").distinct().select(_key(), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    for k in range(n_blocks):
        yield [tuple(r) for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == k).collect()]  # of about block_bytes


def _key() -> Column:
    return F.sha2(F.col("text").cast("binary"), 256).alias("key")


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of documents and benchmark items whose coverage reaches ``threshold``.

    ``docs`` has ``doc_id, text``, ``benchmark`` has ``item_id, text``; other columns are not read. Returns ``doc_id,
    item_id, coverage, n_tiles, n_words`` (words covered). Null and empty texts match nothing. An item of fewer than
    five words holds no seed, and such words stand in any text: it matches only documents of just these words.
    Repeated rows of either table give repeated results; null ids are kept. Either table may be empty.

    The distinct texts of the benchmark are read in blocks of about ``block_bytes``, dealt by a hash, so what is sent
    to the executors at once is bounded however large it is; a text that many items share is read once.
    """
    spark = docs.sparkSession
    out = None
    kind = docs.schema["doc_id"].dataType.simpleString()
    for block in _in_blocks(benchmark, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def scan(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value)
            for b in it:
                rows = [(d, items.keys_of[i], c, n, w) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True) for i, c, n, w in items.coverages(t.as_py(), threshold)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (b.schema.field("doc_id").type, pa.string(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "key", "coverage", "n_tiles", "n_words"])

        found = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, key string, coverage double, n_tiles int, n_words int")
        out = found if out is None else out.unionByName(found)
    return out.join(benchmark.where("text is not null").select("item_id", _key()), "key").select("doc_id", "item_id", "coverage", "n_tiles", "n_words")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that reach ``threshold`` for any item; columns stay as they are.

    Null ids, null texts, repeated rows and empty tables are allowed: a row is judged by its own text.
    """
    spark = docs.sparkSession
    for block in _in_blocks(benchmark, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def keep(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value)
            for b in it:
                yield b.filter(pa.array([not items.coverages(t.as_py(), threshold) for t in b.column("text")], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
