"""Removal of repeated paragraphs by MinHash banding.

A paragraph is a line of at least ``MIN_WORDS`` words, the least that give a shingle. Runs of shorter lines are joined
until the hash of one ends them. A line of more than ``LONG_WORDS`` words is cut at sentence ends that its words alone
decide, so that a passage repeated inside longer text is met: a sentence of at least ``JOIN_WORDS`` words is a paragraph
of its own, and shorter ones between are joined until the hash of one ends them, on average every 16 words. Words are
parted by ASCII white space and compared in lower case; shingles are runs of five words.

A passage may also begin and end inside paragraphs, and lines may be wrapped in other ways. So the words of a whole text,
whatever their lines, also give stretches of ``STRETCH`` words, which meet if they are equal. Of each ``WINDOW`` words
that follow one another, those with the least hash of three words begin a stretch. Any run of ``WINDOW + STRETCH``
words therefore holds a whole stretch that begins at the same word wherever the run stands.

Bands of ``ROWS`` MinHash values collide for paragraphs alike. With a Jaccard similarity of 0.8, eight bands of two rows
miss a pair once in 3,500. Band hashes alone are compared first, so that only paragraphs with a collision are sent on.
Colliding paragraphs are verified by the exact Jaccard similarity of their shingles, and verified links make components;
of a component of several paragraphs, in one document or more, the first stays and the others are removed.

Under a band hash that more paragraphs share than one task should compare, they are split by prefixes: if shingles are put in one order, the rarest
under that band first, two sets that are alike enough have one in common among the first fifth of each, exactly. A
shingle that very many prefixes share stands for paragraphs that are mostly alike: each is compared with one of them,
the pivot, and where all are then in one component, that is all. If not, the Jaccard distance is a metric: paragraphs
whose distances to the pivot differ by more than the greatest distance of a link cannot be linked. So those not linked
to the pivot meet only the rings next to their own, block by block, where a task skips pairs that are connected already
and hands on the links of a spanning forest, never all pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, spool
from .components import components
from .decontam import seed_hashes, word_hashes
from .substrings import _PACKED, _PACKED_SQL, CHUNK_BYTES, _by_bucket, _bytes, _home, _stored, _table, _unique_hashes, repeated_hashes, sizes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 8, 2
MIN_WORDS, LONG_WORDS = SHINGLE, 40
#: Sentences of a long line with fewer words are joined.
JOIN_WORDS = 10
STRETCH, WINDOW = 25, 25
#: Part of a stretch in the result.
ACROSS = -1
#: Different paragraphs under one band hash that are joined directly, and that one task compares.
DIRECT = 64
BLOCK = 512

_SENTENCE = re.compile(rb"(?<=[.!?])[\"')\]]*[\x20\x09-\x0D]+")
_MULTIPLIERS = (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FIELDS = [("uid", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("paragraph", pa.int32()), ("part", pa.int32()), ("begin", pa.int32()), ("n_words", pa.int32()), ("shingles", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))]
_FIELDS_SQL = "uid binary, doc_id long, row long, paragraph int, part int, begin int, n_words int, shingles array<bigint>, bands array<bigint>"


def paragraphs(text: str | None, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> list[tuple[int, int, list[bytes]]]:
    """(line, sentence, words) of each paragraph of a whole text, lines and sentences counted from 0."""
    return [(line, part, ws) for line, part, _, ws in _placed(*_lines(text), min_words, long_words)]


def _lines(text: str | None) -> tuple[list[bytes], list[list[bytes]]]:
    """Lines of a text, and the words of each."""
    lines = (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")
    return lines, [line.split() for line in lines]


def _ends(ws: list[bytes]) -> bool:
    """Whether joining ends after these words, by their hash alone."""
    return xxhash.xxh32_intdigest(b" ".join(ws)) % 16 < len(ws)


def _placed(lines: list[bytes], split: list[list[bytes]], min_words: int, long_words: int) -> list[tuple[int, int, int, list[bytes]]]:
    """Paragraphs as (line, sentence, words before, words)."""
    out: list[tuple[int, int, int, list[bytes]]] = []
    joined: list[bytes] = []
    place = (0, 0, 0)
    at = 0

    def end() -> None:
        nonlocal joined
        if len(joined) >= min_words:
            out.append((*place, joined))
        joined = []

    def join(ws: list[bytes], *here: int) -> None:
        nonlocal joined, place
        place = place if joined else here
        joined = joined + ws
        if len(joined) >= min_words and _ends(ws):
            end()

    for i, (line, ws) in enumerate(zip(lines, split, strict=True)):
        if len(ws) < min_words:
            if ws:
                join(ws, i, 0, at)
        elif len(ws) <= long_words:
            end()
            out.append((i, 0, at, ws))
        else:
            end()
            before = at
            for k, sentence in enumerate(_SENTENCE.split(line)):
                s = sentence.split()
                if len(s) >= JOIN_WORDS:
                    end()
                    out.append((i, k, before, s))
                elif s:
                    join(s, i, k, before)
                before += len(s)
            end()
        at += len(ws)
    end()
    return out


def shingle_sets(found: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of paragraphs, one after the other, and where each paragraph's begin."""
    sizes = np.fromiter((len(w) for w in found), np.int64, len(found))
    every = seed_hashes(word_hashes([w for ws in found for w in ws]), SHINGLE)
    counts = sizes - SHINGLE + 1
    begins = np.cumsum(sizes) - sizes
    starts = np.cumsum(counts) - counts
    at = np.arange(int(counts.sum())) + np.repeat(begins - starts, counts)
    return every[at], starts


def band_hashes(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` hashes for each paragraph."""
    out = np.empty((starts.size, BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(starts.size, b + 1, np.uint64)
        for r in range(ROWS):
            x = shingles * _MULTIPLIERS[b * ROWS + r]
            x ^= x >> np.uint64(32)
            h = (h * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.minimum.reduceat(x * np.uint64(0xD6E8FEB86659FD93), starts)
        out[:, b] = h ^ (h >> np.uint64(29))
    return out


def _thinned(begins: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which stretches stay (mask), where equal ones overlap, as in a word said over and over: from the left, those apart."""
    order = np.lexsort((begins, hashes))
    b, h = begins[order], hashes[order]
    stays = np.ones(b.size, bool)
    for k in (np.flatnonzero((h[1:] == h[:-1]) & (b[1:] - b[:-1] < STRETCH)) + 1).tolist():
        last = k - 1
        while not stays[last]:
            last -= 1
        stays[k] = b[k] - b[last] >= STRETCH
    out = np.empty(b.size, bool)
    out[order] = stays
    return out


def _sliding(least: np.ufunc, x: np.ndarray) -> np.ndarray:
    """The minimum (or maximum) of each ``WINDOW`` values that follow one another."""
    size = 1
    while 2 * size <= WINDOW:
        x = least(x[:-size], x[size:])
        size *= 2
    rest = WINDOW - size
    return least(x[:-rest], x[rest:]) if rest else x


def stretches(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of words, hash) of the stretches of texts given as words.

    The first and the last ``STRETCH`` words of a text are stretches too, so that every word is in one. A text with fewer
    words is one stretch; with fewer than ``SHINGLE`` it has none.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    h = word_hashes([w for ws in texts for w in ws])
    long = sizes >= STRETCH
    owner = np.repeat(np.arange(sizes.size), sizes)
    begins = [starts[long], (starts + sizes - STRETCH)[long]]
    grams = seed_hashes(h, 3)
    if grams.size >= WINDOW:
        least = _sliding(np.minimum, grams)
        least[np.arange(least.size) + WINDOW + 2 > (starts + sizes)[owner[: least.size]]] = 0
        around = np.concatenate((np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)))
        found = np.flatnonzero(_sliding(np.maximum, around) == grams)
        begins.append(found[found + STRETCH <= (starts + sizes)[owner[found]]])
    begin = np.unique(np.concatenate(begins))
    hashes = seed_hashes(h, STRETCH)[begin] if begin.size else np.empty(0, np.uint64)
    stays = _thinned(begin, hashes)
    begin, hashes = begin[stays], hashes[stays]
    short = np.flatnonzero((sizes >= SHINGLE) & ~long)
    whole = np.array([xxhash.xxh64_intdigest(b" ".join(texts[r])) for r in short.tolist()], np.uint64)
    rows = np.concatenate((owner[begin], short))
    return rows, np.concatenate((begin, starts[short])) - starts[rows], np.minimum(sizes[rows], STRETCH), np.concatenate((hashes, whole))


class _Paragraphs:
    """Paragraphs of a chunk's documents, and stretches if asked for; words are kept joined, which takes less memory."""

    def __init__(self, docs: pa.Table, min_words: int, long_words: int, across: bool, hashes_only: bool = False):
        self.hashes_only = hashes_only
        self.row: list[int] = []
        self.place: list[tuple[int, int, int]] = []
        self.size: list[int] = []
        self.joined: list[bytes] = []
        self.shingles: list[np.ndarray] = []
        self.stretches: list[tuple[int, int, int, int, bytes]] = []
        self._bands: list[np.ndarray] = []
        self._hashes: list[np.ndarray] = []
        words: list[list[bytes]] = []
        texts: list[list[list[bytes]]] = []
        waiting = first = 0
        for r, text in enumerate(docs.column("text")):
            lines, split = _lines(text.as_py())
            for line, part, begin, ws in _placed(lines, split, min_words, long_words):
                self.row.append(r)
                self.place.append((line, part, begin))
                words.append(ws)
            texts.append(split if across else [])
            waiting += sum(map(len, split))
            if waiting > 100_000:
                self._read(words, texts, first)
                words, texts, waiting, first = [], [], 0, r + 1
        self._read(words, texts, first)
        self.bands = np.concatenate(self._bands) if self._bands else np.zeros((0, BANDS), np.uint64)
        self.hashes = np.concatenate((self.bands.ravel(), *self._hashes))

    def _read(self, words: list[list[bytes]], texts: list[list[list[bytes]]], first: int) -> None:
        """Keep what the paragraphs and texts, the first of which is row ``first``, are compared by."""
        if words:
            s, starts = shingle_sets(words)
            self._bands.append(band_hashes(s, starts))
        if words and not self.hashes_only:
            self.shingles += np.split(s, starts[1:])
            self.size += map(len, words)
            self.joined += map(b" ".join, words)
        whole = [[w for ws in split for w in ws] for split in texts]
        rows, begins, sizes, hashes = stretches(whole)
        self._hashes.append(hashes)
        if self.hashes_only:
            return
        ends = [list(accumulate(map(len, split))) for split in texts]
        for r, b, n in zip(rows.tolist(), begins.tolist(), sizes.tolist(), strict=True):
            self.stretches.append((first + r, bisect_right(ends[r], b), b, n, b" ".join(whole[r][b : b + n])))


def _send(docs: pa.Table, n: int, min_words: int, long_words: int, across: bool) -> pa.Table:
    """For a chunk: its distinct hashes of bands and stretches, by bucket."""
    found = _Paragraphs(docs, min_words, long_words, across, hashes_only=True)
    u, many, _ = _unique_hashes(found.hashes)
    chunk = docs.column("chunk")[0].as_py() if docs.num_rows else 0
    return _table([(0, b, chunk, _bytes(u[i]), np.packbits(many[i]).tobytes(), None, None) for b, i in _by_bucket(_home(u, n), n)], _PACKED)


def _colliding(docs: pa.Table, replies: pa.Table, n: int, min_words: int, long_words: int, across: bool) -> pa.Table:
    """For a chunk: its paragraphs and stretches with a hash that comes again; shingles once for equal paragraphs."""
    schema = pa.schema(_FIELDS)
    if not docs.num_rows:
        return _table([], schema)
    found = _Paragraphs(docs, min_words, long_words, across)
    u, _, inverse = _unique_hashes(found.hashes)
    again = np.zeros(u.size, bool)
    answers = dict(zip(replies.column("bucket").to_pylist(), replies.column("a").to_pylist(), strict=True))
    for b, i in _by_bucket(_home(u, n), n):
        again[i] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=i.size).astype(bool)
    comes_again = again[inverse]
    hit = comes_again[: found.bands.size].reshape(found.bands.shape)
    ids, rows = docs.column("doc_id").to_pylist(), docs.column("row").to_pylist()
    out, told = [], set()
    for k in np.flatnonzero(hit.any(axis=1)).tolist():
        r, uid = found.row[k], xxhash.xxh3_128_digest(found.joined[k])
        first = uid not in told
        told.add(uid)
        out.append((uid, ids[r], rows[r], *found.place[k], found.size[k], np.unique(found.shingles[k].view(np.int64)) if first else None, found.bands[k][hit[k]].view(np.int64) if first else None))
    for k in np.flatnonzero(comes_again[found.bands.size :]).tolist():
        r, line, begin, size, joined = found.stretches[k]
        out.append((b"s" + xxhash.xxh3_128_digest(joined), ids[r], rows[r], line, ACROSS, begin, size, None, None))
    return _table(out, schema)


def similarity(a: set[int], b: set[int]) -> float:
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def _linked_in_blocks(p: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of a spanning forest among the paragraphs of two sides (or of one), over the components known before."""
    p = p.sort_values("uid")
    uids, sides, sets = p["uid"].tolist(), p["side"].tolist(), [set(x) for x in p["shingles"]]
    parent = list(range(len(uids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    first: dict[bytes, int] = {}
    for i, c in enumerate(p["component"]):
        parent[i] = first.setdefault(c, i)
    out = []
    same = len(set(sides)) == 1
    for i in range(len(uids)):
        for j in range(i):
            if (same or sides[i] != sides[j]) and root(i) != root(j) and similarity(sets[i], sets[j]) >= least:
                parent[root(i)] = root(j)
                out.append((uids[i], uids[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def _common(a: str, b: str) -> Column:
    """The Jaccard similarity of two arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _near_pairs(rows: DataFrame, keys: list[str], sets: DataFrame, least: float) -> DataFrame:
    """Links ``a, b`` among the paragraphs (``uid``) of ``rows`` with the same ``keys``."""
    pairs = rows.alias("x").join(rows.alias("y"), keys).where("x.uid > y.uid").select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("uid").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("uid").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.where(_common("sa", "sb") >= least).select("a", "b")


def _rare_first(many: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``band, token, uid``: the prefix of each paragraph under each of its bands, the band's rarest shingles first, as
    far as others under the band have them."""
    held = many.join(sets, "uid").select("band", "uid", F.size("shingles").alias("size"), F.explode("shingles").alias("token"))
    often = held.groupBy("band", "token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    place = F.row_number().over(Window.partitionBy("band", "uid").orderBy(F.coalesce("f", F.lit(1)), "token"))
    ranked = held.join(often, ["band", "token"], "left").withColumn("place", place)
    return ranked.where(F.col("f").isNotNull() & (F.col("place") <= F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1)).select("band", "token", "uid")


def _around_pivots(large: DataFrame, sets: DataFrame) -> DataFrame:
    """``large`` (``band, token, n, uid, pivot``) with ``alike``, the similarity of each paragraph to its key's pivot."""
    key = ["band", "token"]
    pivots = large.where("uid = pivot").select(*key, "pivot").join(sets.withColumnRenamed("uid", "pivot"), "pivot").select(*key, F.col("shingles").alias("sp"))
    return large.join(pivots, key).join(sets, "uid").select(*key, "n", "uid", "pivot", _common("shingles", "sp").alias("alike"))


def _between_rings(member: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """Links between components of ``member`` (``band, token, n, uid, alike, component``) that share a hot shingle."""
    key = ["band", "token"]
    # Rings of distance to the pivot, as wide as a link is long: only neighbours can hold both ends of one.
    ring = F.floor((1 - F.col("alike")) / (1 - least) + 1e-9).cast("int")
    placed = member.withColumn("ring", ring).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    inner = F.transform(every, lambda x: F.struct(F.col("ring").alias("low"), F.col("ring").alias("high"), F.least("own", x).alias("i"), F.greatest("own", x).alias("j"), F.col("own").alias("side")))
    upper = F.transform(every, lambda x: F.struct(F.col("ring").alias("low"), (F.col("ring") + 1).alias("high"), F.col("own").alias("i"), x.alias("j"), F.lit(0).alias("side")))
    lower = F.transform(every, lambda x: F.struct((F.col("ring") - 1).alias("low"), F.col("ring").alias("high"), x.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")))
    # All of the first ring are linked to the pivot; they meet the next ring only.
    meetings = F.when(F.col("ring") > 0, F.concat(inner, upper, lower)).otherwise(upper)
    cells = placed.select(*key, "uid", "component", F.explode(meetings).alias("m")).select(*key, "uid", "component", "m.*")

    def joined(p: pd.DataFrame) -> pd.DataFrame:
        return _linked_in_blocks(p, least)

    return cells.join(sets, "uid").groupBy(*key, "low", "high", "i", "j").applyInPandas(joined, "a binary, b binary")


def links(units: DataFrame, least: float = SIMILARITY, direct: int = DIRECT, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between paragraphs (``uid, shingles, bands``) that make the components of all verified links
    between those that share a band hash.

    Up to ``direct`` paragraphs under a band hash are compared in pairs, up to ``block`` in one task that skips pairs
    connected already. Of more, not all links are made: the components of those that are found first stand for them,
    each as links to its least paragraph, and links between components are added.
    """
    rows = units.select("uid", F.explode(F.array_distinct("bands")).alias("band"))
    shared = cut(rows.join(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band"))
    sets = units.select("uid", "shingles")

    def joined(p: pd.DataFrame) -> pd.DataFrame:
        return _linked_in_blocks(p, least)

    pairs = _near_pairs(shared.where(F.col("n") <= direct).select("band", "uid"), ["band"], sets, least)
    alone = shared.where((F.col("n") > direct) & (F.col("n") <= block)).join(sets, "uid").select("band", "uid", "shingles", F.lit(0).alias("side"), F.col("uid").alias("component"))
    near = pairs.union(alone.groupBy("band").applyInPandas(joined, "a binary, b binary"))
    many = shared.where(F.col("n") > block).select("band", "uid")
    if many.isEmpty():
        return near
    key = ["band", "token"]
    prefix = cut(_rare_first(many, sets, least))
    # Stored, so that the join reads two plain shuffles, which are split where one key has very many rows.
    groups = cut(prefix.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("pivot")).where("n > 1"))
    counted = cut(prefix.join(groups, key))
    few = counted.where(F.col("n") <= direct)
    met = cut(_around_pivots(counted.where(F.col("n") > direct), sets))
    star = met.where((F.col("uid") != F.col("pivot")) & (F.col("alike") >= least)).select(F.col("uid").alias("a"), F.col("pivot").alias("b"))
    known = components(near.union(_near_pairs(few.select(*key, "uid"), key, sets, least)).union(star))
    found = known.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    member = met.join(known.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    apart = member.groupBy(*key).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(*key)
    member = cut(member.join(apart, key))
    return found if member.isEmpty() else found.union(_between_rings(member, sets, least, block))


def repeated(docs: DataFrame, least: float = SIMILARITY, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS, chunk_bytes: int = CHUNK_BYTES, across: bool = False) -> DataFrame:
    """The paragraphs that repeat, in several documents or in one, one row per occurrence.

    ``docs`` has ``doc_id, text``; other columns are not read. Returns ``doc_id, paragraph`` (line), ``part`` (sentence
    of a long line), ``begin`` (words of the document before), ``n_words, cluster, first_doc_id``, ``removed``, false for
    the first occurrence of a cluster in the order of doc_id, row and place, ``n_removed``, its words if it is removed,
    else 0, and ``across_documents``, whether the cluster spans several. With ``across``, repeated stretches have rows
    too, with ``ACROSS`` as part, the line they begin in and clusters of their own. Documents without such a paragraph
    have no row.

    A joined paragraph has the place of its first line or sentence. Fewer than ``min_words`` words have no shingle and make
    no paragraph: null and empty texts have none; repeated rows are documents of their own; null ids come last; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks, buckets, n = sizes(total, chunk_bytes)
    stored = _stored(docs, n_chunks, buckets)
    chunks = stored.groupBy("chunk")

    def step1(t: pa.Table) -> pa.Table:
        return _send(t, n, min_words, long_words, across)

    def step2(t: pa.Table, r: pa.Table) -> pa.Table:
        return _colliding(t, r, n, min_words, long_words, across)

    replies = spool(chunks.applyInArrow(step1, _PACKED_SQL).groupBy("kind", "bucket").applyInArrow(repeated_hashes, _PACKED_SQL))
    found = spool(chunks.cogroup(replies.groupBy("chunk")).applyInArrow(step2, _FIELDS_SQL))
    # Of what is stored, the result reads only what is found and its clusters.
    release(stored, replies)
    units = spool(found.where("shingles is not null").groupBy("uid").agg(F.first("shingles").alias("shingles"), F.first("bands").alias("bands")))
    joined = components(links(units, least))
    release(units)
    member = found.drop("shingles", "bands").join(joined.select(F.col("node").alias("uid"), "component"), "uid", "left").withColumn("cluster", F.coalesce("component", "uid")).drop("component")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "paragraph", "part", "begin", "n_words")
    end = F.col("begin") + F.col("n_words")
    heads = member.groupBy("cluster").agg(F.min(place).alias("first"), F.min("row").alias("low"), F.max("row").alias("high"), F.max("begin").alias("latest"), F.min(end).alias("earliest"))
    # In one document, at least two occurrences must lie apart.
    # Stored, so that the join reads two plain shuffles, which are split where one cluster has very many rows.
    heads = cut(heads.where("low < high or latest >= earliest").select("cluster", "first", (F.col("low") < F.col("high")).alias("across_documents")))
    # Stretches may overlap: one that shares words with the first, in its document, is not removed.
    apart = (F.col("row") != F.col("first.row")) | (F.col("begin") >= F.col("first.begin") + F.col("first.n_words"))
    out = member.join(heads, "cluster").withColumn("removed", apart)
    n_removed = F.when(F.col("removed"), F.col("n_words")).otherwise(0).cast("long")
    return out.select("doc_id", "paragraph", "part", "begin", "n_words", F.lower(F.hex("cluster")).alias("cluster"), F.col("first.doc_id").alias("first_doc_id"), "removed", n_removed.alias("n_removed"), "across_documents")
