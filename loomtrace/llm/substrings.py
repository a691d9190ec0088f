"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``K`` bytes that covers it also starts earlier: in a document of smaller id, or earlier in
the same document. Suffix arrays over all text would sort mostly text that repeats nowhere, so three lossless steps
come first.

* Of every ``K`` bytes, the run of ``K // 3`` bytes of least hash is its anchor. Equal strings have equal anchors at
  equal places, so a string can only repeat if its anchor's hash does. Hashes alone are compared first.
* The piece about a repeated anchor, all bytes of strings that it can anchor, is compared next by a 128-bit hash. Of
  pieces that are equal, all but the earliest are removed whole: each of their strings is in the earliest, too.
* Pieces that differ although their anchors are equal are all that is left to sort. They go to shards by anchor, where
  only the part of a piece that shares a long string at one of a few places about its anchor is kept.

A shard sorts the suffixes of its pieces by induced sorting, computes permuted common prefixes and finds the classes of
equal strings; all but the earliest string of a class go. Pieces of an anchor with very many different ones are cut
about a few places at set distances from the anchor, and the cuts go to shards by the bytes at these places, which equal
strings share: so equal strings meet in one shard. The more pieces, the closer the places, up to single strings.

Text is stored once, bucketed by chunk in the shared folder, so that each step meets a chunk's rows without a shuffle
of text. What chunks send each other are packed arrays.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_path, shared_dir, spool
from .suffixes import repeated_windows

K = 100
CHUNK_BYTES = 8 << 20
#: Different pieces of one anchor in one shard, about.
PIECES_PER_SHARD = 4096
#: Shards' worth of different pieces of one anchor up to which its pieces are cut about places far apart, and less far.
FAR_WAYS, NEAR_WAYS = 32, 1024
#: Bytes of pieces whose suffixes are sorted at once, about.
SORT_BYTES = 3 << 20
MOST_CHUNKS, MOST_BUCKETS = 1 << 20, 1 << 16
_LAST = (1 << 63) - 1

_M1, _M2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_STEP = 1 << 21  # bytes hashed at a time
_INDEX_BITS = 22
_CUT_AT_ONCE = 8192  # pieces


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _splitmix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_M1))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least ``n`` of them."""
    if base not in _POWERS or _POWERS[base][0].size < n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    up, _ = _powers(base, values.size + 1)
    out = np.zeros(values.size + 1, np.uint64)
    np.cumsum(values * up[: values.size], out=out[1:])
    return out


def _run_hash(sums: np.ndarray, base: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The unmixed hash of the bytes from ``a`` to ``b``, whatever their place."""
    return (sums[b] - sums[a]) * _powers(base, sums.size)[1][a]


class Anchors:
    """Anchors of a chunk's documents: row, place in its document, piece about it and hashes of anchor and piece."""

    def __init__(self, texts: pa.Array, k: int = K, step: int = _STEP):
        self.k, self.seed = k, max(1, k // 3)
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):  # no rows
            texts = pa.array([], pa.string())
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1)
        data = texts.buffers()[2] if len(texts) else None
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.start, self.end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
        if texts.null_count:
            self.end = np.where(texts.is_valid().to_numpy(zero_copy_only=False), self.end, self.start)
        parts = [self._select(a, b, rows, first, last) for a, b, rows, first, last in self._units(step)]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
        self.row, self.place, self.left, self.right, self.h, self.g = columns

    def _units(self, step: int):
        """Stretches of the data with the rows in them and their first and last window: whole documents together, a
        long document in overlapping stretches."""
        k, reach = self.k, self.k - self.seed
        rows: list[int] = []
        for r in np.flatnonzero(self.end - self.start >= k).tolist():
            s, e = int(self.start[r]), int(self.end[r])
            if rows and e - self.start[rows[0]] > step:
                yield self._whole(rows)
                rows = []
            if e - s <= step:
                rows.append(r)
                continue
            for p in range(s, e - k + 1, step):
                last = min(p + step, e - k + 1)
                yield max(s, p - reach), min(e, last + k - 1 + reach + self.seed), [r], np.array([p]), np.array([last])
        if rows:
            yield self._whole(rows)

    def _whole(self, rows: list[int]):
        return int(self.start[rows[0]]), int(self.end[rows[-1]]), rows, self.start[rows], self.end[rows] - self.k + 1

    def _select(self, a: int, b: int, rows: list[int], first: np.ndarray, last: np.ndarray):
        """Anchors of the windows that start from ``first`` up to ``last`` of each row, within the bytes a to b."""
        values = _BYTE[self.data[a:b]]
        n, seed = values.size, self.seed
        m = n - seed + 1
        sums = _sums(values, _M1)
        h = _splitmix((sums[seed:] - sums[:m]) * _powers(_M1, n + 1)[1][:m])
        least = (h & np.uint64(~((1 << _INDEX_BITS) - 1) & _LAST * 2 + 1)) | np.arange(m, dtype=np.uint64)
        span, width = 1, self.k - seed + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: least.size - (width - span)], least[width - span :])
        change = np.zeros(least.size + 1, np.int32)
        np.add.at(change, first - a, 1)
        np.add.at(change, last - a, -1)
        chosen = (least[np.cumsum(change[:-1]) > 0] & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)
        if chosen.size:
            chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
        place = chosen + a
        which = np.searchsorted(first - (first - self.start[rows]) if len(rows) > 1 else np.array([a]), place, "right") - 1
        row = np.asarray(rows, np.int64)[which]
        reach = self.k - seed
        left = np.maximum(self.start[row], place - reach)
        right = np.minimum(self.end[row], place + self.k)
        g = _run_hash(_sums(values, _M2), _M2, left - a, right - a) + (place - left).astype(np.uint64) * np.uint64(_M1) + (right - place).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        return row, place - self.start[row], left, right, h[chosen], _splitmix(g)

    def kept(self, which: np.ndarray) -> None:
        for name in ("row", "place", "left", "right", "h", "g"):
            setattr(self, name, getattr(self, name)[which])


def _by_bucket(bucket: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """Indices of each bucket that has any, in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    return [(k, order[cuts[k] : cuts[k + 1]]) for k in range(n) if cuts[k] < cuts[k + 1]]


def _home(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(11)) % np.uint64(n)).astype(np.int64)


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_PACKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_PACKED_SQL = "kind int, bucket int, chunk int, a binary, b binary, c binary, d binary"
_FOUND = pa.schema([("kind", pa.int32()), ("key", pa.int32()), ("src", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_FOUND_SQL = "kind int, key int, src long, a binary, b binary"
_MARK, _PIECE = 0, 1


def _unique_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, whether each comes more than once, and for each entry its distinct hash."""
    u, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    return u, counts > 1, inverse


def send_hashes(docs: pa.Table, k: int, n: int) -> pa.Table:
    """Step 1, for a chunk: its distinct anchor hashes, by bucket."""
    if not docs.num_rows:
        return _table([], _PACKED)
    chunk = docs.column("chunk")[0].as_py()
    u, many, _ = _unique_hashes(Anchors(docs.column("text"), k).h)
    return _table([(0, b, chunk, _bytes(u[i]), np.packbits(many[i]).tobytes(), None, None) for b, i in _by_bucket(_home(u, n), n)], _PACKED)


def repeated_hashes(sent: pa.Table) -> pa.Table:
    """Step 1, for a bucket: which hashes of each chunk come elsewhere or more than once."""
    rows = sent.to_pylist()
    hs = [np.frombuffer(r["a"], np.uint64) for r in rows]
    every = np.concatenate(hs)
    many = np.concatenate([np.unpackbits(np.frombuffer(r["b"], np.uint8), count=h.size) for r, h in zip(rows, hs, strict=True)]).astype(bool)
    u, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    twice = counts > 1
    np.logical_or.at(twice, inverse[many], True)
    flags = np.split(twice[inverse], np.cumsum([h.size for h in hs])[:-1])
    return _table([(0, r["bucket"], r["chunk"], np.packbits(f).tobytes(), None, None, None) for r, f in zip(rows, flags, strict=True)], _PACKED)


class _Chunk:
    """A chunk's repeated anchors, and its part in both comparisons, told again from the same text."""

    def __init__(self, docs: pa.Table, replies: list[dict], k: int, n: int):
        self.chunk = docs.column("chunk")[0].as_py()
        self.rows = docs.column("row").to_numpy()
        self.docs = docs.column("doc_key").to_numpy()
        self.anchors = a = Anchors(docs.column("text"), k)
        u, _, inverse = _unique_hashes(a.h)
        repeated = np.zeros(u.size, bool)
        answers = {r["bucket"]: r["a"] for r in replies if r["kind"] == 0}
        for b, i in _by_bucket(_home(u, n), n):
            if b in answers:
                repeated[i] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=i.size).astype(bool)
        a.kept(repeated[inverse])
        # Distinct anchors, and distinct pieces with their earliest place.
        doc = self.docs[a.row]
        self.order = np.lexsort((a.place, doc, a.g, a.h))
        h, g = a.h[self.order], a.g[self.order]
        new_h = np.concatenate(([True], h[1:] != h[:-1])) if h.size else np.zeros(0, bool)
        new = new_h | np.concatenate(([True], g[1:] != g[:-1])) if h.size else new_h
        self.heads = np.flatnonzero(new)  # in self.order: the earliest of each piece
        self.piece = np.cumsum(new) - 1
        self.uh, self.ug = h[self.heads], g[self.heads]
        self.udoc, self.uplace = doc[self.order][self.heads], a.place[self.order][self.heads]
        starts = np.flatnonzero(new_h[self.heads]) if h.size else np.zeros(0, np.int64)
        self.hash_of_piece = np.cumsum(new_h[self.heads]) - 1 if h.size else np.zeros(0, np.int64)
        self.dh = self.uh[starts]
        self.low = np.minimum.reduceat(self.ug, starts) if starts.size else self.dh
        self.high = np.maximum.reduceat(self.ug, starts) if starts.size else self.dh
        self.count = np.diff(np.concatenate((starts, [self.uh.size])))

    def buckets(self, n: int):
        return _by_bucket(_home(self.dh, n), n), _by_bucket(_home(_splitmix(self.uh + self.ug * np.uint64(_M1)), n), n)


def send_pieces(docs: pa.Table, replies: pa.Table, k: int, n: int) -> pa.Table:
    """Step 2, for a chunk: least and greatest piece hash of each repeated anchor, and each piece's earliest place."""
    if not docs.num_rows:
        return _table([], _PACKED)
    c = _Chunk(docs, replies.to_pylist(), k, n)
    by_hash, by_piece = c.buckets(n)
    out = [(1, b, c.chunk, _bytes(c.dh[i]), _bytes(c.low[i]), _bytes(c.high[i]), _bytes(c.count[i].astype(np.int64))) for b, i in by_hash]
    out += [(2, b, c.chunk, _bytes(c.uh[i]), _bytes(c.ug[i]), _bytes(c.udoc[i]), _bytes(c.uplace[i])) for b, i in by_piece]
    return _table(out, _PACKED)


def compare_pieces(sent: pa.Table, pieces_per_shard: int) -> pa.Table:
    """Step 2, for a bucket of either kind.

    Kind 1: over how many shards each anchor's pieces go, 0 if all are equal. Kind 2: whether each piece is the earliest
    of those equal to it.
    """
    rows = sent.to_pylist()
    sizes = [len(r["a"]) // 8 for r in rows]
    kind = rows[0]["kind"]
    h = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows])
    if kind == 1:
        low, high = (np.concatenate([np.frombuffer(r[x], np.uint64) for r in rows]) for x in "bc")
        count = np.concatenate([np.frombuffer(r["d"], np.int64) for r in rows])
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        differ = np.minimum.reduceat(low[order], starts) != np.maximum.reduceat(high[order], starts)
        shards = np.where(differ, np.minimum(-(-np.add.reduceat(count[order], starts) // pieces_per_shard), 65535), 0)
        answer = np.empty(h.size, np.uint16)
        answer[order] = np.repeat(shards, np.diff(np.concatenate((starts, [h.size]))))
        parts = [_bytes(x) for x in np.split(answer, np.cumsum(sizes)[:-1])]
    else:
        g = np.concatenate([np.frombuffer(r["b"], np.uint64) for r in rows])
        doc, place = (np.concatenate([np.frombuffer(r[x], np.int64) for r in rows]) for x in "cd")
        earliest = _firsts((h, g), doc, place)
        parts = [np.packbits(x).tobytes() for x in np.split(earliest, np.cumsum(sizes)[:-1])]
    return _table([(kind, r["bucket"], r["chunk"], p, None, None, None) for r, p in zip(rows, parts, strict=True)], _PACKED)


def _merged(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each row, its intervals [a, b) merged where they meet, as an array of starts and ends in turn."""
    if not row.size:
        return []
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    out, cuts = [], np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True])))
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        far = np.maximum.accumulate(b[s:e])
        new = np.concatenate(([True], a[s + 1 : e] > far[:-1]))
        first = np.flatnonzero(new)
        both = np.empty(2 * first.size, np.int64)
        both[::2] = a[s:e][first]
        both[1::2] = far[np.concatenate((first[1:] - 1, [e - s - 1]))]
        out.append((int(row[s]), both))
    return out


def judge_chunk(docs: pa.Table, replies: pa.Table, k: int, n: int, shards: int) -> pa.Table:
    """Step 3, for a chunk: marks of pieces that come earlier as a whole, and the pieces left to sort, by shard."""
    if not docs.num_rows:
        return _table([], _FOUND)
    answers = replies.to_pylist()
    c = _Chunk(docs, answers, k, n)
    a = c.anchors
    by_hash, by_piece = c.buckets(n)
    split, earliest = np.zeros(c.dh.size, np.int64), np.zeros(c.uh.size, bool)
    told = {(r["kind"], r["bucket"]): r["a"] for r in answers}
    for b, i in by_hash:
        split[i] = np.frombuffer(told[1, b], np.uint16)
    for b, i in by_piece:
        earliest[i] = np.unpackbits(np.frombuffer(told[2, b], np.uint8), count=i.size).astype(bool)
    o = c.order
    doc = c.docs[a.row[o]]
    first = (doc == c.udoc[c.piece]) & (a.place[o] == c.uplace[c.piece]) & earliest[c.piece]
    later = o[~first]
    repeats = [(later, a.left[later], a.right[later])]
    # The first of each piece, of anchors with pieces that differ.
    at = np.flatnonzero(first)
    pieces = c.piece[at]
    ways = split[c.hash_of_piece[pieces]]
    one = ways == 1
    e, h = o[at[one]], c.uh[pieces[one]]
    cuts = [(e, a.left[e], a.right[e], h)]
    far = _step(k)
    for low, high, step in ((1, FAR_WAYS, far), (FAR_WAYS, NEAR_WAYS, max(1, far // 4)), (NEAR_WAYS, 1 << 16, 1)):
        some = (ways > low) & (ways <= high)
        if some.any():
            sent, again = _cut_about_places(a, c.docs, o[at[some]], c.uh[pieces[some]], k, step)
            cuts.append(sent)
            repeats.append(again)
    e, left, right = (np.concatenate(x) for x in zip(*repeats, strict=True))
    out = [(_MARK, c.chunk, int(c.rows[r]), _bytes(x), None) for r, x in _merged(a.row[e], left - a.start[a.row[e]], right - a.start[a.row[e]])]
    e, left, right, key = (np.concatenate(x) for x in zip(*cuts, strict=True))
    for s, i in _by_bucket(_home(_splitmix(key), shards), shards):
        row = a.row[e[i]]
        raw = b"".join(a.data[x:y].tobytes() for x, y in zip(left[i].tolist(), right[i].tolist(), strict=True))
        about = np.stack((right[i] - left[i], np.full(i.size, c.chunk), c.rows[row], c.docs[row], left[i] - a.start[row], a.place[e[i]] + a.start[row] - left[i], key[i].view(np.int64)))
        out.append((_PIECE, s, c.chunk, raw, _bytes(about.astype(np.int64))))
    return _table(out, _FOUND)


def _step(k: int) -> int:
    """Distance of the places about an anchor of which every string of ``k`` bytes that it stands for has one."""
    return max(1, (k - max(1, k // 3)) // 4)


def _gathered(data: np.ndarray, left: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of ``length`` from each ``left``, one after the other."""
    return data[np.arange(int(length.sum())) + np.repeat(left - (np.cumsum(length) - length), length)]


def _cut_about_places(a: Anchors, docs: np.ndarray, e: np.ndarray, h: np.ndarray, k: int, step: int):
    """Pieces of the anchors ``e`` with hashes ``h``, cut about places every ``step`` bytes before the anchor.

    A string of ``k`` bytes holds one of ``k - step + 1`` bytes that begins at one of these places; a cut has all strings
    that hold it, and its key is told by the anchor, the place and these bytes. Returns (anchor, from, to, key) of the
    cuts, and (anchor, from, to) of those equal to an earlier one in this chunk.
    """
    width = k - step + 1
    found = []
    for s in range(0, e.size, _CUT_AT_ONCE):
        some = e[s : s + _CUT_AT_ONCE]
        left, length = a.left[some], a.right[some] - a.left[some]
        begin = np.cumsum(length) - length
        anchor = a.place[some] + a.start[a.row[some]] - left
        values = _BYTE[_gathered(a.data, left, length)]
        sums, sums2 = _sums(values, _M1), _sums(values, _M2)
        for back in range(0, k - a.seed + 1, step):
            at = anchor - back
            low, high = np.maximum(at - step + 1, 0), np.minimum(at + k, length)
            i = np.flatnonzero((at >= 0) & (at + width <= length) & (high - low >= k))
            b, at, low, high = begin[i], at[i], low[i], high[i]
            place = np.uint64((back + 1) * _M1 & (1 << 64) - 1)
            key = _splitmix(h[s + i] ^ _splitmix(_run_hash(sums, _M1, b + at, b + at + width) + place))
            g = _run_hash(sums2, _M2, b + low, b + high) + (at - low).astype(np.uint64) * np.uint64(_M1) + (high - at).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
            found.append((some[i], left[i] + low, left[i] + high, key, _splitmix(g)))
    which, left, right, key, g = (np.concatenate(x) for x in zip(*found, strict=True))
    first = _firsts((key, g), docs[a.row[which]], left - a.start[a.row[which]])
    return (which[first], left[first], right[first], key[first]), (which[~first], left[~first], right[~first])


def _firsts(keys: tuple[np.ndarray, np.ndarray], doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which entries have the least document and place of those with the same two keys."""
    order = np.lexsort((place, doc, *keys))
    x, y, d, p = (v[order] for v in (*keys, doc, place))
    starts = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if x.size else np.zeros(0, np.int64)
    run = np.diff(np.concatenate((starts, [x.size])))
    out = np.empty(x.size, bool)
    out[order] = (d == np.repeat(d[starts], run)) & (p == np.repeat(p[starts], run))
    return out


def _shared_parts(joined: np.ndarray, length: np.ndarray, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each piece, from and to, that can share strings of ``k`` bytes with another piece.

    A string of ``k`` bytes that an anchor stands for begins at most ``k - k // 3`` bytes before it. With places every
    ``step`` bytes, it holds a string of ``k - step + 1`` bytes that begins at one of them. A piece that shares none of
    these has no such part; else the part spans the strings about the places that it shares.
    """
    reach, step = k - max(1, k // 3), _step(k)
    width = k - step + 1
    begin = np.cumsum(length) - length
    low, high = length.copy(), np.zeros(length.size, np.int64)
    sums = _sums(_BYTE[joined], _M1)
    for back in range(0, reach + 1, step):
        fits = np.flatnonzero((anchor >= back) & (anchor - back + width <= length))
        at = begin[fits] + anchor[fits] - back
        _, inverse, counts = np.unique(_run_hash(sums, _M1, at, at + width), return_inverse=True, return_counts=True)
        shared = fits[counts[inverse] > 1]
        low[shared] = np.minimum(low[shared], np.maximum(anchor[shared] - back - step + 1, 0))
        high[shared] = np.maximum(high[shared], np.minimum(anchor[shared] - back + k, length[shared]))
    return low, high


def sort_shard(sent: pa.Table, k: int, most_bytes: int = SORT_BYTES) -> pa.Table:
    """Step 4, for a shard: marks of strings that come earlier.

    A shard of more than ``most_bytes`` is sorted in parts by key, as pieces of different keys need not meet. If a part
    is still too large, it is sorted slice by slice, and the earliest strings of each class are compared by their hashes.
    """
    about = np.concatenate([np.frombuffer(x, np.int64).reshape(7, -1) for x in sent.column("b").to_pylist()], axis=1)
    joined = np.frombuffer(b"".join(sent.column("a").to_pylist()), np.uint8)
    begin = np.cumsum(about[0]) - about[0]
    found = []
    parts = max(1, -(-joined.size // most_bytes))
    for _, i in _by_bucket(((about[6].view(np.uint64) >> np.uint64(7)) % np.uint64(parts)).astype(np.int64), parts):
        length = about[0, i]
        whole = _gathered(joined, begin[i], length)
        low, high = _shared_parts(whole, length, about[5, i], k)
        kept = np.flatnonzero(high - low >= k)
        if not kept.size:
            continue
        size = (high - low)[kept]
        source = (np.cumsum(length) - length + low)[kept]
        place = about[4, i[kept]] + low[kept]
        total = int(size.sum())
        slices = -(-total // most_bytes) if total > 2 * most_bytes else 1
        heads = []
        for _, j in _by_bucket((np.cumsum(size) - size) * slices // total, slices):
            again, first = _sort_pieces(_gathered(whole, source[j], size[j]), size[j], about[1:4, i[kept[j]]], place[j], k, slices > 1)
            found.append(again)
            heads.append(first)
        if slices > 1:
            chunk, row, doc, at, f1, f2 = np.concatenate(heads, axis=1)
            late = ~_firsts((f1, f2), doc, at)
            found.append(np.stack((chunk[late], row[late], at[late])))
    out: list[tuple] = []
    if found:
        chunk, row, place = np.concatenate(found, axis=1)
        for ch in np.unique(chunk).tolist():
            i = chunk == ch
            out += [(_MARK, ch, r, _bytes(x), None) for r, x in _merged(row[i], place[i], place[i] + k)]
    return _table(out, _FOUND)


def _sort_pieces(joined: np.ndarray, length: np.ndarray, owner: np.ndarray, left: np.ndarray, k: int, with_heads: bool) -> tuple[np.ndarray, np.ndarray]:
    """(chunk, row, place) of strings that come earlier in these pieces, ``owner`` being their chunks, rows and documents,
    ``left`` their places in these; and (chunk, row, document, place, two hashes) of the earliest, if asked for."""
    chunk, row, doc = owner
    starts = np.cumsum(length + 1) - (length + 1)
    raw = np.zeros(int(length.sum()) + length.size + 16, np.uint8)
    raw[np.arange(joined.size) + np.repeat(np.arange(length.size), length)] = joined
    places, classes = repeated_windows(raw, starts, length, k)
    piece = np.searchsorted(starts, places, "right") - 1
    place = left[piece] + places - starts[piece]
    order = np.lexsort((place, doc[piece]))
    rank = np.empty(order.size, np.int64)
    d, p = doc[piece][order], place[order]
    rank[order] = np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]) | (p[1:] != p[:-1]))))
    heads = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
    again = rank > np.minimum.reduceat(rank, heads)[classes]
    of = lambda which: (chunk[piece[which]], row[piece[which]])
    marked = np.stack((*of(again), place[again]))
    if not with_heads:
        return marked, np.zeros((6, 0), np.int64)
    values, first = _BYTE[raw], ~again
    hashes = [_splitmix(_run_hash(_sums(values, base), base, places[first], places[first] + k)).view(np.int64) for base in (_M1, _M2)]
    return marked, np.stack((*of(first), doc[piece[first]], place[first], *hashes))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def apply_marks(docs: pa.Table, marks: pa.Table, with_text: bool) -> pa.Table:
    """Step 5, for a chunk: each document's removed runs, and what is left of it."""
    found: dict[int, list[np.ndarray]] = {}
    for r, x in zip(marks.column("src").to_pylist(), marks.column("a").to_pylist(), strict=True):
        found.setdefault(r, []).append(np.frombuffer(x, np.int64))
    out = []
    for doc_id, row, text in zip(docs.column("doc_id").to_pylist(), docs.column("row").to_pylist(), docs.column("text"), strict=True):
        raw = b"" if not text.is_valid else text.as_buffer().to_pybytes()
        n, removed, spans, kept = len(raw), 0, 0, raw
        if row in found:
            both = np.concatenate(found[row])
            (_, runs), = _merged(np.zeros(both.size // 2, np.int64), both[::2], both[1::2])
            cuts = runs.tolist()
            removed, spans = int((runs[1::2] - runs[::2]).sum()), runs.size // 2
            kept = b"".join(raw[x:y] for x, y in zip([0, *cuts[1::2]], [*cuts[::2], n], strict=True))
        out.append((doc_id, n, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
    return _table(out, _RESULT)


def _times(x: Column, k: int) -> Column:
    """The product of two unsigned 32-bit numbers modulo 2^32, without an overflow of the signed 64 bits that hold it."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)) * F.lit(k), F.shiftright(x, 16) * F.lit(k)
    return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def _turned(x: Column, right: int) -> Column:
    """An unsigned 32-bit number turned to the right."""
    return F.shiftright(x, right).bitwiseOR(F.shiftleft(x, 32 - right)).bitwiseAND(F.lit(0xFFFFFFFF))


def _hashed_to(number: Column) -> Column:
    """The int whose hash, by which rows go to partitions and buckets (32-bit Murmur 3, seed 42), is ``number``, from 0
    below 2^31. Steps read their input more than once, so each is a function over an array of one."""
    inverse = lambda k: pow(k, -1, 1 << 32)
    steps = [
        lambda h: h.bitwiseXOR(F.shiftright(h, 16)),
        lambda h: _times(h, inverse(0xC2B2AE35)),
        lambda h: h.bitwiseXOR(F.shiftright(h, 13)).bitwiseXOR(F.shiftright(h, 26)),
        lambda h: _times(h, inverse(0x85EBCA6B)),
        lambda h: h.bitwiseXOR(F.shiftright(h, 16)).bitwiseXOR(F.lit(4)),
        lambda h: (h + F.lit((1 << 32) - 0xE6546B64)).bitwiseAND(F.lit(0xFFFFFFFF)),
        lambda h: _times(h, inverse(5)),
        lambda h: _turned(h, 13).bitwiseXOR(F.lit(42)),
        lambda h: _times(h, inverse(0x1B873593)),
        lambda h: _turned(h, 15),
        lambda h: _times(h, inverse(0xCC9E2D51)),
        lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int"),
    ]
    out = F.array(number.cast("long"))
    for step in steps:
        out = F.transform(out, step)
    return F.element_at(out, 1)


def sizes(total: int, chunk_bytes: int) -> tuple[int, int, int]:
    """(chunks, buckets of the table, buckets of messages) for texts of ``total`` bytes.

    A bucket has about three chunks. Beyond ``MOST_CHUNKS`` chunks of ``chunk_bytes``, chunks grow, and beyond
    ``MOST_BUCKETS`` buckets a bucket has more chunks, as the writer keeps a count for each bucket. Chunks send each
    other a message per bucket of messages, so these are fewer than chunks where there are many.
    """
    n = max(1, -(-total // max(chunk_bytes, -(-total // MOST_CHUNKS))))
    return n, min(MOST_BUCKETS, max(1, -(-n // 3))), max(min(n, 64), -(-n // 8))


def _stored(docs: DataFrame, n_chunks: int, n_buckets: int) -> DataFrame:
    """``docs`` as a table bucketed by chunk in the shared folder; chunks are dealt to buckets in turn."""
    spark = docs.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_key"), F.monotonically_increasing_id().alias("row"), "text")
    # Equal ids with equal texts would meet in one chunk, so the row is part of the deal.
    rows = rows.withColumn("chunk", _hashed_to(F.pmod(F.xxhash64("doc_id", "row"), F.lit(n_chunks))))
    rows.repartition(n_buckets, "chunk").write.bucketBy(n_buckets, "chunk").option("path", path).option("compression", "zstd").saveAsTable(name)
    out = at_path(spark.table(name), path)
    # The catalog forgets the table at once, so that no name is left if the driver is lost; the plan keeps its files.
    spark.sql(f"drop table {name}")
    return out


def deduplicate(docs: DataFrame, k: int = K, chunk_bytes: int = CHUNK_BYTES, pieces_per_shard: int = PIECES_PER_SHARD, with_text: bool = False) -> DataFrame:
    """What is left of every document once repeated strings of ``k`` bytes (16 or more) are removed.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. Returns one row per row: ``doc_id, n_bytes,
    n_removed, n_spans`` (maximal removed runs), ``kept_sha256`` of the bytes left, joined, and with ``with_text`` those
    bytes as ``kept``.

    A null text is empty, and a document shorter than ``k`` bytes loses nothing. Rows that share an id share its place
    in the order: of two strings at one start in such rows neither is earlier. A null id comes after all others. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, buckets, m = sizes(total, chunk_bytes)
    stored = _stored(docs, n, buckets)
    # The rows of a task are what Arrow hands over at once; a chunk is one group.
    chunks = stored.groupBy("chunk")

    def step1(t: pa.Table) -> pa.Table:
        return send_hashes(t, k, m)

    replies1 = spool(chunks.applyInArrow(step1, _PACKED_SQL).groupBy("kind", "bucket").applyInArrow(repeated_hashes, _PACKED_SQL))

    def step2(t: pa.Table, r: pa.Table) -> pa.Table:
        return send_pieces(t, r, k, m)

    def compare(t: pa.Table) -> pa.Table:
        return compare_pieces(t, pieces_per_shard)

    replies2 = spool(chunks.cogroup(replies1.groupBy("chunk")).applyInArrow(step2, _PACKED_SQL).groupBy("kind", "bucket").applyInArrow(compare, _PACKED_SQL))
    shards = n

    def step3(t: pa.Table, r: pa.Table) -> pa.Table:
        return judge_chunk(t, r, k, m, shards)

    judged = spool(chunks.cogroup(replies1.unionByName(replies2).groupBy("chunk")).applyInArrow(step3, _FOUND_SQL))

    def step4(t: pa.Table) -> pa.Table:
        return sort_shard(t, k)

    sorted_ = spool(judged.where(f"kind = {_PIECE}").groupBy("key").applyInArrow(step4, _FOUND_SQL))
    marks = judged.where(f"kind = {_MARK}").unionByName(sorted_).select("key", "src", "a")

    def step5(t: pa.Table, m: pa.Table) -> pa.Table:
        return apply_marks(t, m, with_text)

    out = chunks.cogroup(marks.groupBy("key")).applyInArrow(step5, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
