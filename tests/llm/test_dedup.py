"""Near-duplicate operators against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtrace.llm import paragraphs, simhash, substrings
from loomtrace.llm.components import components
from loomtrace.llm.suffixes import repeated_windows, suffix_array


def roots(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    want = roots(500, edges)
    least = {}
    for i, r in enumerate(want):
        least.setdefault(r, i)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: least[want[i]] for e in edges for i in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = [w for w in bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("large", [64, 1])
def test_simhash_components(spark, monkeypatch, large):
    rng = random.Random(2)
    words = [f"W{i}" for i in range(50)]
    texts = [None, "", " \t", "One", "one two", "É é x"]
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(30, 200))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rows = [(i if i != 9 else None, t, "x") for i, t in enumerate(texts)]
    rows += rows[:3]
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    group = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    first = {}
    for r, (d, _, _) in zip(group, rows, strict=True):
        first[r] = min(x for x in (first.get(r), d) if x is not None) if d is not None or first.get(r) is not None else None
    monkeypatch.setattr(simhash.links, "__defaults__", (large,))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()
    want = sorted((str(d), f"{f:016x}", str(first[r])) for (d, _, _), f, r in zip(rows, fps, group, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_links_of_near_fingerprints(spark):
    """All pairs within two bits are joined, by pairs and by ball points alike."""
    rng = random.Random(4)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(6):
            fps.add(f)
            f ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    u = [f & (1 << 64) - 1 for f in fps]
    want = roots(len(u), [(i, j) for i in range(len(u)) for j in range(i) if (u[i] ^ u[j]).bit_count() <= 2])
    at = {f: i for i, f in enumerate(fps)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for large in (64, 1):
        pairs = [(at[r.a], at[r.b]) for r in simhash.links(df, large).collect()]
        assert all((u[a] ^ u[b]).bit_count() <= 2 for a, b in pairs)
        got = roots(len(u), pairs)
        assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_fingerprint_of_long_texts(spark, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices("aB \t\n", k=3000))
    want = plain_fingerprint(text)
    for block in (1, 7, 100, 1 << 22):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert simhash.fingerprint(text) == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each(spark, tmp_path):
    spark.createDataFrame([(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "other words here now")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    assert sorted(r.doc_id for r in simhash.one_of_each(spark.read.parquet(str(tmp_path / "d"))).collect()) == [1, 2]


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(100):
        t = np.concatenate((rng.integers(1, 4, rng.integers(1, 120)), [0])).tolist()
        assert suffix_array(np.array(t), 4).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_repeated_windows():
    pieces = [b"abababab" * 3, b"xabababababababy", b"q"]
    raw = b"".join(p + b"\0" for p in pieces) + bytes(16)
    lengths = np.array([len(p) for p in pieces])
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    places, classes = repeated_windows(np.frombuffer(raw, np.uint8), starts, lengths, 8)
    found = {}
    for p, c in zip(places.tolist(), classes.tolist(), strict=True):
        found.setdefault(c, set()).add(raw[p : p + 8])
    assert all(len(v) == 1 for v in found.values())
    assert len({next(iter(v)) for v in found.values()}) == len(found)
    assert places.size == sum(max(0, n - 7) for n in lengths)


def brute_substrings(rows, k):
    key = lambda d: (1 << 63) - 1 if d is None else d
    first, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - k + 1):
            first[b[i : i + k]] = min(first.get(b[i : i + k], (key(d), i)), (key(d), i))
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if (key(d), i) > first[b[i : i + k]]:
                gone[i : i + k] = b"\1" * k
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "per_shard", "most"), [(100, 4096, 1 << 20), (24, 3, 2000), (40, 4096, 500)])
def test_substrings(spark, monkeypatch, k, per_shard, most):
    monkeypatch.setattr(substrings.sort_shard, "__defaults__", (most,))
    rng = random.Random(k)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(rng.choices(words, k=rng.randint(10, 60))) for _ in range(8)]
    rows = []
    for d in range(60):
        t = " ".join(rng.choices(words, k=rng.randint(0, 80)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            t += rng.choice(["\n", " ", ""]) + p[a : a + rng.randint(20, len(p))] + " " + " ".join(rng.choices(words, k=rng.randint(0, 20)))
        rows.append((rng.choice([d, d, d, None]), t if rng.random() > 0.05 else None))
    rows += rows[:5] + [(500, "a" * 2000), (501, "ab" * 600), (3, "a" * 200), (502, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as kept")
    got = substrings.deduplicate(docs, k=k, chunk_bytes=6000, pieces_per_shard=per_shard).collect()
    assert sorted(map(tuple, got), key=str) == brute_substrings(rows, k)


def phrase_in_many_places():
    rng = random.Random(5)
    some = lambda n: "".join(rng.choices("abcd", k=n))
    phrase, tails = some(70), [some(60) for _ in range(12)]
    return [(i, some(90) + phrase + rng.choice([some(60), rng.choice(tails)[: rng.randint(20, 60)] + some(40)])) for i in range(150)]


def test_strings_of_hot_anchors_are_not_rows(spark, monkeypatch):
    """A phrase in very many different places: what is stored grows with documents, not with their strings."""
    stored = []
    monkeypatch.setattr(substrings, "spool", lambda df, spool=substrings.spool: stored.append(spool(df)) or stored[-1])
    rows = phrase_in_many_places()
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=6000, pieces_per_shard=4).collect()
    assert sorted(map(tuple, got), key=str) == brute_substrings(rows, substrings.K)
    assert 0 < max(df.count() for df in stored) < 10 * len(rows)


@pytest.mark.parametrize("most", [1 << 20, 3000])
@pytest.mark.parametrize(("ways", "used"), [((64, 1024), {16}), ((32, 1024), {16, 4}), ((1, 1024), {4}), ((1, 1), {1})])
def test_steps_with_places_near_and_far(monkeypatch, ways, used, most):
    """The steps in this process, where limits can be set: workers import the module anew."""
    import pyarrow as pa
    import pyarrow.compute as pc

    monkeypatch.setattr(substrings, "FAR_WAYS", ways[0], raising=False)
    monkeypatch.setattr(substrings, "NEAR_WAYS", ways[1], raising=False)
    steps = []
    if hasattr(substrings, "_cut_about_places"):
        cut = substrings._cut_about_places
        monkeypatch.setattr(substrings, "_cut_about_places", lambda *x: steps.append(x[-1]) or cut(*x))
    rows, n, k = phrase_in_many_places(), 5, substrings.K
    chunks = []
    for c in range(n):
        own = [(d, d, d, t, c) for d, t in rows if d % n == c]
        chunks.append(pa.table(dict(zip(("doc_id", "doc_key", "row", "text", "chunk"), map(list, zip(*own, strict=True)), strict=True))))
    by = lambda t, *keys: [t.filter(pc.and_(*[pc.equal(t[x], v) for x, v in zip(keys, key, strict=True)]) if len(keys) > 1 else pc.equal(t[keys[0]], key[0])) for key in sorted({tuple(r[x] for x in keys) for r in t.to_pylist()})]
    answers = pa.concat_tables([substrings.repeated_hashes(x) for x in by(pa.concat_tables([substrings.send_hashes(c, k, n) for c in chunks]), "kind", "bucket")])
    of = lambda t, c, key="chunk": t.filter(pc.equal(t[key], c))
    sent = pa.concat_tables([substrings.send_pieces(x, of(answers, c), k, n) for c, x in enumerate(chunks)])
    answers = pa.concat_tables([answers, *[substrings.compare_pieces(x, 4) for x in by(sent, "kind", "bucket")]])
    judged = pa.concat_tables([substrings.judge_chunk(x, of(answers, c), k, n, n) for c, x in enumerate(chunks)])
    marks = pa.concat_tables([of(judged, 0, "kind"), *[substrings.sort_shard(x, k, most) for x in by(of(judged, 1, "kind"), "key")]])
    got = [r for c, x in enumerate(chunks) for r in substrings.apply_marks(x, of(marks, c, "key"), False).drop_columns("kept").to_pylist()]
    assert sorted((tuple(r.values()) for r in got), key=str) == brute_substrings(rows, k)
    assert set(steps) == used


def test_substrings_of_empty_table(spark):
    assert substrings.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_documents_in_stretches():
    """A document longer than one stretch has the anchors that it has when hashed whole."""
    import pyarrow as pa

    rng = random.Random(6)
    texts = pa.array(["".join(rng.choices("abc d", k=5000)), None, "short", "".join(rng.choices("xy", k=900))])
    whole, parts = substrings.Anchors(texts), substrings.Anchors(texts, step=700)
    as_set = lambda a: set(zip(a.row.tolist(), a.place.tolist(), a.h.tolist(), a.g.tolist(), strict=True))
    assert as_set(whole) == as_set(parts)


def test_paragraphs(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]

    def sentence(n):
        w = rng.choices(vocabulary, k=n)
        return " ".join(w[:-1] + [w[-1] + "."])

    base = [sentence(rng.randint(10, 40)) for _ in range(12)]
    rows = []
    for d in range(100):
        lines = []
        for _ in range(rng.randint(0, 4)):
            u = rng.random()
            if u < 0.35:
                lines.append(rng.choice(base))
            elif u < 0.7:
                w = rng.choice(base).split()
                w[rng.choice([0, -1, len(w) // 2])] = rng.choice(vocabulary)
                lines.append(" ".join(w))
            elif u < 0.8:
                lines.append(sentence(25) + " " + rng.choice(base) + " " + sentence(12))
            else:
                lines.append(sentence(rng.randint(3, 60)))
        rows.append((d, "\n".join(lines)))
    rows += [(None, base[0]), (7, base[1]), (500, None), (501, "")]
    found = []
    for r, (d, t) in enumerate(rows):
        for line, part, ws in paragraphs.paragraphs(t):
            found.append((d, r, line, part, frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))))
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    group = roots(len(found), [(i, j) for i in range(len(found)) for j in range(i) if near(found[i][4], found[j][4])])
    want = set()
    for g in set(group):
        members = [f for f, x in zip(found, group, strict=True) if x == g]
        if len({m[1] for m in members}) > 1:
            head = min(members, key=lambda m: (m[0] is None, m[0] or 0, *m[1:4]))
            want |= {(m[0], m[2], m[3], head[0], m != head) for m in members}
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for direct, block in ((64, 512), (2, 3)):
        monkeypatch.setattr(paragraphs.links, "__defaults__", (0.8, direct, block))
        got = paragraphs.repeated(docs, chunk_bytes=9000).collect()
        assert {(r.doc_id, r.paragraph, r.part, r.first_doc_id, r.removed) for r in got} == want
    assert paragraphs.repeated(docs.limit(0)).count() == 0


def test_stored_texts_leave_before_the_result(spark):
    """Texts, messages and shingles are out of the shared folder before rows are read; reading twice is safe."""
    from pathlib import Path

    from loomtrace.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    stored = lambda: {p.name for p in folder.iterdir() if p.name.startswith(("chunks_", "spool-"))}
    before = stored()
    docs = spark.createDataFrame([(i, f"one two three four five six seven {i // 2}") for i in range(20)], "doc_id long, text string")
    out = paragraphs.repeated(docs, across=True)
    assert len(stored() - before) == 1
    assert sorted(out.collect()) == sorted(out.collect()) and {r.doc_id for r in out.collect() if r.part != paragraphs.ACROSS} == set(range(20))


def test_short_lines_are_compared(spark):
    """Lines of five to nine words, and passages wrapped at fewer than five words a line."""
    poem = "\n".join(f"p{i} q{i} r{i}" for i in range(20))
    rows = [(1, "one line of five words\nown words of this document only"), (2, "other words that stand before here\nOne line of five words"), (3, f"a b c d e f\n{poem}"), (4, f"{poem}\ng h i j k l")]
    got = paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.paragraph, r.removed) for r in got if r.doc_id < 3 and r.part >= 0} == {(1, 0, False), (2, 1, True)}
    assert any(r.doc_id == 4 and r.removed and r.first_doc_id == 3 for r in got)


def test_short_sentences_make_paragraphs():
    """No joined sentences of a long line are lost when a hash ends them."""
    rng = random.Random(12)
    for _ in range(50):
        line = " ".join(" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randint(5, 9))) + "." for _ in range(12))
        assert [w for _, _, ws in paragraphs.paragraphs(line) for w in ws] == line.encode().split()


def test_stretches():
    """Every word is in a stretch, and any shared run of 50 words holds one whole stretch in both texts."""
    rng = random.Random(13)
    make = lambda n: [b"w%d" % rng.randrange(300) for _ in range(n)]
    texts = []
    for _ in range(200):
        run = make(50)
        texts += [make(rng.randint(0, 90)) + run + make(rng.randint(0, 90)) for _ in range(2)]
    texts += [make(n) for n in (0, 4, 5, 24, 25, 26, 27, 28)] + [[b"a"] * 400]
    row, begin, size, h = paragraphs.stretches(texts)
    found = [set() for _ in texts]
    covered = [set() for _ in texts]
    for r, b, n, x in zip(row.tolist(), begin.tolist(), size.tolist(), h.tolist(), strict=True):
        found[r].add((x, tuple(texts[r][b : b + n])))
        covered[r].update(range(b, b + n))
    assert all(len(c) == len(t) or len(t) < 5 for c, t in zip(covered, texts, strict=True))
    assert all(found[i] & found[i + 1] for i in range(0, 400, 2))
    assert len(found[-1]) == 1 and np.sum(row == len(texts) - 1) <= 17


def test_passage_inside_paragraphs(spark):
    """A passage that begins and ends inside sentences and is wrapped in another way, without any punctuation."""
    rng = random.Random(14)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage = make(52)
    one = " ".join(make(70) + passage + make(60))
    other = make(33) + passage + make(41)
    rows = [(1, one), (2, "\n".join(" ".join(other[i : i + 7]) for i in range(0, len(other), 7))), (3, " ".join(make(90)))]
    got = paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string"), across=True).collect()
    assert {(r.doc_id, r.first_doc_id, r.removed) for r in got} == {(1, 1, False), (2, 1, True)}
    assert all(r.part == paragraphs.ACROSS and r.n_words == 25 for r in got)
    assert all(33 <= r.begin <= 33 + 52 - 25 and r.paragraph == r.begin // 7 for r in got if r.doc_id == 2)


def test_repetition_inside_a_document(spark):
    line = "a line of eight words that comes again"
    rows = [(1, f"{line}\nsome other words in between them\n{line.upper()}\n{line}"), (2, "this document says everything only once, here"), (3, "la " * 60)]
    got = paragraphs.repeated(spark.createDataFrame(rows, "doc_id long, text string"), across=True).collect()
    assert not any(r.across_documents for r in got)
    assert sorted((r.paragraph, r.removed) for r in got if r.doc_id == 1) == [(0, False), (2, True), (3, True)]
    assert not any(r.doc_id == 2 for r in got)
    assert sorted((r.begin, r.removed) for r in got if r.doc_id == 3 and r.part == paragraphs.ACROSS) == [(0, False), (25, True)]


def test_clashing_columns_and_a_very_long_line(spark):
    """Other columns are not read; of a line of many thousand words repeated in another document, all but one goes."""
    rng = random.Random(20)
    line = " ".join(f"w{rng.randrange(30_000)}" for _ in range(20_000))
    rows = [(1, line, "x", 1, True), (2, f"own words before it {line} and after it", "y", 2, False), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cluster string, row int, removed boolean")
    got = paragraphs.repeated(docs, across=True).collect()
    assert {r.doc_id for r in got if r.n_removed} == {2} and {r.first_doc_id for r in got} == {1}
    assert all((r.n_removed > 0) == r.removed and r.n_removed in (0, r.n_words) for r in got)
    covered = {w for r in got if r.removed and r.part == paragraphs.ACROSS for w in range(r.begin, r.begin + r.n_words)}
    assert len(covered & set(range(4, 20_004))) > 19_900


def test_bands_miss_few_pairs():
    """A pair at the threshold is missed at most once in 3,000."""
    assert (1 - paragraphs.SIMILARITY**paragraphs.ROWS) ** paragraphs.BANDS < 1 / 3000


def test_large_entries_leave_before_pairs_are_made(spark):
    """In the optimised plan no anti-join stands above the join of probes and table."""
    fps = spark.range(500).select((F.col("id") * 7919).alias("fp"))
    plan = simhash.links(fps)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    inner = [depth(x) for x in plan if "Join Inner" in x and "value#" in x]
    anti = [depth(x) for x in plan if "Join LeftAnti" in x]
    assert len(anti) == 2 and inner and min(anti) > min(inner)


def test_sizes_at_scale():
    """Counts of buckets and messages stay within what the writer and a shuffle can hold."""
    n, buckets, messages = substrings.sizes(100 << 40, substrings.CHUNK_BYTES)
    assert n <= substrings.MOST_CHUNKS and buckets <= 100_000 and messages <= n // 8 + 1
    assert substrings.sizes(0, 8) == (1, 1, 1) and substrings.sizes(100, 8)[0] == 13


def test_chunks_are_dealt_evenly(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    stored = substrings._stored(docs, 31, 10)
    per = stored.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("chunk").alias("n")).collect()
    assert sorted(r.n for r in per) == [3] * 9 + [4] and stored.select("chunk").distinct().count() == 31
    assert "Exchange" not in stored.groupBy("chunk").count()._jdf.queryExecution().executedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("chunks_")]


def test_several_chunks_in_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_BUCKETS", 2)
    rows = [(i, "".join(random.Random(i // 2).choices("abc", k=300))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substrings.deduplicate(docs, chunk_bytes=500).collect()}
    assert got == {i: 300 * (i % 2) for i in range(40)}


@pytest.mark.parametrize("kind", ["alike", "chain", "phrase"])
def test_hot_bands_against_brute_force(spark, kind):
    """Very many paragraphs under one band hash: all alike, a chain of neighbours, or with one phrase in common."""
    rng = random.Random(kind)
    base = list(range(60))
    sets = []
    for i in range(150):
        if kind == "alike":
            x = [v + 1000 * (rng.random() < 0.06) * rng.randint(1, 9) for v in base]
        elif kind == "chain":
            x = list(range(i // 2, i // 2 + 40))
        else:
            x = base[:5] + [1000 * (i // 3) + v for v in range(20)] + [10**6 + i]
        sets.append(sorted(set(x)))
    units = spark.createDataFrame([(b"%03d" % i, x, [1]) for i, x in enumerate(sets)], "uid binary, shingles array<bigint>, bands array<bigint>")
    near = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))
    want = roots(150, [(i, j) for i in range(150) for j in range(i) if near(sets[i], sets[j])])
    for direct, block in ((64, 512), (8, 16)):
        pairs = [(int(r.a), int(r.b)) for r in paragraphs.links(units, 0.8, direct, block).collect()]
        got = roots(150, pairs)
        groups = lambda g: {frozenset(i for i in range(150) if g[i] == x) for x in set(g)}
        assert groups(got) == groups(want)
