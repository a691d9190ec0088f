"""The corpus pipeline against a plain version of each stage."""

import corpus_pipeline
from loomtrace.llm import decontam, langid, mixing, simhash
from loomtrace.llm.common import spool, table

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "mixture", "shards"]

    kept = spool(corpus_pipeline.language(spark, docs, DIR))
    filters = langid.learn(docs.where(~langid.held_out()))
    judged = [(r, langid.predict(r[1], filters)) for r in rows]
    want = [r for r, (lang, score) in judged if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE]
    assert kept.columns == columns and sorted(map(tuple, kept.collect())) == sorted(want) and len(want) > 150

    single = spool(corpus_pipeline.near_duplicates(spark, kept, DIR))
    fps = {r[0]: simhash.fingerprint(r[1]) for r in want}
    group = {d: d for d in fps}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    assert sorted(r.doc_id for r in single.collect()) == sorted({root(d) for d in ids})

    clean = spool(corpus_pipeline.decontamination(spark, single, DIR))
    items = decontam.Items([tuple(r) for r in table(spark, DIR, "benchmark").select("item_id", "text").collect()])
    want = {r.doc_id for r in single.collect() if all(c < 0.5 for _, c, _, _ in items.coverages(r.text))}
    assert {r.doc_id for r in clean.collect()} == want < {r.doc_id for r in single.collect()}

    mixed = spool(corpus_pipeline.mixture(spark, clean, DIR))
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in copies.items() if n} and mixed.columns == columns

    last = corpus_pipeline.shards(spark, mixed, DIR)
    assert last.columns == [*columns, "shard", "slot"]
    sizes = {}
    for r in last.collect():
        sizes.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, sizes.values())) == mixed.count()
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())


def plain_mix(rows):
    """Copies of each (doc_id, source, size, u) by the plain rule, source by source."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    own = {s: sum(r[2] for r in by[s]) for s in names}
    target, left, free = {}, sum(own.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * own[s]}
        target |= {s: level * weight[s] for s in free - full}
        if not full:
            break
        for s in full:
            target[s] = 3 * own[s]
            left -= 3 * own[s]
        free -= full
        if not free:
            break
    copies = {}
    for s in names:
        whole = int(target[s] // own[s]) if own[s] else 0
        rest, upto, extra = target[s] - whole * own[s], 0, {}
        for d, _, size, u in sorted(by[s], key=lambda r: r[3]):
            extra[d] = int(rest > 0 and 2 * upto + size < 2 * rest)
            upto += size
        gap = rest - sum(size * extra[d] for d, _, size, _ in by[s])
        moves = [(abs(abs(gap) - size), u, d) for d, _, size, u in by[s] if extra[d] == (gap <= 0) and abs(abs(gap) - size) < abs(gap)]
        if moves and rest > 0:
            extra[min(moves)[2]] ^= 1
        copies |= {d: whole + extra[d] for d in extra}
    return copies


def test_mixture_against_a_plain_version(spark):
    import hashlib
    import re

    docs = table(spark, DIR, "documents")
    rows = []
    for d, text, source in docs.select("doc_id", "text", "source").collect():
        digest = hashlib.md5(f"mix-1|{d}|{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()
        rows.append((d, source, len(re.findall(r"[^\x20\x09-\x0D]+", text)), (int(digest[:12], 16) + 0.5) / 2**48))
    want = {d: n for d, n in plain_mix(rows).items() if n}
    got = {r["doc_id"]: r["count"] for r in corpus_pipeline.mixture(spark, spool(docs), DIR).groupBy("doc_id").count().collect()}
    zero = {r[0] for r in rows if r[2] == 0}
    assert {d: n for d, n in got.items() if d not in zero} == {d: n for d, n in want.items() if d not in zero}


def test_decontamination_against_a_plain_version(spark):
    """All documents of the smallest table, with coverage by a tiling that looks at every match."""
    docs, bench = table(spark, DIR, "documents"), table(spark, DIR, "benchmark")
    items = [decontam.words(r.text) for r in bench.collect()]
    want = set()
    for r in docs.collect():
        ws = decontam.words(r.text)
        grams = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
        for item in items:
            seeds = [i for i in range(len(item) - 4) if tuple(item[i : i + 5]) in grams]
            covered = {i + k for i in seeds for k in range(5)}
            if len(covered) >= 0.5 * len(item):  # no tiling covers more; planted passages stand whole
                want.add(r.doc_id)
    kept = {r.doc_id for r in corpus_pipeline.decontamination(spark, spool(docs), DIR).collect()}
    assert {r.doc_id for r in docs.collect()} - kept <= want
    whole = {r.doc_id for r in docs.collect() for item in items if b" ".join(item) in b" ".join(decontam.words(r.text))}
    assert whole and not whole & kept


ODD = "doc_id long, text string, lang string, source string, n_chars long, __lang string, __row string, __text int, __copies int, __judged int"


def test_odd_tables(spark):
    """Nulls in every column, repeated rows, texts empty and long, clashing names; and a table without rows."""
    names = table(spark, DIR, "documents").columns
    few = table(spark, DIR, "documents").limit(30).selectExpr("doc_id", "text", "lang", "source", "cast(n_chars as long) as n_chars", "'x' as __lang", "'y' as __row", "1 as __text", "2 as __copies", "cast(null as int) as __judged")
    odd = spark.createDataFrame([(None,) * 10, (None,) * 10, (7, "", None, None, None, None, None, None, None, None), (7, "the " * 200_000, "en", None, 5, "a", "b", 3, 4, 5)], ODD)
    docs = spool(few.unionByName(odd))
    for name, stage in corpus_pipeline.STAGES:
        kept = spool(stage(spark, docs, DIR))
        assert kept.columns == docs.columns + ["shard", "slot"] * (name == "shards") and kept.count() > 0
        assert spool(stage(spark, docs.limit(0), DIR)).count() == 0
        docs = kept
    assert set(names) <= set(docs.columns)


def test_run(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() > 0 and {"shard", "slot"} <= set(out.columns)
    assert corpus_pipeline.ORACLE_SQL is None


def test_short_texts_are_kept(spark):
    """Texts too short for evidence stay; those without letters go, and long ones in no known language."""
    docs = table(spark, DIR, "documents")
    short = [(-1, "Re."), (-2, "A."), (-3, "É"), (-4, "12 !"), (-5, None), (-6, "xqzjv wkqxj zvqkw " * 20)]
    extra = spark.createDataFrame(short, "doc_id long, text string")
    more = spool(docs.unionByName(extra, allowMissingColumns=True))
    kept = corpus_pipeline.language(spark, more, DIR)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.where("doc_id < 0").collect()} == {-1, -2, -3}
