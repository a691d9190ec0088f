"""Scores, languages, pages and tiles."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import decontam, html, langid, topk, toxicity

BAD = ["idiot", "moron", "scum", "loser", "clown", "worthless", "pathetic"]


def prose(rng, n, extra=()):
    parts = ["the", "an", "er", "on", "re", "th", "nd", "ing", "ea", "ou", "st", "ly"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n)]
    for w in extra:
        words.insert(rng.randrange(len(words)), w)
    return " ".join(words)


@pytest.fixture(scope="module")
def scorer(spark):
    rng = random.Random(1)
    docs = [(i, prose(rng, 60, rng.sample(BAD, 3) if i % 4 == 0 else ())) for i in range(600)] + [(None, "idiot"), (9000, None)]
    labels = [(i, int(i % 4 == 0), None) for i in range(600)] + [(None, 1, None), (9000, None, 1)]
    return toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))


FORMS = {
    "plain": str,
    "upper": str.upper,
    "leet": lambda w: w.translate(str.maketrans("ioeast", "103457")),
    "signs": lambda w: w.translate(str.maketrans("ioeast", "!03@$+")),
    "spaced": " ".join,
    "dotted": ".".join,
    "repeated": lambda w: w[:2] + w[2] * 4 + w[3:],
    "doubled": lambda w: "".join(2 * c for c in w),
    "spaced leet": lambda w: " ".join(w.translate(str.maketrans("ioeast", "103457"))),
}


@pytest.mark.parametrize("form", FORMS)
def test_hidden_words_are_found(scorer, form):
    rng = random.Random(2)
    hits = sum(scorer.score(prose(rng, 50, [FORMS[form](w)]), {}, {}) >= 0.5 for w in BAD)
    assert hits >= len(BAD) - 1


@pytest.mark.parametrize("form", ["i    d    i    o    t", "id iot", "idi ot", "idi.ot", "i-diot", "m o\nr o\nn", "mor on", "pat he tic"])
def test_spacing_of_any_kind(scorer, form):
    assert scorer.score(prose(random.Random(17), 50, [form]), {}, {}) >= 0.5


def test_equal_texts_with_other_labels(spark):
    """Of the labels of one text the greatest counts, whatever the order of rows."""
    rng = random.Random(19)
    docs = [(i, prose(rng, 30, ["scum"] if i % 3 == 0 else ())) for i in range(300)]
    docs += [(1000 + i, t) for i, t in docs]
    labels = [(i, int(i % 3 == 0)) for i in range(300)] + [(1000 + i, 0) for i in range(300)]
    make = lambda d: toxicity.learn(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    one, two = make(docs), make(docs[::-1])
    assert one.weights == two.weights and (one.curve == two.curve).all() and b"scum" in one.weights


def test_clean_and_odd_texts(scorer):
    rng = random.Random(3)
    clean = [prose(rng, 80) + " the&&& THE!! a$$$ of%%% 108.51.216.133 mail.7@a.example version 3." for _ in range(40)]
    assert sum(scorer.score(t, {}, {}) >= 0.5 for t in clean) == 0
    for odd in (None, "", " ", "!!!", "a a a a a a", "1 2 3 4", "é" * 5000, "x" * 100_000, "i d i o t"):
        assert 0 <= scorer.score(odd, {}, {}) <= 1
    assert scorer.score("i d i o t", {}, {}) >= 0.5


def test_score_frame(spark, scorer):
    docs = spark.createDataFrame([(1, "you idiot", 0.0), (1, "you idiot", 0.0), (None, None, None)], "doc_id long, text string, score double")
    got = toxicity.score(docs, scorer).collect()
    assert len(got) == 3 and [r.score >= 0.5 for r in got] == [True, True, False]
    assert toxicity.score(docs.limit(0), scorer).count() == 0


def test_model_counts_every_document(spark):
    docs = spark.createDataFrame([("ab",)] * 3 + [(None,), ("",)], "text string")
    model = toxicity.language_model(docs).reshape((32,) * 4)
    assert model[0, 0, 0, 1] < model[0, 0, 0, 2] and model[0, 0, 1, 2] < model[0, 0, 1, 1]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 <= none.score("a b", {}, {}) <= 1


def test_languages(spark):
    rng = random.Random(4)
    parts = {"en": ["the", "ing", "ou"], "de": ["sch", "ung", "ein"], "fr": ["eau", "ié", "ou"]}
    make = lambda lang: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 40)))
    rows = [(i, make(lang := rng.choice(sorted(parts))), lang, lang) for i in range(300)]
    rows += [(1000, None, "en", ""), (1001, "", None, ""), (1002, "12 34 !", "en", ""), (None, "the ing", "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    filters = langid.learn(docs.where(~langid.held_out()))
    got = langid.identify(docs, filters).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}
    held = [r for r in langid.identify(docs, filters).where(langid.held_out()).collect() if r.doc_id is not None and r.doc_id < 1000]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(docs.limit(0), filters).count() == 0
    nothing = langid.learn(docs.limit(0))
    assert langid.predict("the", nothing) == ("und", 0.0)
    assert 0 <= langid.predict("the " * 400_000, filters)[1] <= 1


def test_false_positives_are_taken_out():
    """Corrected shares of grams that no filter holds are near 0 although the filters are well filled."""
    rng = np.random.default_rng(5)
    filters = langid.build({"a": rng.integers(0, 2**64, 400_000, dtype=np.uint64), "b": rng.integers(0, 2**64, 400_000, dtype=np.uint64)})
    text = "".join(chr(97 + x) for x in rng.integers(0, 26, 20_000))
    assert filters.false_rate[0] > 0.01 and filters.shares(text).max() < 0.01


def test_any_number_of_languages():
    rng = np.random.default_rng(6)
    texts = {f"l{i:02}": "".join(chr(97 + x) for x in rng.integers(0, 26, 3000)) for i in range(70)}
    grams = {k: np.unique(langid.gram_hashes(np.frombuffer(langid.folded(t), np.uint8))) for k, t in texts.items()}
    filters = langid.build(grams)
    assert filters.tables[0].shape[1] == 2 and len(filters.languages) == 70
    assert all(langid.predict(t[500:1500], filters)[0] == k for k, t in texts.items())


def test_filters_against_exact_sets(spark):
    """Corrected shares are near those of exact sets of n-grams, and the same language wins."""
    rng = random.Random(15)
    parts = {"en": ["the", "ing", "ou", "ly"], "de": ["sch", "ung", "ein", "ou"], "fr": ["eau", "ié", "ou", "ing"]}
    make = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(n))
    rows = [(make(lang, rng.randint(3, 60)), lang) for lang in parts for _ in range(100)]
    filters = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    grams = lambda t: [b[i : i + langid.N] for b in [langid.folded(t)] for i in range(len(b) - langid.N + 1)]
    counts = {lang: {} for lang in parts}
    for t, lang in dict(rows).items():
        for g in set(grams(t)):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    for lang in parts:
        for n in (2, 20, 200):
            t = make(lang, n)
            exact = {k: sum(c.get(g, 0) >= 2 for g in grams(t)) / max(1, len(grams(t))) for k, c in counts.items()}
            assert np.allclose(filters.shares(t), [exact[k] for k in filters.languages], atol=0.05)
            if len([k for k in exact if exact[k] > max(exact.values()) - 0.1]) == 1:
                assert langid.predict(t, filters)[0] == max(exact, key=exact.get)


def test_least_hashes(spark):
    rng = random.Random(16)
    rows = [(lang, rng.randrange(-(2**63), 2**63)) for lang in ("a", "b") for _ in range(3000)]
    rows += [("c", h) for h in range(5)] + rows[:500]
    got = langid._least_hashes(spark.createDataFrame(rows, "lang string, h long").repartition(7), 20).collect()
    assert len(got) == 45
    for lang in "abc":
        assert {r.h for r in got if r.lang == lang} == set(sorted({h for x, h in rows if x == lang})[:20])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Home</a> Site name</header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies. Accept?</div>
<div id=main><article><h1>Title &amp; more</h1><p>First   <b>bo</b>ld &lt;x&gt; line.<br>Second line of text that goes on for a while.<p>Another paragraph, which is long enough to be read as content by itself.
<aside class="ad">Buy this now!</aside><form><input><label>Mail</label><button>Go</button></form><p>Last paragraph of the article, with a <a href=/l>link</a> in it.</p></article>
<section id="comments"><h2>Comments</h2><p>I think this is a great article, thank you for writing it.</p></section></div>
<div class="sidebar"><p>Related stories and other things that you may like to read.</p></div><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Title & more First bold <x> line. Second line of text that goes on for a while. Another paragraph, which is long enough to be read as content by itself. Last paragraph of the article, with a link in it."
    plain = "<body><div class=menu><a>x</a></div><div class='post-body'><p>Some words of an article that has no article element at all.</p><p>And more words in a second paragraph.</p></div><div class=footer>Imprint</div>"
    assert html.main_text(plain) == "Some words of an article that has no article element at all. And more words in a second paragraph."
    for odd in (None, "", "<", "<p", "<script>x", "<!-- x", "</p></div>", "<div>" * 5000, "text only, without any mark-up, is a page of its own.", "<a href='x>y"):
        assert isinstance(html.main_text(odd), str)
    assert html.main_text("<article><p>Cut off in the middle of a par").startswith("Cut off")


ARTICLE = "<article><h1>Title</h1><p>Some words of an article that go on for quite a while, with an end.</p><p>And more words in a second paragraph, which is about as long as the first.</p></article>"
READ = "Title Some words of an article that go on for quite a while, with an end. And more words in a second paragraph, which is about as long as the first."


@pytest.mark.parametrize("page", ['<body class="no-sidebar">{}</body>', '<body class="single has-comments">{}</body>', '<html class="js no-menu"><body id="sidebar-right" style="visibility:hidden">{}</body></html>', '<div id="page" class="with-sidebar">{}</div>', '<div class="post tag-social category-ads comments-open">{}</div>', '<div class="sidebar-layout"><main>{}</main></div>', '<div class="row sidebar-right"><div>{}</div></div>'])
def test_names_of_the_whole_page(page):
    around = '<nav class="menu"><a href=/>Home</a> <a href=/b>More</a></nav>{}<div class="sidebar"><p>Related things that you may like to read one day.</p></div><div class="comments"><p>A reader wrote that the article is good.</p></div>'
    assert html.main_text(page.format(around.format(ARTICLE))) == READ or "-layout" in page and html.main_text(page.format(ARTICLE)) == READ


def test_a_page_of_very_many_blocks():
    page = "<body><div class=menu>" + "<p><a href=/x>link</a></p>" * 2000 + "</div>" + "<p>A sentence that is read as part of the text, as it is long enough.</p>" * 5000 + "</body>"
    text = html.main_text(page)
    assert text.count("A sentence") == 5000 and "link" not in text


def test_minimum_cut_against_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randint(1, 8)
        arcs = [(n, i, rng.randint(0, 9), 0) for i in range(n)] + [(i, n + 1, rng.randint(0, 9), 0) for i in range(n)]
        arcs += [(i, j, w, w) for i in range(n) for j in range(i) if rng.random() < 0.5 for w in [rng.randint(0, 5)]]
        flow = html.Flow(n + 2)
        for a in arcs:
            flow.arc(*a)
        side = flow.cut(n, n + 1)
        cost = lambda inside: sum((c if inside[a] and not inside[b] else 0) + (r if inside[b] and not inside[a] else 0) for a, b, c, r in arcs)
        least = min(cost([bool(m >> i & 1) for i in range(n)] + [True, False]) for m in range(1 << n))
        assert side[n] and not side[n + 1] and cost(side) == least


def test_extract_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got[1].startswith("Title") and got[2] == ""
    assert html.extract(pages.limit(0)).count() == 0


def brute_tiles(p, t, least):
    """Greedy tiling that looks at all matches each time."""
    fp, ft, out = [True] * len(p), [True] * len(t), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and fp[i + k] and ft[j + k] and p[i + k] == t[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        out.append((i, j, k))
        fp[i : i + k] = ft[j : j + k] = [False] * k


def as_hashes(seq):
    return np.array(seq, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)


@pytest.mark.parametrize(("symbols", "rounds"), [(2, 400), (3, 200), (6, 200)])
def test_tiles_against_brute_force(symbols, rounds):
    """Whole tilings, on alphabets so small that matches overlap in many ways."""
    rng = random.Random(symbols)
    for _ in range(rounds):
        p, t = rng.choices(range(symbols), k=rng.randint(0, 25)), rng.choices(range(symbols), k=rng.randint(0, 40))
        assert decontam.tile(as_hashes(p), as_hashes(t), 3) == brute_tiles(p, t, 3)
    blocked = np.zeros(11, bool)
    blocked[5] = True
    assert decontam.tile(as_hashes(range(10)), as_hashes([*range(5, 10), 99, *range(5)]), 5, blocked) == [(0, 6, 5), (5, 0, 5)]


def test_coverage_against_brute_force():
    """Coverage of items by whole documents, without the shortcuts by seeds."""
    rng = random.Random(18)
    for _ in range(150):
        item, doc = ([f"w{c}" for c in rng.choices(range(3), k=rng.randint(5, 30))] for _ in range(2))
        doc = doc + item[3:12] + [f"w{c}" for c in rng.choices(range(3), k=rng.randint(0, 30))]
        covered = sum(k for _, _, k in brute_tiles(item, doc, decontam.MIN_MATCH))
        items = decontam.Items([("k", " ".join(item))])
        got = items.coverages(" ".join(doc))
        assert [w for _, _, _, w in got] == ([covered] if covered else [])
        for least in (0.3, 0.5, 1.0):
            assert bool(items.coverages(" ".join(doc), least)) == (covered >= least * len(item) and covered > 0)


def test_a_phrase_said_very_often():
    phrase = "one two three four five six"
    items = decontam.Items([("k", phrase + " seven eight nine ten eleven twelve"), ("s", "one two")])
    (got,) = items.coverages(f"{phrase} and " * 200_000)
    assert got == (0, 0.5, 1, 6)
    (got,) = items.coverages("one two " * 100_000 + phrase)
    assert got[1:] == (0.5, 1, 6)
    assert items.coverages("One, two!") == [(1, 1.0, 1, 2)] and not items.coverages("one two three")


def test_decontamination(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(20)] + [(20, None), (21, ""), (22, "just four words here"), (None, "eins zwei drei vier fuenf sechs")]
    docs = []
    for i in range(40):
        text = rng.choices(words, k=100)
        if i < 20:
            own = items[i][1].split()
            half = own[15:] + rng.choices(words, k=5) + own[:15]  # in another order
            text[50:50] = half if i % 2 else own
        docs.append((i, " ".join(text).upper() if i % 3 else ", ".join(text), i))
    docs += [(100, None, 0), (101, "", 0), (102, "Just four, words here!", 0), (103, "x just four words here", 0), (None, "eins zwei drei vier fuenf sechs", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    items += [(50, items[0][1])] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, i) for i in range(20)} | {(102, 22), (None, None), (0, 50)}
    for block in (1 << 20, 500):
        got = decontam.matches(frame, bench, block_bytes=block).collect()
        assert len(got) == len(want) + 1 and {(r.doc_id, r.item_id) for r in got} == want and all(0.5 <= r.coverage <= 1 for r in got)
    assert {r.doc_id for r in decontam.clean(frame, bench).collect()} == {*range(20, 40), 100, 101, 103}
    assert decontam.matches(frame.limit(0), bench).count() == 0
    assert decontam.clean(frame, bench.limit(0)).count() == len(docs)


def test_hash_of_long_words():
    h = decontam.word_hashes([b"a" * 300_000, b"b", b"a" * 300_000])
    assert h[0] == h[2] != h[1] == decontam.word_hashes([b"b"])[0]


def test_top_k(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(0, 0.3, (260, 6)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(250)] + [(300, None), (301, [1.0, None, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [0.1] * 6), (350, [0.5, 0.5]), (250, [0.0] * 6), (251, x[0].tolist())]
    vectors = spark.createDataFrame([(i, v, None) for i, v in rows], "vec_id long, embedding array<float>, label int")
    fine = {i: np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, 6 - len(v)))).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in fine if i % 50 == 0):
        best = sorted((-int(fine[q] @ fine[c]), c) for c in fine if c != q)[:5]
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    every = topk.scaled(vectors)
    for shard, block in ((8192, 1024), (40, 2)):
        got = topk.search(every.where("vec_id % 50 = 0"), every, 5, shard, block)
        assert {tuple(r) for r in got.collect()} == want
    assert topk.every_fiftieth(vectors.limit(0)).count() == 0
    few = topk.every_fiftieth(vectors.where("vec_id in (0, 1)"))
    assert few.select("query_id", "rank").collect() == [(0, 1)]


def test_wide_products_and_repeated_queries(spark):
    """Products beyond exact doubles are computed as integers, those beyond a score raise; equal ids share a list."""
    big = float(2**20)
    rows = [(0, [big, 1.0]), (1, [big, 2.0]), (2, [big, 3.0]), (3, [-big, 1.0]), (4, [])]
    got = topk.every_fiftieth(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3).collect()
    exact = lambda a, b: sum(int(256 * x) * int(256 * y) for x, y in zip(a, b, strict=False))
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(i, exact(rows[0][1], rows[i][1])) for i in (2, 1, 4)]
    for bad in (1e308, 1e15):
        with pytest.raises(Exception, match="62 bits|64 bits"):
            topk.every_fiftieth(spark.createDataFrame([(0, [bad]), (1, [bad])], "vec_id long, embedding array<double>")).collect()
    twice = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [5.0, 0.0]), (2, [0.0, 4.0]), (3, [1.0, 1.0])]
    got = topk.every_fiftieth(spark.createDataFrame(twice, "vec_id long, embedding array<double>"), 2).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(1, 1), (2, 2)]


def test_null_ids_are_not_held_out(spark):
    docs = spark.createDataFrame([(None, "x"), (1, "y")], "doc_id long, text string")
    assert [r[0] for r in docs.orderBy("text").select(langid.held_out()).collect()][0] is False
    assert docs.where(langid.learnable()).where("doc_id is null").count() == 0


def test_held_out_rows_are_not_learned(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x y z").alias("text"), F.lit("en").alias("lang"))
    import zlib

    want = {i for i in range(50) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {r.doc_id for r in docs.where(langid.held_out()).collect()} == want


def brute_restore(token, model):
    """The words of the cheapest of all paths through a token's lattice."""
    best = (float("inf"), b"")
    for path in itertools.product(*toxicity._lattice(token), ((0, 0.0),)):
        state, cost, out = 0, 0.0, []
        for symbol, extra in path:
            cost += extra
            if symbol is not None and (symbol or state & 31):
                cost += float(model[(state << 5) | symbol])
                state = ((state << 5) | symbol) & 0x7FFF
                out.append(96 + symbol if symbol else 32)
        best = min(best, (cost, bytes(out)))
    return best[1].split()


@pytest.mark.parametrize("few", [None, 0, 10**9])
def test_decoding_is_exact(monkeypatch, few):
    """Masks need more states than a narrow beam keeps; steps taken one by one or as arrays give the same words."""
    rng = np.random.default_rng(11)
    model = rng.exponential(6, 1 << 20).astype(np.float32)
    if few is not None:
        monkeypatch.setattr(toxicity, "_FEW", few)
    for token in ("st**id", "p*t*e", "**ab", "1d10t5", "l00ser", "ab**"):
        assert toxicity.restore(token, model) == brute_restore(token, model)
    # Dear at first and cheap at the end: "qq" is among the last of the states after two masks.
    model = (20 + rng.random(1 << 20)).astype(np.float32).reshape((32,) * 4)
    model[0, 0, 0, 17] = model[0, 0, 17, 17] = 25
    model[0, 17, 17, 1] = model[17, 17, 1, 2] = model[17, 1, 2, 0] = 0
    assert toxicity.restore("**ab", model.ravel()) == brute_restore("**ab", model.ravel()) == [b"qqab"]


@pytest.mark.parametrize("form", ["st.upid", "id-iot", "s,t,u,p,i,d", "st\u200bup\u200bid", "stuupid", "iidiot", "p o o p"])
def test_disguises_are_read(form):
    """Separators between several letters and of any kind, letters said twice, a spaced run of two different letters."""
    model = np.full((32,) * 4, 5, np.float32)
    for word in ("stupid", "idiot", "poop"):
        s = [0, 0, 0, *(ord(c) - 96 for c in word), 0]
        for i in range(len(s) - 3):
            model[tuple(s[i : i + 4])] = 0.5
    scorer = toxicity.Scorer(model.ravel(), {b"stupid": 5.0, b"idiot": 5.0, b"poop": 5.0}, np.array([-3.0, 1.0, 1.0, 1.0]))
    assert scorer.score(f"well then {form} again", {}, {}) >= 0.5 > scorer.score("well then again", {}, {})
    assert toxicity.words_of(f"well then {form} again", scorer.model, {}) & set(scorer.weights)


def test_letters_that_are_not_ascii_are_restored():
    model = np.full(1 << 20, 1, np.float32)
    assert toxicity.restore("déb1le", model)[0].startswith("déb".encode())
    assert "дурак".encode() in toxicity.restore("ду.рак", model)
    flat = np.full((32,) * 4, 3, np.float32)
    s = [0, 0, 0, 4, 27, 27, 2, 9, 12, 5, 0]  # the model knows both bytes of é as one symbol
    for i in range(len(s) - 3):
        flat[tuple(s[i : i + 4])] = 0.5
    scorer = toxicity.Scorer(flat.ravel(), {"débile".encode(): 5.0}, np.array([-3.0, 1.0, 1.0, 1.0]))
    for form in ("déb1le", "d.é.b.i.l.e", "d é b i l e", "débiiile"):
        assert scorer.score(f"tout est {form} ici", {}, {}) >= 0.5
