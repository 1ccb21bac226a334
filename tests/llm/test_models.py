"""Decontamination, language identification, scoring, search and extraction."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripelake.llm import ctw, decontaminate, html_text
from stripelake.llm.ann import kmeans, search, walk
from stripelake.llm.grams import HashIndex, PlacedIndex, place
from stripelake.llm.language import PPM, identify, learn

from . import brute


@pytest.fixture(scope="module")
def items(texts):
    rng = random.Random(8)
    out = [(i, t) for i, t in enumerate(texts[:8])] + [(100, None), (101, ""), (102, "é ü"), (103, "b"), (104, texts[20]), (None, texts[21]), (105, texts[0]), (105, "zz yy")]
    out += [(200 + i, " ".join(rng.choice(texts[30:50]).split(" ")[3:15])) for i in range(10)]
    return out


@pytest.mark.parametrize("limit", [1 << 20, 3000])
def test_find_items(docs, items, spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", limit)
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit("clash")).withColumn("doc_id", F.lit(1))
    got = decontaminate.find_items(docs, table, size=10).collect()
    old = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert len(got) == docs.count()
    for r in got:
        n, hit, found = brute.hits(old[r["doc_id"]], items, 10)
        assert r["n_words"] == n and r["items"] == sorted(found)
        assert {p for s in r["spans"] for p in range(s["start"], s["end"])} == hit


def test_wu_manber_finds_all():
    rng = random.Random(2)
    text = bytes(rng.choice(b"ab ") for _ in range(6000))
    for low, high in ((3, 7), (8, 15), (16, 31), (32, 60)):
        patterns = sorted({text[(a := rng.randrange(5900)) : a + rng.randint(low, high)] for _ in range(40)})
        want = sorted((p, k) for k, x in enumerate(patterns) for p in range(len(text)) if text.startswith(x, p))
        assert sorted(decontaminate.WuManber(patterns).find(text + b"\0" * 8)) == want


def test_no_items(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(docs, none).where("size(spans) > 0").count() == 0


def test_empty_tables(none, spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.find_items(none, items).count() == 0
    model = learn(none, "doc_id", "text", "lang")
    assert identify(none, model).count() == 0
    assert ctw.score_texts(none.withColumn("l", F.lit(True)), "l").count() == 0
    assert search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# -- language


def slow_ppm(texts, context, byte, order):
    """Code length of a byte by escape method C, from raw counts."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        data = b"\xff" * order + t.lower().encode()
        for p in range(order, len(data)):
            for d in range(order + 1):
                counts[d][data[p - d : p], data[p]] += 1
    bits = 0.0
    for d in range(order, -1, -1):
        own = {b: n for (c, b), n in counts[d].items() if c == context[len(context) - d :]}
        total, kinds = sum(own.values()), len(own)
        if byte in own:
            return bits - math.log2(own[byte] / (total + kinds))
        if total:
            bits -= math.log2(kinds / (total + kinds))
    return bits + 8


def test_ppm_code_lengths():
    texts = {"x": ["abcab abd", "bca"], "y": ["zzz zza", None, ""]}
    model = PPM(texts, order=3)
    for t in ["abc", "zza b", "", "q", "a" * 9]:
        got = model.lengths([t])[0]
        for j, lang in enumerate(model.langs):
            data = b"\xff" * 3 + t.encode()
            want = sum(slow_ppm([u or "" for u in texts[lang]], data[p - 3 : p], data[p], 3) for p in range(3, len(data)))
            assert got[j] == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    got = identify(test, learn(train, "doc_id", "text", "lang", sample=20), keep=["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_texts(docs, spark):
    model = learn(spark.createDataFrame([(1, "the cat", "en"), (2, "der Hund", "de"), (3, None, "en"), (4, "x", None), (None, "y", "fr")], "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert model.langs == ["de", "en"]
    got = identify(docs, model).collect()
    old = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert len(got) == docs.count()
    for r in got:
        t = old[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (t is None or not any(c.isalpha() for c in t))


def test_nothing_learned(docs, none):
    assert {r["lang_pred"] for r in identify(docs, learn(none, "doc_id", "text", "lang")).collect()} == {"und"}


# -- scoring


def slow_ctw(train, order):
    """A function from (context, byte) to log10 of its probability, by plain recursion over the context trees."""
    counts = Counter()
    for t in train:
        data = b"\xff" * order + t + b"\xff"
        for p in range(order, len(data)):
            for k in range(8):
                prefix = (1 << k) | (data[p] >> (8 - k))
                for d in range(order + 1):
                    counts[prefix, data[p - d : p], (data[p] >> (7 - k)) & 1] += 1
    nodes = {(p, c) for p, c, _ in counts}
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)
    own = lambda p, c: kt(counts[p, c, 0], counts[p, c, 1])

    def weighted(p, c):
        if len(c) == order:
            return own(p, c)
        return math.log(0.5) + np.logaddexp(own(p, c), below(p, c))

    def below(p, c):
        return sum(weighted(p, x) for q, x in nodes if q == p and len(x) == len(c) + 1 and x.endswith(c))

    def code(context, byte):
        total = 0.0
        for k in range(8):
            prefix, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
            prob = None
            for d in range(order, -1, -1):
                c = context[len(context) - d :]
                if (prefix, c) not in nodes:
                    continue
                mine = (counts[prefix, c, bit] + 0.5) / (counts[prefix, c, 0] + counts[prefix, c, 1] + 1)
                if prob is None:
                    prob = mine
                else:
                    share = 1 / (1 + math.exp(-(own(prefix, c) - below(prefix, c))))
                    prob = share * mine + (1 - share) * prob
            total += math.log10(0.5 if prob is None else prob)
        return total

    return code


@pytest.mark.parametrize(("keys", "order"), [(10**9, 3), (20, 3), (3, 3), (1, 2), (10**9, 4), (10**9, 2), (10**9, 1)])
def test_ctw_scores(spark, keys, order):
    rows = [(1, "abab abba", True), (2, "ABBA b", True), (3, "abac é", False), (4, None, True), (5, "", False), (6, "zz", None), (None, "ab", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").withColumn("id", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r["doc_id"]: r for r in ctw.score_texts(df, "learn", order=order, broadcast_keys=keys).collect()}
    data = {i: brute.lower(t).encode() for i, t, _ in rows}
    code = slow_ctw([data[i] for i, _, f in rows if f], order)
    tokens = {i: data[i].split() + [None] for i in data}
    c = Counter(t for i, _, f in rows if f for t in tokens[i])
    total, kinds = sum(c.values()), len(c)
    for i, _, f in rows:
        whole = b"\xff" * order + data[i] + b"\xff"
        r = got[i]
        assert r["score"] == pytest.approx(sum(code(whole[p - order : p], whole[p]) for p in range(order, len(whole))), rel=1e-5)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / (total + kinds + 1)) for t in tokens[i]), rel=1e-9)
        assert (r["n_bytes"], r["n_tokens"], r["n_known"], r["train_tokens"], r["learn"]) == (len(whole) - order, len(tokens[i]), sum(c[t] > 0 for t in tokens[i]), total, bool(f))


def test_ctw_counts_beyond_a_byte(spark):
    rows = [(i, "aa " * n + f"w{i}", i % 3 > 0) for i, n in enumerate([100, 254, 1, 300, 0, 7])]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    c = Counter(t for _, x, f in rows if f for t in x.split() + [None])
    total, kinds = sum(c.values()), len(c)
    assert c["aa"] > ctw.MANY
    for r in ctw.score_texts(df, "learn", order=1).collect():
        tokens = rows[r["doc_id"]][1].split() + [None]
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / (total + kinds + 1)) for t in tokens), rel=1e-9)
        assert (r["n_tokens"], r["n_known"]) == (len(tokens), sum(c[t] > 0 for t in tokens))


def test_samples_of_huge_tables_are_not_empty():
    from stripelake.llm import language

    for n in (10**3, 10**9, 10**12):
        share = language.share_of(n, 2000 * n)
        assert 0 < int(share * 2**63) and 900 <= share * n <= 1001
    assert language.share_of(1000, 10**12) * 10**12 == language.SAMPLE_BYTES  # long texts: fewer of them


def test_ctw_is_a_distribution(spark):
    code = slow_ctw([b"abcabc", b"abd"], 2)
    for context in (b"ab", b"zz", b"\xff\xff"):
        assert sum(10 ** code(context, b) for b in range(256)) == pytest.approx(1)


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 2, 7.9, 8, 30, 1e6])
    assert np.allclose(ctw.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_placed_index():
    rng = np.random.default_rng(3)
    tables = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 0, 64, 5000)] + [np.arange(300, dtype=np.uint64)]
    made = [place(k) for k in tables]
    index = PlacedIndex([m[0] for m in made], np.concatenate([m[1] for m in made]))
    keys, table = np.concatenate(tables), np.repeat(np.arange(len(tables)), [len(k) for k in tables])
    found = index.find(keys, table)
    assert sorted(found) == list(range(len(keys)))
    at = np.concatenate([k[m[2]] for k, m in zip(tables, made)])
    assert (at[found] == keys).all()
    stray = index.find(rng.integers(0, 2**63, 1000).astype(np.uint64), rng.integers(0, len(tables), 1000))
    assert ((stray >= -1) & (stray < len(keys))).all()


def test_hash_index():
    keys = np.unique(np.random.RandomState(0).randint(0, 2**62, 5000).astype(np.uint64))
    index = HashIndex(keys[::2])
    got = index.find(keys)
    assert (got[::2] == np.arange(len(keys[::2]))).all() and (got[1::2] == -1).all()
    assert (HashIndex(keys[:0]).find(keys) == -1).all()


# -- search


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("q", F.lit(1)).withColumn("cell", F.lit(0)).repartition(4)


def exact(rows, queries, k):
    out = {}
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)})
    dim = Counter(len(v) for _, v in good).most_common(1)[0][0]
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in good if len(v) == dim]
    for i, v in good:
        if i in queries:
            out[i] = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good if j != i)[:k]
    return out


def test_search_is_exact_on_few_vectors(spark):
    rng = np.random.RandomState(6)
    rows = [(i, rng.randn(6).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(300, None), (301, []), (302, [0.0] * 6), (303, [float("nan")] * 6), (304, [1.0, None] * 3), (305, [float("inf")] + [1.0] * 5), (306, [1.0, 2.0]), (None, [1.0] * 6), rows[0]]
    got = search(vectors(spark, rows), F.col("vec_id") % 10 == 0, k=5, candidates=1000).collect()
    want = exact(rows, {i for i, _ in rows if i is not None and i % 10 == 0}, 5)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert found.keys() == want.keys()
    for q, near in want.items():
        assert [j for _, j in found[q]] == [j for _, j in near]
        assert np.allclose([d for d, _ in found[q]], [d for d, _ in near])


@pytest.mark.parametrize("how", [{}, {"candidates": 600}])
def test_search_recall(spark, how):
    rng = np.random.RandomState(7)
    centers = rng.randn(20, 8)
    rows = [(i, (centers[i % 20] + 0.4 * rng.randn(8)).tolist()) for i in range(3000)]
    got = search(vectors(spark, rows), F.col("vec_id") % 100 == 0, **how).collect()
    want = exact(rows, {i for i in range(0, 3000, 100)}, 10)
    hit = sum(1 for r in got if r["vec_id"] in {j for _, j in want[r["query_id"]]})
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_few_candidates(spark):
    got = search(vectors(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0])]), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 1.0)]
    assert search(vectors(spark, [(0, [1.0, 2.0])]), F.col("vec_id") == 0).count() == 0
    assert search(vectors(spark, [(0, [1.0]), (1, [4.0])]), F.col("vec_id") == 0).collect()[0]["score"] == 3.0


def test_walk_is_in_order():
    rng = np.random.RandomState(1)
    d1, d2 = rng.rand(6), rng.rand(5)
    cells = walk(d1, d2, np.ones(30, dtype=int), 30)
    sums = [d1[c // 5] + d2[c % 5] for c in cells]
    assert sorted(cells) == list(range(30)) and sums == sorted(sums)


def test_kmeans_of_few_points():
    assert len(kmeans(np.array([[1.0], [1.0], [2.0]]), 5)) == 2


# -- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-menu"><header>H</header><nav><ul><li>N</ul></nav>
<div class="ad">Ad</div>%s<div id="comments"><article class="comment">C</article></div><footer>F</footer></body></html>"""


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (PAGE % "<article><h1>A &amp; B</h1><p><b>one\n two<br><p>th<i>re</i>e&nbsp;x<aside>no</aside></p><form>no</form></article>", "A & B\none two\nthree x"),
        (PAGE % "<main><p>m</p><div class='social share'>no</div></main>", "m"),
        (PAGE % "<p>open</p>", "open"),
        ("plain text", "plain text"),
        ("<p>a<p>b", "a\nb"),
        ("<p>a < b &lt;p&gt; &#233;&bogus;", "a < b <p> é&bogus;"),
        ("<div hidden>x</div><div style='display: none'>y</div>z", "z"),
        ("<script>never closed", ""),
        ("<table><tr><td>a</td><td>b</td></tr></table>", "a\nb"),
        ('<p title="a > b">c</p><!-- d --><p>e</p>', "c\ne"),
        ("<nav>n", ""),
        ('<article><p title="The hidden valley">a', "a"),
        ('<article data-title="A hidden gem">a', "a"),
        ('<p data-id="menu">a', "a"),
        ('<article class="post social-post">a</article><article class="teaser">b</article>', "a"),
        ('<p class="ad-free">a<p class="ad-slot">b', "a"),
        ('<div class="login-notes">a</div><div id="main-nav">b</div>', "a"),
        ('<article><figure class="widget"><figcaption>a</figcaption></figure>b</article>', "a\nb"),
        ("<article>short</article><div>the body of the page in plain boxes</div>", "short\nthe body of the page in plain boxes"),
        ("<article>the story of this page</article><article>another</article>", "the story of this page"),
        ("<a href='x>y'>a</a><span hidden>b<span>c</span>d</span>e", "ae"),
        ("<p a='b>c</p><p>d", "c\nd"),
        ("a<p ", "a"),
        ("", ""),
        (None, ""),
    ],
)
def test_blocks(spark, html, text):
    page = spark.createDataFrame([(1, "http://h.example/a", html)], "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("key", F.lit(2))
    assert html_text.main_text(page).select("page_id", "url", "text").collect() == [(1, "http://h.example/a", text)]


@pytest.mark.parametrize("unit", ["<p ", '<p a="', "<b><div>", "<span class=ad>", "</div>", "<!--", "<", "<div><p><span hidden>", "&amp", "<br>"])
def test_long_broken_pages_take_linear_time(unit):
    import time

    began = time.time()
    html_text.blocks(unit * (1_000_000 // len(unit)) + "</b>" * 100_000)
    assert time.time() - began < 20


def test_lines_that_neighbouring_articles_share(spark):
    """A line in the articles of three neighbours is template; one that two articles have in common is text; near copies tell nothing."""
    article = lambda *t: "<article>" + "".join(f"<p>{x}</p>" for x in t) + "</article>"
    story = lambda i: [f"Story {i} begins.", f"Story {i} goes on.", f"Story {i} ends."]
    rows = [(i, f"https://shared.example/{i:02d}", article("Read this in our app", *story(i), "Thanks for reading")) for i in range(8)]
    quote = ["A quoted line."]
    rows += [(20 + i, f"https://quotes.example/{i:02d}", article(*story(i), *(quote if i in (3, 4) else []))) for i in range(8)]
    rows += [(40 + i, f"https://series.example/{i:02d}", article(*story(0), f"Version {i}")) for i in range(8)]
    got = {r["page_id"]: r["text"].split("\n") for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert all(got[i] == story(i) for i in range(1, 7))  # pages at the ends have two neighbours
    assert all(got[i] == ["Read this in our app", *story(i), "Thanks for reading"] for i in (0, 7))
    assert all(got[20 + i] == story(i) + (quote if i in (3, 4) else []) for i in range(8))
    assert all(got[40 + i] == [*story(0), f"Version {i}"] for i in range(8))


def lcs_positions(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_differencing_of_a_site_against_brute_force(spark):
    """Sites of open blocks and articles with distinct lines, where an alignment is unique but for order."""
    rng = random.Random(8)
    rows = []
    for host in range(3):
        frame = [f"frame {host} {k}" for k in range(6)]
        for i in range(25):
            head, foot = [x for x in frame[:3] if rng.random() < 0.8], [x for x in frame[3:] if rng.random() < 0.8]
            own = [f"line {host} {i} {k}" for k in range(rng.randint(1, 6))]
            inner = "<article>" + "".join(f"<p>{x}</p>" for x in own) + "</article>" if i % 5 == 0 else "".join(f"<div>{x}</div>" for x in own)
            rows.append((len(rows), f"http://h{host}.example/{rng.choice('abc')}/{i:02d}", "".join(f"<div>{x}</div>" for x in head) + inner + "".join(f"<div>{x}</div>" for x in foot)))
    want = {}
    for host in range(3):
        site = sorted((r for r in rows if f"//h{host}." in r[1]), key=lambda r: r[1])
        found = [html_text.blocks(r[2]) for r in site]
        for n, r in enumerate(site):
            votes, strong = Counter(), set()
            for d in (-2, -1, 1, 2):
                if 0 <= n + d < len(site):
                    shared = lcs_positions([t for t, _ in found[n]], [t for t, _ in found[n + d]])
                    articles = [i for i, (_, k) in enumerate(found[n]) if k == html_text.ARTICLE]
                    same = len(shared & set(articles)) >= len(articles) * html_text.SAME_ARTICLE
                    for i in shared:
                        if found[n][i][1] == html_text.OPEN or not same:
                            votes[i] += 1
                            if len(shared) < len(found[n]) * html_text.COPY and found[n][i][1] == html_text.OPEN:
                                strong.add(i)
            want[r[0]] = "\n".join(html_text.main_blocks(found[n], strong | {i for i, v in votes.items() if v >= (html_text.ARTICLE_VOTES if found[n][i][1] == html_text.ARTICLE else 2)}))
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want
    assert sum("frame" in t for t in got.values()) < len(rows) / 4 and all("line" in t for t in got.values())


def test_page_differencing(spark):
    body = lambda i: f"<div>Site of things</div><div>Top stories</div><div>Story {i} is here.</div><div>All rights reserved</div>"
    rows = [(i, f"https://www.h.example/news/{i:02d}?x=1", body(i)) for i in range(30)] + [(90, "http://other.example/x", body(90)), (91, None, body(91)), (92, "not a url", body(92))]
    rows += [(93, "https://c.example/1", "<div>same</div><div>text</div>"), (94, "https://c.example/2", "<div>same</div><div>text</div>"), rows[0]]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] < 30:
            assert r["text"] == f"Story {r['page_id']} is here."
        elif r["page_id"] < 93:
            assert r["text"].count("\n") == 3
        else:
            assert r["text"] == "same\ntext"  # copies tell nothing about templates


def test_page_differencing_with_large_templates_and_copies(spark):
    lines = lambda *t: "".join(f"<div>{x}</div>" for x in t)
    large = lambda i: lines("Site", "Top", f"Story {i} is here.", "About", "Rights")
    rows = [(i, f"https://large.example/{i:02d}", large(i)) for i in range(9)]  # 4 of 5 blocks are template
    small = lambda *t: lines("Site", *t, "Rights")
    rows += [(20 + i, f"https://copies.example/{i:02d}?x={i}", small("Copied story.") if 2 <= i < 9 else small(f"Story {i}.")) for i in range(11)]
    body = [f"Sentence {k}." for k in range(9)]  # two almost equal pages among others
    rows += [(40 + i, f"https://almost.example/{i:02d}", small(*body, f"Version {i}.") if i in (3, 4) else small(f"Story {i}.", f"Its end {i}.")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert [got[i] for i in range(9)] == [f"Story {i} is here." for i in range(9)]
    assert [got[20 + i] for i in range(11)] == ["Copied story." if 2 <= i < 9 else f"Story {i}." for i in range(11)]
    assert [got[40 + i] for i in range(8)] == ["\n".join([*body, f"Version {i}."]) if i in (3, 4) else f"Story {i}.\nIts end {i}." for i in range(8)]


def test_common():
    rng = random.Random(1)
    for _ in range(50):
        a, b = [rng.randint(0, 4) for _ in range(rng.randint(0, 12))], [rng.randint(0, 4) for _ in range(rng.randint(0, 12))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(html_text.common(a, b)) == best[-1][-1]
