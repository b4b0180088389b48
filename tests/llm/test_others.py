"""Licences, exact top-k, page text and the pipeline."""

import html
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import contamination, exact_topk, licences, near_join, page_text, registry
from tidemark.llm.page_text import Line

MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert order(got).equals(order(want))


FILES = "id long, path string, text string, licence string, score string, term string"


def scan(spark, rows, **options):
    df = spark.createDataFrame([(i, p, t, "clash", "clash", "clash") for i, (p, t) in enumerate(rows)], FILES)
    return {r.id: (r.licence, r.origin) for r in licences.scan(df, **options).collect()}


def test_licences_and_inheritance(spark):
    rows = [
        ("a/LICENSE", f"Some words.\n{MIT}"), ("a/b/c/x.txt", "plain"), ("a/b/y.txt", f"first line\nsecond. {GPL} more text"),
        ("a/b/d/COPYING.md", GPL.upper()), ("a/b/d/z.txt", ""), ("a/b/d/e/f/w.txt", None), ("q/x.txt", "licensed words under the sun"),
        (None, MIT), (None, "x"), ("top.txt", "x"), ("a/LICENSE.bak.txt", "x"), ("a/b/y.txt", "x"), ("ab/n.txt", "the license of"),
        ("d/e.txt", "Mit der Lizenz und mit Licensed, under. " * 500), ("d/long.txt", "w " * 30_000 + MIT),
    ]
    got = scan(spark, rows)
    assert got == {
        0: ("MIT", "own"), 1: ("MIT", "inherited"), 2: ("GPL-3.0", "own"), 3: ("GPL-3.0", "own"), 4: ("GPL-3.0", "inherited"),
        5: ("GPL-3.0", "inherited"), 6: (None, "none"), 7: ("MIT", "own"), 8: (None, "none"), 9: (None, "none"), 10: ("MIT", "inherited"),
        11: ("MIT", "inherited"), 12: (None, "none"), 13: (None, "none"), 14: (None, "none"),
    }
    assert scan(spark, [("LICENSE", MIT), ("a/b.txt", "x"), ("c.txt", None)]) == {0: ("MIT", "own"), 1: ("MIT", "inherited"), 2: ("MIT", "inherited")}
    assert scan(spark, []) == {}


def test_left_out_sentences_cannot_match():
    terms = [("A", "x", 3.0), ("A", "y", 2.0), ("A", "z", 1.0), ("B", "x", 3.0), ("B", "q", 0.5)]
    needed = licences.needed_words(terms, 0.75)
    for name in ("A", "B"):
        own = {t: w for n, t, w in terms if n == name}
        rest = [w for t, w in own.items() if t not in needed]
        assert math.sqrt(sum(w * w for w in rest) / sum(w * w for w in own.values())) < 0.75


def test_licences_use_dataframe_functions_only(spark, sf):
    plan = registry.QUERIES["op10_licences"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute(vectors, k, modulus):
    usable = [(i, np.floor(256.0 * np.asarray(v, float)).astype(np.int64)) for i, v in vectors
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)): (i, v) for i, v in usable if i % modulus == 0}.values():
        best = sorted((-int(q @ v), j) for j, v in usable if j != i and len(v) == len(q))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,query_block,spread", [(4096, 2048, 1.0), (16, 4, 3.0), (7, 1, 0.0)])
def test_top_k_is_brute_force(spark, block, query_block, spread):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 6)) * np.exp(spread * rng.normal(size=(200, 1))) * [4, 2, 1, 0.1, 0.1, 0.1]
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    vectors += [(300 + i, list(vectors[i % 3][1])) for i in range(30)]  # ties and copies
    vectors += [(400, None), (401, []), (410, []), (402, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (403, [math.nan] * 6), (404, [math.inf] * 6),
                (None, [9.0] * 6), (405, [1.0, 2.0]), (420, [1.0, 2.0]), (10, vectors[10][1]), (20, [1.0] * 6), (30, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in vectors], "vec_id long, embedding array<double>, rank int, score double")
    got = exact_topk.top_k(df, F.col("vec_id") % 10 == 0, k=4, block=block, query_block=query_block).collect()
    assert sorted(tuple(r) for r in got) == brute(vectors, 4, 10)


def test_top_k_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert exact_topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 2 == 0).count() == 0
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (3, [1e6])], schema)
    got = sorted(tuple(r) for r in exact_topk.top_k(df, F.col("vec_id") % 2 == 0).collect())
    assert got == [(0, 1, 3, 256 * 256_000_000), (0, 2, 1, 256 * 512)]


def test_large_components_stay_exact():
    a, b = np.array([[2**40 + 1, -3]]), np.array([[2**20 + 1, 5]])
    assert exact_topk.products(a, b)[0, 0] == (2**40 + 1) * (2**20 + 1) - 15


def longest(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def test_common_lines_are_a_longest_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        places = sorted(page_text.common_lines(a, b))
        assert len(places) == longest(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in places)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<div class="site-header">Site</div><script>var t="</p>";</script><div class='cookie notice'>We use <b>cookies</b></div><!-- ad <p>no -->
<%s><h1>Title &amp; more</h1><p>One\n  <b>tw</b>o&nbsp;three<br>four</p><aside>side</aside><p class="ad">buy</p><p>Five <span class="ad">now</span>six
<div id="comments"><p>first!</p></div><form>Name <input> <button>Go</button></form></%s><div>Frame line</div><footer>&copy; host</footer></body></html>"""
TEXT = "Title & more One two three four Five six"


def test_page_lines():
    for box in ("article", 'div class="post-content"', "main"):
        lines = page_text.page_lines(PAGE % (box, box.split()[0]))
        assert " ".join(x.text for x in lines if not x.frame and x.article) == TEXT
        assert {x.text for x in lines if x.frame} >= {"Home", "Site", "We use cookies", "side", "buy", "first!", "Name", "© host"}
    kept = lambda html: " ".join(x.text for x in page_text.page_lines(html) if not x.frame)
    assert kept('<div class="content with-sidebar"><div class="article-header"><h1>T</h1><p>by X</p></div><p>a</p></div>') == "T a"
    assert kept('<article class="post comments-open"><header><h2>T</h2>now</header><p>a</p><div class="commentsHeader"><h3>Said</h3></div>') == "T a"
    assert kept('<article class="comment">no</article><div id="main-menu">no</div><p hidden>no</p><p>a</p>') == "a"
    assert page_text.page_lines(None) == [] == page_text.page_lines("") == page_text.page_lines("<script>never closed")
    assert [x.text for x in page_text.page_lines("a < b <i>c</i>d <3 &lt;p&gt;")] == ["a < b cd <3 <p>"]


def test_page_lines_of_open_ends_and_wrappers():
    kept = lambda html: " ".join(x.text for x in page_text.page_lines(html) if not x.frame)
    assert kept("<html><head><title>no</title><meta charset=utf-8><body><p>a</p>") == "a"
    assert kept("<head class='menu'><style>no</style><h1>a</h1><p>b") == "a b"
    assert kept("<p>a<svg width='1' /><math/>b</p><svg/><p>c</p><svg><g>no</g></svg><p>d</p>") == "ab c d"
    assert kept("<svg><svg><text>no</text></svg><text>no</text></svg><p>a</p>") == "a"
    assert kept("<svg><path d='M0'><p>a</p>") == "a" and kept("<svg width=1/>no</svg><p>a</p>") == "a"
    assert kept("<svg><foreignObject><p>no</p></foreignObject></svg><p>a</p>") == "a"
    assert kept("<div class='layout right-sidebar'><h1>T</h1><article><p>a</p></article><aside>no</aside></div>") == "T a"
    assert kept("<div id='content-with-sidebar'><main><p>a</p></main><div class='sidebar'>no</div></div>") == "a"
    assert kept("<div class='right-sidebar'><p>no</p></div><article>a</article>") == "a"
    assert kept("<div class='sidebar'><article>no</article></div><div class='related-posts'><article>no</article></div><p>a</p>") == "a"
    assert kept("<aside><div class='left-menu'><article>no</article></div></aside><p>a</p>") == "a"


def test_shared_lines_go_unless_the_article_or_a_copy():
    plain = lambda *t: [Line(x, False, False) for x in t]
    page, other = plain("Frame", "own text of this page", "Foot"), plain("Frame", "other text of that page", "Foot")
    assert page_text.main_text(page, [other]) == "own text of this page"
    assert page_text.main_text(page, [page]) == "Frame own text of this page Foot"
    assert page_text.main_text([Line("Frame", False, True), *page[1:]], [other]) == "Frame own text of this page"
    assert page_text.main_text([], [other]) == ""


def test_pages_by_neighbouring_urls(spark):
    page = lambda text: f"<div>Frame line of the host</div><div>{text}</div><div>Closing line</div>"
    rows = [(i, f"http://H.example/en/{i}.html?x={i}", page(f"text number {i}, its own words {i * 7}")) for i in range(40)]
    rows += [(90, None, page("alone")), (91, "http://h.example/none", None), (92, "not a url", ""), (None, "http://other.example/1", page("single"))]
    df = spark.createDataFrame([(*r, "clash", "clash", 0) for r in rows], "page_id long, url string, html string, text string, host string, n_chars int")
    got = {r.page_id: r for r in page_text.extract_pages(df).collect()}
    assert len(got) == 44
    assert sum(got[i].text == f"text number {i}, its own words {i * 7}" for i in range(40)) >= 30  # those with a neighbour in their range
    assert got[90].text == "Frame line of the host alone Closing line" and got[91].text == got[92].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert page_text.extract_pages(df.limit(0)).count() == 0


def test_pages_keep_exactly_their_articles(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r.text for r in registry.QUERIES["op6_page_text"](spark, sf).collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    benchmark = [" ".join(contamination.WORD(r.text.lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = kept.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(rows) == len(after) and after.items() <= before.items()
        if name == "near_copies":
            words = {i: near_join.WORD((t or "").lower()) for i, t in after.items()}
            sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items() if len(w) >= 5}
            assert all(len(a & b) < 0.8 * len(a | b) for a, b in itertools.combinations(sets.values(), 2))
        if name == "contamination":
            held = lambda t: any(b in " ".join(contamination.WORD(t.lower())) for b in benchmark)
            assert not any(held(t) for t in after.values()) and all(held(t) for i, t in before.items() if i not in after)
        docs, before = spark.createDataFrame(rows, docs.schema), after
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in encoded) == sorted(before)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(tuple(r) for r in encoded)


def test_pipeline_takes_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (1, "", "en", "s", 0), (None, "the and of is on the one", "en", None, 3), (2, "?? 12", "fr", "s", 1)]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf).count() >= 0


@pytest.mark.parametrize("name", ["button", "select", "object", "canvas", "svg", "math"])
def test_what_follows_an_unclosed_element_is_kept(name):
    page = f"<article><p>a</p><{name}>x<p>b</p><p>c</p></article>"
    assert [line.text for line in page_text.page_lines(page)] == ["a", "b", "c"]
    closed = f"<p>a</p><{name}>x</{name}><p>b</p><{name}>y<p>c</p>"
    assert [line.text for line in page_text.page_lines(closed)] == ["a", "b", "c"]


@pytest.mark.parametrize("name", ["iframe", "textarea", "noscript", "script"])
def test_raw_elements_without_an_end_take_the_rest(name):
    assert [line.text for line in page_text.page_lines(f"<p>a</p><{name}>x<p>b</p>")] == ["a"]


@pytest.mark.parametrize(
    "broken", ["<svg>", "<svg><p>", "<a x=\"", "<a x='", '<p><a b="c>', "<button>z<p>", "<script>", "<!-- ", "<a ", "<math><svg>"]
)
def test_broken_markup_takes_linear_time(broken):
    import time

    start = time.process_time()
    page_text.page_lines(broken * (1_000_000 // len(broken)) + "</svg>")
    assert time.process_time() - start < 20
