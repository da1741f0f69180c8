"""Wrapper inference: expressions by hand, main text against a plain reading of the markup."""

import html
import re

from lendlens.llm import wrappers as w

TABLES = "/root/testdata/sf0.01"


def shape(items):
    """An expression as text: ? may be absent, + may repeat, * both."""
    def one(i):
        mark = {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[i["o"], i["r"]]
        if i["k"] == "#":
            return ("#" if i["h"] is None else "text") + mark
        inner = " ".join(map(one, i["c"]))
        return (f"({inner})" if i["k"].startswith("(") else f"<{i['k']}>{inner}</>") + mark
    return " ".join(map(one, items))


def wrapper(*pages):
    found = None
    for page in pages:
        e = w.expression(w.read_page(page))
        found = e if found is None else w.aligned(found, e)
    return found


def text_of(page, *others):
    return w.main_text(w.read_page(page), w.Reader(w.marked(wrapper(page, *others))))


def test_union_free_expressions():
    assert shape(wrapper("<p>a</p><p>b</p>", "<p>c</p>")) == "<p>#</>+"
    assert shape(wrapper("<h1>same</h1><p>a</p>", "<h1>same</h1><ul><li>x</ul>")) == "<h1>text</> <p>text</>? <ul><li>text</></>?"
    assert shape(wrapper("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>e<dd>f</dl>")) == "<dl>(<dt>#</> <dd>#</>)+</>"
    assert shape(wrapper("<div>a<p>b</div>", "<div><p>c</div>")) == "<div>text? <p>#</></>"
    many = "".join(f"<h2>a</h2>{'<p>x</p>' * (i % 3)}<ul><li>{i}</ul>{'<pre>x</pre>' * (i % 2)}" for i in range(200))
    found = wrapper(many)
    assert len(found) <= w.MOST and w.Reader(found).fits(w.read_page(many).content, {})


def test_every_page_fits_its_wrapper():
    import random
    rng = random.Random(3)
    for _ in range(60):
        def part(depth):
            return "".join(
                f"<{t}>{part(depth - 1) if depth and rng.random() < .5 else rng.choice('abc')}</{t}>"
                for t in rng.choices(["div", "section", "h2", "ul", "pre"], k=rng.randint(0, 7)))
        pages = [part(2) for _ in range(6)]
        found = w.marked(wrapper(*pages))

        for page in pages:
            assert w.Reader(found).fits(w.read_page(page).content, {})


def test_article_without_what_stands_beside():
    page = """<!doctype html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Menu</ul></nav>
      <article><header><h1>Head &amp; line</h1></header><p>One<b>two</b><br>three <a href=x>link</a>.<script>var a="</p>";</script>
      <div class="ad-slot">Buy</div><aside>More</aside><p>Four &lt;b&gt; &#233;&nbsp;x<form><input value=1>Mail</form>
      <ul><li>Five<li>six</ul><!-- no --><section id="comments"><article>Reader says</article></section></article>
      <div class="cookie-notice">We use</div><footer>&copy;</footer>"""
    assert text_of(page) == "Head & line Onetwo three link. Four <b> é x Five six"


def test_pages_without_article_use_what_differs():
    def page(title, body):
        return f"<div><a href=/>Home</a> <a href=/b>News</a></div><div><h2>{title}</h2>{body}</div><div>All rights reserved by us.</div>"
    a, b = page("One", "<p>first text here</p><p>and more of it</p>"), page("Two", "<p>another text</p>")
    assert text_of(a, b) == "One first text here and more of it"
    assert text_of(b, a, a, b) == "Two another text"
    assert text_of(b, b) == text_of(b)  # copies alone make no template
    assert text_of("<main>x <p>y</main><div>no</div>") == "x y"
    assert text_of("<article></article><div>words that are longer</div>") == ""


def test_odd_markup():
    assert text_of("") == "" and text_of("   ") == ""
    assert text_of("just text & more") == "just text & more"
    assert text_of("<article>a < b and <p") == "a < b and"
    assert text_of("<article><p>cut <!-- never ended") == "cut"
    assert text_of("<head><title>t</title><p>no body tag") == "no body tag"
    deep = "<article>" + "<div>" * 5000 + "x" + "</div>" * 5000 + "<p>y</article><p>z"
    assert text_of(deep) == "x y"
    assert text_of("<article>" + "<p>" * 20000 + "x" + '<a b="' * 20000) == "x"


SCHEMA = "page_id long, url string, html string, text string, n_chars int, host string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "t", 0, "h") for r in rows], SCHEMA)
    return {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in w.extract_main_text(df).collect()}


def test_query_on_odd_rows(spark):
    assert run(spark, []) == {}
    long = "<article>" + "<p>wörd &amp;</p>" * 30000 + "</article>"
    found = run(spark, [(1, "http://a.b/x", None), (2, None, "<article>x</article>"), (3, "nohost", "<article>y</article>"),
                        (4, "http://A.b", long), (5, "http://a.b", long), (None, "http://c/", "<p>alone</p>")])
    assert found[1] == ("http://a.b/x", "", 0) and found[2] == (None, "x", 1) and found[3][1] == "y"
    assert found[4] == ("http://A.b", " ".join(["wörd &"] * 30000), 30000 * 7 - 1) and found[5][1] == found[4][1]
    assert found[None][1] == "alone"


def test_query_against_plain_reading(spark):
    """In the given pages the article element holds the main text and nothing else."""
    pages = spark.read.parquet(f"{TABLES}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in w.extract_main_text(pages).collect()}
    for row in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner))
        assert found[row["page_id"]] == " ".join(html.unescape(inner).split())
