"""Exact search and main text."""

import html
import math
import re
import time

import pytest

from scriptorium.llm import html_extract, topk


def naive_top(rows, every=50, k=5):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in whole:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:k]
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("shard,block,waves", [(16384, 131_072, (1, 8)), (100, 3, (1, 2)), (30, 1000, (1,))])
def test_topk(spark, sf, shard, block, waves):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(400)] + [(None, same), (2001, None), (2002, [None] * 64), (2003, [float("nan")] * 64), (2004, [float("inf")] * 64), (2050, [0.5] * 3), (2051, [])]
    rows += [(50, rows[50][1]), (3, rows[3][1])]  # repeated rows, one of them a query
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("v", "region", "part", "tree", "floor", "block", "score", "rank", "query_id", "n")})
    found = {}
    for r in topk.top_k(df, shard=shard, block=block, waves=waves).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(v) for q, v in found.items()} == naive_top(rows)


def test_topk_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()] == [(0, 1, 1, 256 * 128)]
    assert topk.top_k(df.limit(0)).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{margin:0}</style><script>var t="</p><p>no</p>";</script></head><body>
<header>Site head</header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy this now and here.</div>
<article><h1>A title &lt;here&gt;</h1><p><b>First&nbsp;part
 of it.<br><p>Short.<p>Caf&eacute; &#233;&#x41; end &am</p></article><aside>More of this</aside>
<div class="comments"><p>I liked it very much indeed, thanks for the long story about this.</p></div><form><label>Mail</label></form><footer>&copy; me</footer>"""


def test_main_text():
    tree = html_extract.train_tree(html_extract.LABELLED)
    assert html_extract.main_text(PAGE, tree) == "A title <here> First part of it. Short. Café éA end &am"
    assert all(html_extract.classify(tree, r[:-1]) == bool(r[-1]) for r in html_extract.LABELLED)
    loose = "<div><a href=x>Home</a></div><h1>Head line of it</h1><p>" + "many words stand in here " * 8 + "</p><p>" + "and some more of them " * 9 + "</p><div><a href=x>a b</a> <a href=y>c d</a></div>"
    text = html_extract.main_text(loose, tree)
    assert text.startswith("many words") or text.startswith("Head line")
    assert "Home" not in text and "c d" not in text


def test_tree_reads_words_and_links():
    """Words and link densities, a block's own and its neighbours', decide: lists of links go, text among links stays."""
    tree = html_extract.train_tree(html_extract.LABELLED)
    used = set()

    def walk(node):
        if isinstance(node, tuple):
            used.add(html_extract.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(tree)
    assert {"words", "link"} <= used and used & {"link_before", "link_after", "words_before", "words_after"}
    text = lambda page: html_extract.main_text(page, tree)
    links = "<ul>" + "".join(f"<li><a href=/{w}>{w}</a>" for w in ("One", "Two", "Three", "Four")) + "</ul>"
    body = "<p>" + "plain words of it " * 10 + "</p><p>Short.</p><p><a href=x>A linked line</a></p><p>" + "and more of them " * 8 + "</p>"
    want = ("plain words of it " * 10 + "Short. A linked line " + "and more of them " * 8).strip()
    assert text(f"<article>{body}{links}</article>") == f"{want} One Two Three Four"  # an article's own list of sources
    linked = "<p><a href=x>A linked line</a></p>"
    assert text(f"<div>{links}{body.replace(linked, '')}{links}</div>") == want.replace(" A linked line", "")


PROSE = "plain words that stand in a row here "


def test_names_are_features():
    """A part of a name doesn't take the text of an element; cards beside a longer body aren't the article; scraps and comments go by the tree."""
    tree = html_extract.train_tree(html_extract.LABELLED)
    text = lambda page: html_extract.main_text(page, tree)
    for name in ("content side-by-side", "share-prices-today", "notice-board-story"):
        assert text(f'<body><div class="{name}">{PROSE * 6}</div></body>') == (PROSE * 6).strip()
    cards = "".join(f'<article class="card"><h2><a href=/{i}>Card {i}</a></h2><p>A short lead of it.</p></article>' for i in range(3))
    assert text(f"<div class='content'><h1>The head of it all</h1><p>{PROSE * 6}</p><p>{PROSE * 5}</p></div>{cards}").endswith((PROSE * 6 + PROSE * 5).strip())
    assert "Card" not in text(f"{cards}<div class='content'><p>{PROSE * 6}</p><p>{PROSE * 9}</p></div>")
    for beside in ("comment-list", "related-posts", "cookie-banner", "newsletter-signup", "sidebar"):
        assert text(f"<article><h1>Head</h1><p>{PROSE * 4}</p></article><div class='{beside}'><p>{PROSE * 3}</p></div>") == f"Head {(PROSE * 4).strip()}"
    assert text(f"<div>Slogan of the site</div><article><p>{PROSE * 4}</p></article>") == (PROSE * 4).strip()


def test_tree_rejects(spark, sf):
    """All blocks of the pages reach the tree, which turns many of them away: those that no element marks too."""
    tree = html_extract.train_tree(html_extract.LABELLED)
    kept = gone = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        for row in html_extract.features(html_extract.blocks(r["html"])).tolist():
            kept, gone = (kept + 1, gone) if html_extract.classify(tree, row) else (kept, gone + 1)
    assert kept > 100 and gone > kept / 4

def test_parts_of_pages():
    tree = html_extract.train_tree(html_extract.LABELLED)
    text = lambda page: html_extract.main_text(page, tree)
    own = "<article class='post has-sidebar'><header class='entry-header'><h1>Title here</h1></header><p>Yes.</p><div class='related-posts'>Other</div><aside>Side</aside><form>Mail <input></form><footer>Tags</footer></article>"
    assert text(f"<body class='no-sidebar'><header>Site</header><div id='page' class='with-sidebar'>{own}<article class='comment'><p>I say a lot of words here as a reader of it.</p></article></div></body>") == "Title here Yes."
    assert text("<main class='layout-sidebar'><p>One word.</p><div role='alert'>Notice of it</div><div class='cookie-consent'>We use cookies</div><div style='display: none'>gone</div><p>Two <a href=x>linked</a> ones.</p></main>") == "One word. Two linked ones."
    assert text("<div class='content'><p>" + "long text of this " * 9 + "</p><ul class='menu'><li><a href=a>A</a></ul></div><div id='comments'><p>" + "reader text of this " * 9 + "</p></div>") == ("long text of this " * 9).strip()
    assert text("<article><p>a<script>x</script>b<style>y</style><noscript>z</noscript><!-- c --> d<svg><text>e</text></svg></p><ul><li>f<li>g</ul><table><tr><td>h<td>i</table><textarea>j</textarea></article>") == "ab d f g h i"


@pytest.mark.parametrize("page", [None, "", "plain", "<", "<p", "<!-- x", "<script>", "<a href='", "</p></b>", "<p>" * 3000, "\ud800"])
def test_broken(page):
    html_extract.main_text(page, html_extract.train_tree(html_extract.LABELLED))


@pytest.mark.parametrize("page", ['<a href="x ' * 90_000, '<a href="x ' * 90_001 + '">', "<div>" * 100_000 + "</b>" * 100_000, "<div></x>" * 100_000, "<i>" * 100_000 + "<div></div>" * 100_000, "<b><div>" * 60_000 + "</b>" * 60_000, "<p>" * 200_000, "<li><a>x" * 60_000, "&" * 10**6, "<" * 10**6])
def test_long_broken_pages(page):
    """About a megabyte of broken markup takes seconds."""
    began = time.time()
    html_extract.main_text(page, html_extract.train_tree(html_extract.LABELLED))
    assert time.time() - began < 20


def test_page_columns(spark):
    """Other columns are ignored, whatever their names; a page of megabytes is read whole."""
    long = "<article><p>" + "words that go on " * 200_000 + "</p></article>"
    at = spark.createDataFrame([(1, "u", PAGE, "x", 3), (2, None, long, None, None), (3, "v", "", "y", 1)], "page_id long, url string, html string, text string, n_chars long")
    found = {r["page_id"]: r for r in html_extract.extract_main_text(at).collect()}
    assert found[1]["text"].startswith("A title <here>") and found[2]["n_chars"] == len("words that go on ") * 200_000 - 1 and found[3]["text"] == "" and set(found[1].asDict()) == {"page_id", "url", "text", "n_chars"}


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()] + [(1, "u", PAGE), (None, None, None), (1, "u", PAGE)]
    found = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    by_page = {}
    for r in found:
        by_page.setdefault((r["page_id"], r["url"]), set()).add(r["text"])
    for page, url, source in rows:  # brute force: the article's own text, by its marks alone
        if source and source != PAGE:
            inner = re.search("<article>(.*?)</article>", source, re.S)[1]
            want = " ".join(html.unescape(re.sub("<(?:/?p|br|/?h1)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
            assert by_page[(page, url)] == {want}
    assert html_extract.extract_main_text(pages.limit(0)).collect() == []
