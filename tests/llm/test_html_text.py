"""Main text against an extraction of its own with the standard library's parser, and fixtures of sites."""

from html.parser import HTMLParser

import pytest

from fellway.llm import html_text as ht
from fellway.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


class Article(HTMLParser):
    """The text inside article elements of simple pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.parts.append("" if tag in ht.INLINE else " ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.parts.append("" if tag in ht.INLINE else " ")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def plain(page):
    parser = Article()
    parser.feed(page)
    parser.close()
    return " ".join("".join(parser.parts).split())


def test_query_equals_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    frame = QUERIES["op11_html_text"](spark, SF)
    assert frame.columns == ["page_id", "url", "text", "n_chars"]
    got = frame.collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


CASES = [
    ("", ""), (" ", ""), ("just text &amp; more", "just text & more"), ("<p>a<p>b", "a b"), ("<p>one<br>two</p>three", "one two three"),
    ("<p>f<b>oo</b>bar&nbsp; \n x&#x41;&copy</p>", "foobar xA©"), ("a < b and 3<4 &lt;p&gt;", "a < b and 3<4 <p>"),
    ("<article><nav>menu</nav><h1>T</h1><p>x</p><script>if (a</p>b) '</scr'</script>y<style>p{}</style></article>out", "T x y"),
    ("<nav>m</nav><main><p>x</p></main><footer>f", "x"), ("<header>h<h1>Site</h1></header><p>x", "x"),
    ("<article><header><div>by me</div><h1>T</h1></header>x</article>", "T x"), ("<article>x<article>a comment</article></article>", "x"),
    ("<article>x<section class='comments'><p>nice</p></section><div id=reader-comments>c</div></article>", "x"),
    ("<div class='siteAd'>buy</div><div class=\"cookie-notice\">c</div><aside>s</aside><form>f<input></form><p class=lead>x</p>", "x"),
    ("<body class='has-sidebar'><div class=sidebar>s</div><div class='with-sidebar'>x</div>", "x"), ("<p hidden>no</p><div role=navigation>n</div>x", "x"),
    ("x<!-- <p>no</p> -->y<!-->z<!-- to the end <p>w", "xyz"), ("x<script>never closed <p>w", "x"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", "a b c d"), ("<a title='>' href=x>in</a><p don't>it's", "in it's"), ("<!DOCTYPE html><?x y?>t</p></b>u", "tu"),
    ("<h2 id=related-work>Related</h2><section id='ad-hoc-methods'>x</section><div id='cookie-banner-2'>c</div><div id=siteHeader>h</div>", "Related x"),
    ("<p><b>a<p>c</b>d", "a cd"), ("<title>t</title>x", "x"), ("<dl><dt>a<dd>b<dt>c</dl><pre> d\n\n e</pre>", "a b c d e"), ("<SCRIPT>x</SCRIPT><P>É</P>", "É"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_markup(page, text):
    assert ht.extract(page, "http://h/", ()) == text


def test_long_and_deep():
    assert ht.extract("<p>w " * 200_000, "http://h/", ()) == " ".join(["w"] * 200_000)
    assert ht.extract("<div>" * 50_000 + "x" + "</div>" * 50_000 + "y", "http://h/", ()) == "x y"
    assert ht.extract("<a href=\"" * 3000 + "x", "http://h/", ()) is not None


def sites():
    """Pages with templates that no markup names."""
    rows, want = [], []

    def add(url, page, text):
        rows.append((len(rows), url, page, "x", len(rows)))
        want.append(text)

    for k in range(12):
        same = "<p>read in every copy of this article</p>" if k < 8 else ""
        add(f"http://one.example/{k}", f"<div>Our <b>site</b> map<ul><li>Home</ul></div><div><p>story {k}</p>{same}</div><div>Follow us &copy; one</div>", f"story {k}" + (" read in every copy of this article" if k < 3 else ""))
        add(f"http://two.example/{k}", f"<article><h1>T{k}</h1><p>body {k} of the second site</p><div>Tell a friend</div></article>", f"T{k} body {k} of the second site")
        add(f"http://copies.example/{k}", f"<nav>{k}</nav><article><h1>Same</h1><p>the same article on every page</p></article>", "Same the same article on every page")
        add(None if k % 2 else "no host", f"<div>common</div><p>x{k}</p>", f"common x{k}")
        add("http://same.example/", "<div>one page, many rows</div>", "one page, many rows")
    for k in range(4):
        add(f"http://few.example/{k}", f"<div>common</div><p>x{k}</p>", f"common x{k}")
    return rows, want


@pytest.mark.parametrize("broadcast_keys", [1_000_000, 0])
def test_templates_of_sites(spark, broadcast_keys):
    rows, want = sites()
    want = [t.replace(" read in every copy of this article", "") if t.startswith("story") else t for t in want]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, key string, page bigint").repartition(6)
    got = {r.page_id: r.text for r in ht.main_text(pages, broadcast_keys=broadcast_keys).collect()}
    assert [got[k] for k in range(len(rows))] == want
    found = ht.templates(ht.subtrees(pages)).collect()
    assert {(r.n_pages, r.site_pages) for r in found} >= {(12, 12), (8, 12)}


@pytest.mark.parametrize("broadcast_keys", [1_000_000, -1])
def test_odd_rows(spark, broadcast_keys):
    schema = "page_id bigint, url string, html string, site string, gone string"
    rows = [(None, None, None, "a", "b"), (1, "http://h/", None, "a", "b"), (1, "http://h/", "", "a", "b"), (1, "http://h/", "<p>x", "a", None), (1, "http://h/", "<p>x", "a", None)]
    got = ht.main_text(spark.createDataFrame(rows, schema), broadcast_keys=broadcast_keys).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, None, "", 0), (1, "http://h/", "", 0), (1, "http://h/", "", 0), (1, "http://h/", "x", 1), (1, "http://h/", "x", 1)], key=repr)
    assert ht.main_text(spark.createDataFrame([], schema), broadcast_keys=broadcast_keys).collect() == []
