"""Main text of web pages by site template removal (operator 11).

Every page is parsed into a tree. What markup itself names as no part of the article
goes: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments, told by element, role or the words of class and id. What is left of
the page's root (its ``article`` elements, else ``main``, else the body) is hashed
element by element, a subtree's hash being made of its tag, class, text and children.
Spark counts on how many different pages of a host each hash occurs; subtrees that
recur on ``TEMPLATE_PAGES`` pages and on a share of the host's pages are the site's
template, and a second pass over the pages deletes them.

The share is ``LOOSE_SHARE`` in a body without a marked article. Inside an article it is
``FIRM_SHARE``, and what is deleted must be less than half of the article's text: hosts
publish copies of articles, whose paragraphs recur too and are no template.

Pages are not shuffled: hashes are (24 bytes an element), and the templates found are
broadcast while they are at most ``BROADCAST_KEYS``. Beyond it each page's hashes are
joined with the templates, which Spark can split for hot hosts, and the findings with the
pages by two hashes of the html.

Defined cases: null or empty html gives an empty text; pages that are equal count as
one; a page without a host in its url takes no part in the counting; an unclosed
comment, script or style lasts to the end, other unclosed elements end where HTML ends
them; character references are decoded as HTML5 does; white space is Unicode's; a
header inside an article leaves its headings; an article within an article is a reader
comment; null and repeated page_ids pass through; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import session, small_batches, written

#: A subtree on fewer pages of a host is no template.
TEMPLATE_PAGES = 5
#: The share of a host's pages that hold a template, in a body and in an article.
LOOSE_SHARE, FIRM_SHARE = 0.3, 0.8
#: Templates (16 bytes each) that are sent to every task; more are joined.
BROADCAST_KEYS = 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HEAD = frozenset("head base link meta noscript script style template title".split())
#: Elements that hold text inside a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an end tag does not reach beyond.
CELLS = frozenset("td th caption".split())
TABLES = frozenset("table html template".split())
SCOPE = CELLS | TABLES | {"object", "button"}
#: Elements whose start ends those open ones, up to the given ones.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "caption"}, {"table"}),
    "thead": ({"caption"}, {"table"}),
}
#: Elements that are never main text.
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button input select option textarea iframe object embed applet svg canvas audio video map dialog menu noembed noframes xmp title".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar tablist button".split())
#: Words of class and id that name what is not the article.
DROPPED_WORDS = frozenset(
    "ad ads adslot adsense advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar masthead skip "
    "sidebar sidebars aside widget widgets related recommended recommendations footer footers "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay paywall toast "
    "newsletter subscribe subscription signup login share sharing social "
    "comment comments commentlist disqus respond reply replies".split()
)
#: Words that may stand beside those in an id; an id with others names a part of the text, as ad-hoc-methods does.
NEUTRAL_WORDS = frozenset(
    "site page main top bottom left right primary secondary global box bar list area section wrapper container block link links form slot unit post posts article user reader google header inner outer".split()
)
#: Beside these a word of class tells about the page, as in has-sidebar.
ABOUT = frozenset("has no not with without".split())
ROOTS = frozenset("html body main".split())

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))
      | <(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|))*+)>
      | <[!?/][^>]*(?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HOST = re.compile(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


class Element:
    __slots__ = ("tag", "raw", "children", "paragraph", "verdict", "digest")

    def __init__(self, tag: str, raw: str, paragraph: int):
        self.tag, self.raw, self.children, self.paragraph, self.verdict, self.digest = tag, raw, [], paragraph, None, 0

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(self.raw)} if self.raw and not self.raw.isspace() else {}

    def judged(self) -> str:
        """'drop', 'header' or 'keep', by the element alone."""
        if self.verdict is None:
            self.verdict = "drop" if self.tag in DROPPED else "header" if self.tag == "header" else "keep"
            if self.verdict != "drop" and self.tag not in ROOTS and (found := self.attributes()):
                self.verdict = self._named(found)
        return self.verdict

    def _named(self, found: dict[str, str]) -> str:
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in DROPPED_ROLES:
            return "drop"
        for kind in ("class", "id"):
            for name in found.get(kind, "").split():
                words = {w.lower() for w in _WORD.findall(name)}
                if words & ABOUT or kind == "id" and any(not w.isdigit() and w not in DROPPED_WORDS and w not in NEUTRAL_WORDS for w in words):
                    continue
                if words & DROPPED_WORDS:
                    return "drop"
                if "header" in words and self.tag != "article":
                    return "header"
        return self.verdict


def parse(page: str) -> Element:
    """The tree of a page. Lenient as browsers are, without their repair of formatting."""
    top = Element("", "", -1)
    stack, opened, at, end = [top], {}, 0, len(page)

    def close(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().tag] -= 1

    def text(piece: str) -> None:
        if "head" in opened and opened["head"] and not piece.isspace():
            close(next(k for k, e in enumerate(stack) if e.tag == "head"))
        stack[-1].children.append(references.unescape(piece) if "&" in piece else piece)

    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        if found.start() > at:
            text(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if opened.get(tag):
                # An inline end tag stays inside its block, others inside their cell or table.
                walls = None if tag in INLINE else TABLES - {tag} if tag in CELLS or tag in ENDS or tag == "table" else SCOPE - {tag}
                for k in range(len(stack) - 1, 0, -1):
                    name = stack[k].tag
                    if name == tag:
                        close(k)
                        break
                    if name not in INLINE if walls is None else name in walls:
                        break
            elif tag == "br":
                stack[-1].children.append(" ")
            continue
        if opened.get("head") and tag not in HEAD:
            close(next(k for k, e in enumerate(stack) if e.tag == "head"))
        if tag in ENDS:
            ended, walls = ENDS[tag]
            if any(opened.get(x) for x in ended):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ended:
                        close(k)
                        break
                    if stack[k].tag in walls:
                        break
        if tag not in INLINE and tag not in VOID and stack[-1].paragraph > 0:
            close(stack[-1].paragraph)
        elif tag == "hr" and stack[-1].paragraph > 0:
            close(stack[-1].paragraph)
        if tag in VOID:
            if tag not in ("wbr", "img", "input"):
                stack[-1].children.append(" ")
            continue
        element = Element(tag, found[3], len(stack) if tag == "p" else -1 if tag in SCOPE else stack[-1].paragraph)
        stack[-1].children.append(element)
        if tag in RAW:
            closing = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = end if closing is None else (page.find(">", closing.end()) + 1 or end)
            continue
        stack.append(element)
        opened[tag] = opened.get(tag, 0) + 1
    return top


def roots(top: Element) -> tuple[list[Element], bool]:
    """The elements that hold the article, and whether markup names them."""
    articles, mains, todo = [], [], [top]
    while todo:
        node = todo.pop()
        if node.judged() == "drop":
            continue
        if node.tag == "article":
            articles.append(node)
            continue
        if node.tag == "main" or ("main" in node.raw and node.attributes().get("role", "").lower() == "main"):
            mains.append(node)
        todo.extend(c for c in reversed(node.children) if c.__class__ is Element)
    if articles or mains:
        return articles or mains[:1], True
    return [top], False


def _kept(node: Element, firm: bool) -> list:
    """The children that count. Of a header inside an article only headings do."""
    out = []
    for c in node.children:
        if c.__class__ is Element:
            verdict = c.judged()
            if verdict == "drop" or (firm and c.tag == "article") or (verdict == "header" and not firm):
                continue
            if verdict == "header" and c.tag not in HEADINGS:
                inner, todo = [], [c]
                while todo:
                    x = todo.pop()
                    if x.tag in HEADINGS:
                        inner.append(x)
                    else:
                        todo.extend(y for y in reversed(x.children) if y.__class__ is Element and y.judged() != "drop")
                out += inner
                continue
        out.append(c)
    return out


def _pruned(root: Element, firm: bool) -> list[Element]:
    """Take out what is not main text by its own markup; the elements that stay, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.children = _kept(node, firm)
        order.append(node)
        todo.extend(c for c in node.children if c.__class__ is Element)
    return order


def _digest(order: list[Element], firm: bool, site: bytes) -> set[int]:
    """Hash every subtree of a pruned root; the hashes of the blocks below it that hold text."""
    blocks = set()
    for node in reversed(order):
        parts, holds = [], False
        for c in node.children:
            if c.__class__ is Element:
                parts.append(b"\x01%x" % c.digest if c.digest else b"")
                holds |= c.digest != 0
            else:
                words = c.split()
                holds |= bool(words)
                parts.append(" ".join(words).encode("utf-8", "surrogatepass"))
        kind = node.tag + ("\x02" + node.attributes().get("class", "") if node.raw else "")
        node.digest = xxhash.xxh3_64_intdigest(b"\x00".join([site, b"1" if firm else b"0", kind.encode("utf-8", "surrogatepass"), *parts])) or 1 if holds else 0
        if holds and node is not order[0] and node.tag not in INLINE:
            blocks.add(node.digest)
    return blocks


def _text(root: Element, gone: set[int]) -> str:
    parts, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.__class__ is str:
            parts.append(node)
        elif node.tag in INLINE:
            todo.extend(reversed(node.children))
        elif node.digest not in gone or node is root:
            parts.append(" ")
            todo.append(" ")
            todo.extend(reversed(node.children))
    return " ".join("".join(parts).split())


def site_of(url: str | None) -> bytes:
    found = _HOST.match(url or "")
    return found[1].lower().encode("utf-8", "surrogatepass") if found else b""


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def page_keys(page: str, site: bytes) -> tuple[set[int], bool]:
    """The hashes of the blocks in the page's roots, and whether markup names the roots."""
    found, firm = roots(parse(page))
    return set().union(*(_digest(_pruned(r, firm), firm, site) for r in found)), firm


def extract(page: str | None, url: str | None, known) -> str:
    """The main text of a page; ``known`` holds the signed hashes of templates, none if its site has none."""
    if not page:
        return ""
    found, firm = roots(parse(page))
    texts = []
    for root in found:
        order = _pruned(root, firm)
        gone = {k for k in _digest(order, firm, site_of(url)) if _signed(k) in known} if known else set()
        text = _text(root, gone)
        if firm and gone:
            whole = _text(root, set())
            text = text if 2 * len(text) > len(whole) else whole
        texts.append(text)
    return " ".join(t for t in texts if t)


_KEYS = pa.schema([("site", pa.int64()), ("key", pa.int64()), ("firm", pa.bool_()), ("page", pa.int64()), ("page2", pa.int64())])


def subtrees(pages: DataFrame) -> DataFrame:
    """site, key, firm, page, page2: the blocks of every page that has a host, and one row with a null key for itself."""

    def hashed(batches):
        for batch in batches:
            out: list[list] = [[] for _ in _KEYS]
            for url, page, *names in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "page", "page2"))):
                if page and (site := site_of(url)):
                    keys, firm = page_keys(page, site)
                    own, host = [None, *map(_signed, keys)], _signed(xxhash.xxh3_64_intdigest(site))
                    for column, values in zip(out, ([host] * len(own), own, [firm] * len(own), *([n] * len(own) for n in names))):
                        column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _KEYS)], schema=_KEYS)

    named = pages.select("url", "html", F.xxhash64("html").alias("page"), F.xxhash64(F.lit(1), "html").alias("page2"))
    return named.mapInArrow(hashed, "site bigint, key bigint, firm boolean, page bigint, page2 bigint")


def templates(blocks: DataFrame, least: int = TEMPLATE_PAGES, loose: float = LOOSE_SHARE, firm: float = FIRM_SHARE) -> DataFrame:
    """site, key, n_pages, site_pages of the subtrees that are a site's template."""
    counts = blocks.groupBy("site", "key").agg(F.countDistinct("page", "page2").alias("n_pages"), F.max("firm").alias("firm"))
    counts = written(counts.filter(F.col("key").isNull() | (F.col("n_pages") >= least)), "subtrees")
    sites = counts.filter(F.col("key").isNull()).select("site", F.col("n_pages").alias("site_pages"))
    share = F.when(F.col("firm"), F.lit(firm)).otherwise(F.lit(loose))
    return counts.filter(F.col("key").isNotNull()).join(sites, "site").filter(F.col("n_pages") >= share * F.col("site_pages")).select("site", "key", "n_pages", "site_pages")


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def _rows(batch, texts):
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_TEXT)


def main_text(pages: DataFrame, least: int = TEMPLATE_PAGES, loose: float = LOOSE_SHARE, firm: float = FIRM_SHARE, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = session(pages)
    small_batches(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = written(templates(subtrees(pages), least, loose, firm).select("site", "key"), "templates")
    if found.count() <= broadcast_keys:
        sent = spark.sparkContext.broadcast(np.array([(r.site, r.key) for r in found.collect()], np.int64).reshape(-1, 2))

        def by_broadcast(batches):
            sites, keys = (set(sent.value[:, k].tolist()) for k in (0, 1))
            for batch in batches:
                rows = zip(batch.column("html").to_pylist(), batch.column("url").to_pylist())
                yield _rows(batch, [extract(page, url, keys if _signed(xxhash.xxh3_64_intdigest(site_of(url))) in sites else ()) for page, url in rows])

        return pages.mapInArrow(by_broadcast, SCHEMA)

    own = subtrees(pages).filter(F.col("key").isNotNull()).join(found, ["site", "key"]).groupBy("page", "page2", "site").agg(F.collect_set("key").alias("gone"))

    def by_join(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("html", "url", "gone")))
            yield _rows(batch, [extract(page, url, frozenset(gone or ())) for page, url, gone in rows])

    # Pages that are equal are in one row of ``own`` for each of their hosts; hashes of another host's blocks match nothing.
    own = own.groupBy("page", "page2").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    named = pages.withColumns({"page": F.xxhash64("html"), "page2": F.xxhash64(F.lit(1), "html")})
    return named.join(own, ["page", "page2"], "left").select("page_id", "url", "html", "gone").mapInArrow(by_join, SCHEMA)


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
