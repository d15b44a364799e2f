"""Main text of web pages: site templates found by subtree hashes counted per host, and the roles of elements.

A page is parsed into elements, and each element's subtree (tags, classes, normalised text) is hashed from the leaves up, in one pass over
the whole page: menus, headers, footers, notices and adverts as well as the article. Spark counts for each host the distinct contents (articles; whole pages where there is no
article) whose pages hold a subtree. A block element's subtree that stands with MIN_PAGES contents of a host or more, and with MIN_SHARE of them, is the site's
template and is deleted, wherever it stands. Copies of an article count once, so they are no template. The page's frame (html, body, article, main) is never a
template, nor is flow text of an article (paragraphs, headings, list items, cells): only boxes are.

What a template can't show is decided by the element's own role: tags and ARIA roles that say menu, header, footer, sidebar, advert, form, script or style; and boxes
whose class is just `comments`, `ad` or another word of VARYING, as their text is each page's own. Other class words (FIXED) count only on
hosts with fewer than MIN_PAGES contents, where nothing can be counted. Ids never count. If an article or main element is left, the text is in there; else in the body.

Kept blocks have their character references decoded and white space turned into single spaces; empty ones go; a line feed joins them.
Null html is an empty page. Hosts of null or odd addresses are one host with an empty name. Rows of equal id are pages as others are. An empty table gives an empty result.

Templates go to the pages by a broadcast of each host's list if they are BROADCAST_ROWS at most, and LIST_ROWS a host (both counted), else as each page's own list, by a join
on (host, hash of the html); both give the same rows.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

MIN_PAGES, MIN_SHARE, BROADCAST_ROWS, LIST_ROWS = 5, 0.05, 50_000, 512
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
GONE = frozenset(
    "script style noscript template iframe svg math canvas object embed audio video head title nav footer aside form button select textarea input menu dialog map datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu"
    " nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
FRAME = frozenset("#root html head body article main".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
BOXES = frozenset("div section ul ol dl table figure fieldset details center header".split())
#: Classes of boxes whose text differs from page to page, so that no count can show what they are.
VARYING = frozenset("comments comment comment-list comments-area reader-comments ad ads advert adverts advertisement advertising sponsored".split())
#: Classes that matter on hosts with too few pages only.
FIXED = frozenset(
    "menu nav navbar navigation breadcrumb breadcrumbs header site-header page-header masthead footer site-footer page-footer sidebar notice cookie-notice cookie-banner cookies consent banner"
    " promo newsletter subscribe share sharing social related-posts pagination toolbar skip-link login search".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*))(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?(?=[\s/]|$)", re.I)
#: A stray end tag of another element closes none of these.
WALLS = frozenset(("article", "main", "body", "table"))
PASSES_WALLS = frozenset(("body", "html", "article", "main", "table", "div", "section"))


class Node:
    __slots__ = ("tag", "names", "role", "children", "parent", "hash")

    def __init__(self, tag, names, role, parent):
        self.tag, self.names, self.role, self.parent, self.children, self.hash = tag, names, role, parent, [], 0


class Parser:
    """The open elements form a path from the root to top; opened counts them by tag, so that no search climbs the path in vain."""

    def __init__(self):
        self.root = self.top = Node("#root", "", "", None)
        self.opened: dict[str, int] = {}

    def push(self, node: Node) -> None:
        self.top = node
        self.opened[node.tag] = self.opened.get(node.tag, 0) + 1

    def pop_to(self, node: Node) -> None:
        """Closes node and all that is open inside it."""
        while True:
            done = self.top
            self.opened[done.tag] -= 1
            self.top = done.parent
            if done is node:
                return

    def end(self, tag: str) -> None:
        if not self.opened.get(tag):
            return
        node = self.top
        while node.tag != tag:
            if node.tag in WALLS and tag not in PASSES_WALLS:
                return
            node = node.parent
        self.pop_to(node)

    def implied_ends(self, tag: str) -> None:
        """A block ends an open paragraph; a list item, cell or row ends the one before it."""
        paragraph, closes, scope = tag in CLOSES_P and self.opened.get("p"), CLOSES.get(tag, ()), SCOPE.get(tag, ())
        if not paragraph and not any(self.opened.get(t) for t in closes):
            return
        node, close = self.top, None
        while node.parent:
            if node.tag == "p" and paragraph or node.tag in closes:
                close = node
                if node.tag == "p":
                    break
            elif node.tag in scope or node.tag in BLOCK and not (closes and node.tag in CLOSES):
                break
            node = node.parent
        if close:
            self.pop_to(close)

    def start(self, tag: str, rest: str) -> Node:
        if tag in CLOSES_P or tag in CLOSES:
            self.implied_ends(tag)
        found = {}
        if "=" in rest or "hidden" in rest:
            found = {a[0].lower(): a[1] or a[2] or a[3] or a[0] for a in ATTRIBUTE.findall(rest)}
        node = Node(tag, found.get("class", "").lower(), "hidden" if "hidden" in found else found.get("role", "").lower(), self.top)
        self.top.children.append(node)
        return node


def parse(page: str) -> Node:
    p, at = Parser(), 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            p.top.children.append(page[at:])
            break
        if m.start() > at:
            p.top.children.append(page[at : m.start()])
        at = m.end()
        slash, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag, rest = tag.lower(), rest or ""
        if slash:
            p.end(tag)
            continue
        node = p.start(tag, rest)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else len(page)])
            close = page.find(">", end.end()) if end else -1
            at = len(page) if close < 0 else close + 1
        elif tag not in VOID and not rest.endswith("/"):
            p.push(node)
    return p.root


def in_order(root: Node) -> list[Node]:
    """All elements, each before its children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def hash_subtrees(nodes: list[Node]) -> None:
    """Each element's hash from those of its children: one pass, from the last element to the first. Scripts and styles are left out, as are blank texts."""
    import xxhash

    for node in reversed(nodes):
        if node.tag in ("script", "style"):
            continue
        h = xxhash.xxh64(f"{node.tag} {node.names}".encode("utf-8", "replace"))
        for c in node.children:
            if isinstance(c, Node):
                h.update(b"\1" + c.hash.to_bytes(8, "little"))
            elif text := " ".join(entities.unescape(c).split()):
                h.update(b"\0" + text.encode("utf-8", "replace"))
        node.hash = h.intdigest()


def signed(h: int) -> int:
    return h - (1 << 63)


def labelled(node: Node, words: frozenset) -> bool:
    """Whether one of the classes of a box is one of the words."""
    return bool(node.names) and node.tag in BOXES and not words.isdisjoint(node.names.split())


def gone(node: Node, in_article: bool, few_pages: bool) -> bool:
    """Whether the element's own role says that it isn't text of the page."""
    if node.tag in GONE or node.tag == "header" and not in_article or node.role in ROLES or node.role == "hidden":
        return True
    if node.tag == "article":  # a reader's comment that is marked up as an article
        return not VARYING.isdisjoint(node.names.split())
    return labelled(node, VARYING) or few_pages and labelled(node, FIXED)


def content(root: Node, templates: frozenset, few_pages: bool) -> tuple[list[Node], bool]:
    """The elements that hold the text, in page order, and whether they are articles or main elements."""
    articles, mains = [], []
    todo = [(root, False)]
    while todo:
        node, in_main = todo.pop()
        if node.tag == "article":
            articles.append(node)
            continue
        if (node.tag == "main" or node.role == "main") and not in_main:
            mains.append(node)
            in_main = True
        for c in reversed(node.children):
            if isinstance(c, Node) and not gone(c, False, few_pages) and (c.tag in FRAME or signed(c.hash) not in templates):
                todo.append((c, in_main))
    return (articles, True) if articles else (mains, True) if mains else ([root], False)


def candidates(page: str | None) -> tuple[int, list[int]]:
    """A hash of the page's content (its articles, else all of it), and the distinct subtrees that may be a template."""
    if not page:
        return 0, []
    root = parse(page)
    nodes = in_order(root)
    hash_subtrees(nodes)
    tops, has_article = content(root, frozenset(), False)
    own = 0
    for t in tops:
        own = (own * 0x100000001B3 + t.hash) & 0xFFFFFFFFFFFFFFFF
    inside = set()
    if has_article:
        inside = {id(x) for t in tops for x in in_order(t)}
    found = {}
    for x in nodes:
        if x.tag in (BOXES if id(x) in inside else BLOCK) and x.tag not in FRAME:
            found[signed(x.hash)] = None
    return signed(own), list(found)


def walk(page: str | None, templates: frozenset = frozenset(), few_pages: bool = True) -> str:
    """The text without the templates (subtree hashes)."""
    if not page:
        return ""
    root = parse(page)
    if templates:
        hash_subtrees(in_order(root))
    tops, in_article = content(root, templates, few_pages)
    top_ids = {id(t) for t in tops}
    blocks: list[str] = []
    line: list[str] = []

    def end():
        if line:
            text = " ".join(entities.unescape("".join(line)).split())
            if text:
                blocks.append(text)
            line.clear()

    # An explicit stack: depth is the page's, not Python's.
    todo: list = [x for top in reversed(tops) for x in (end, top, end)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            line.append(x)
        elif not isinstance(x, Node):
            x()
        else:
            if id(x) not in top_ids:
                if gone(x, in_article, few_pages):
                    line.append(" ")
                    continue
                if templates and x.tag in (BOXES if in_article else BLOCK) and x.tag not in FRAME and signed(x.hash) in templates:
                    end()
                    continue
            if x.tag in BLOCK:
                end()
                todo.append(end)
            elif x.tag == "br":
                line.append(" ")
            todo += x.children[::-1]
    end()
    return "\n".join(blocks)


def _candidates(batches):
    import pyarrow as pa

    for b in batches:
        rows, content_of, found = [], [], []
        for i, page in enumerate(b.column(3)):
            own, subtrees = candidates(page.as_py())
            rows += [i] * len(subtrees)
            content_of += [own] * len(subtrees)
            found += subtrees
        at = pa.array(rows, pa.int64())
        columns = [b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(content_of, pa.int64()), pa.array(found, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "h1", "h2", "content", "subtree"])


def _texts(batches):
    import pyarrow as pa

    for b in batches:
        texts = [walk(p.as_py(), frozenset(t.as_py() or ()), few.as_py()) for p, t, few in zip(b.column(2), b.column(3), b.column(4), strict=True)]
        columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_templates(found: DataFrame, min_pages: int, min_share: float) -> tuple[DataFrame, DataFrame]:
    """(host, subtree) of the templates, and (host, n_contents). Partial counts meet before the shuffle, so a host with very many pages is no hot key."""
    contents = found.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n_contents"))
    often = found.select("host", "subtree", "content").distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    return often.join(contents, "host").where(F.col("n") >= min_share * F.col("n_contents")).select("host", "subtree"), contents


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    scratch = Scratch(pages.sparkSession)
    page = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    url = F.col(f"`{url_col}`")
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), url.alias("url"), host_of(url).alias("host"),
        F.xxhash64(page).alias("h1"), F.xxhash64(F.lit(1), page).alias("h2"), F.col(f"`{html_col}`").alias("html"),
    )
    found = rows.select("host", "h1", "h2", "html").mapInArrow(_candidates, "host string, h1 long, h2 long, content long, subtree long")
    found = scratch.keep(found)
    templates, contents = site_templates(found, min_pages, min_share)
    templates = scratch.keep(templates)
    hosts = scratch.keep(contents.where(F.col("n_contents") >= min_pages).select("host", F.lit(False).alias("few")))
    n = hosts.count()
    total, longest = templates.groupBy("host").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    if n + total <= broadcast_rows and longest <= LIST_ROWS:
        lists = hosts.join(templates.groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("templates")), "host", "left")
        joined = rows.join(F.broadcast(scratch.keep(lists)), "host", "left")
    else:
        own = found.select("host", "h1", "h2", "subtree").distinct().join(templates, ["host", "subtree"])
        hits = own.groupBy("host", "h1", "h2").agg(F.sort_array(F.collect_list("subtree")).alias("templates"))
        joined = rows.join(scratch.keep(hits), ["host", "h1", "h2"], "left").join(F.broadcast(hosts) if n <= broadcast_rows else hosts, "host", "left")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ready = joined.select("page_id", "url", "html", "templates", F.coalesce("few", F.lit(True)).alias("few"))
    return ready.mapInArrow(_texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
