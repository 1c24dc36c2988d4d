"""HTML extraction (op 2): consensus paths of a host.

Each page's containers are scored by the text of the blocks they hold, and the
best one votes with its generalised path, tags with classes from the body down,
digits masked. Votes are counted by host in Spark, with partial counts before
the shuffle, and each page is read again at its host's winning path.

Blocks begin and end at block-level tags; a line break is white space. Menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup
and reader comments are left out, by tag, role, class or id.

Edge cases: null and empty pages have empty text; a page without the host's
path is read at its own best container, and one without containers at its body;
ties between paths go to the higher total score, then the first in order; of
several containers with the path, the best and those beside it are read;
unclosed and misnested tags end with the container around them; pages whose url
is null or has no host share the empty host; repeated rows get the same text; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_columns, salted, slices, table, written

#: HTML's element kinds.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "select", "object", "canvas", "audio", "video", "title", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "button"}
CONTAINERS = {"article", "main", "section", "div", "body", "td", "center"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "pre", "blockquote", "figure", "figcaption", "table", "thead", "tbody", "tfoot", "tr", "th", "caption", "hr", "address", "header", "details", "summary", "html", "fieldset"} | SKIPPED

def _words(words: str) -> re.Pattern:
    """Any of these as a whole word of a class or id."""
    return re.compile(rf"(?:^|[\s_-])(?:{'|'.join(words.split())})(?:$|[\s_-])", re.I)


#: Words of a class or id that mark what is not the article, whatever element has them.
BOILER = _words(
    "ads? adverts? advertisements? advertising sponsored cookies? consent popup modal overlay newsletter breadcrumbs? "
    "comments? replies respond disqus masthead pagination pager copyright"
)
#: Words that can also name a part of the article: they count outside it, and inside it for boxes, not for its paragraphs.
MAYBE = _words(
    "notice side related share social foot search legal banner sponsors? promos? promotions? promoted subscribe subscriptions? subscribers? "
    "nav navs navbar navigation menus? sidebars? widgets? recommended recommends recommendations? sharing footers? topbar toolbar login signup"
)
#: Elements that hold text itself.
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "td", "th", "figcaption"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
#: What stands in a tag: a quote opens a value only right after its sign of equality; an unclosed one runs to the end, as the standard has it.
_VALUE = r"\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:{_VALUE}|(?=>)|\Z))*+)(?:>|\Z)", re.S)
_ATTR = re.compile(rf"([^\s=/>]+)(?:\s*=\s*({_VALUE}))?")
PATH_CHARS = 400
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_IMPLIED = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


def bounded(path: str) -> str:
    """A path of over ``PATH_CHARS`` characters as its beginning and a digest of all of it, so that deep pages stay small."""
    return path if len(path) <= PATH_CHARS else f"{path[:200]}~{xxhash.xxh3_128_hexdigest(path)}"


class Node:
    """A block element: its generalised name, blocks in page order and whether it is left out."""

    __slots__ = ("tag", "name", "skip", "path", "parent", "score", "first", "last")

    def __init__(self, tag: str, name: str, skip: bool, parent: Node | None, first: int):
        self.tag, self.name, self.skip, self.parent = tag, name, skip, parent
        self.path = name if parent is None or parent.tag in ("html", "#root") else bounded(f"{parent.path}>{name}")
        self.score, self.first, self.last = 0.0, first, first


def inside(node: Node | None) -> bool:
    """Whether an element is or stands in an article."""
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def _node(tag: str, attrs: str, parent: Node | None, first: int) -> Node:
    name, skip = tag, tag in SKIPPED
    if attrs.strip():
        a: dict[str, str] = {}
        for k, v in _ATTR.findall(attrs):  # of attributes of one name the first counts
            a.setdefault(k.lower(), html.unescape(v[1 : -1 if v[-1] == v[0] and len(v) > 1 else None] if v[:1] in ("'", '"') else v))
        name = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in a.get("class", "").split()})])
        marks = f"{a.get('class', '')} {a.get('id', '')}"
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I)
        if tag not in ("body", "html", "article", "main") and (BOILER.search(marks) or a.get("role", "").lower() in ROLES):
            skip = True
        elif tag not in ("body", "html", "article", "main") and MAYBE.search(marks):
            skip = tag not in TEXTUAL or not inside(parent)
        skip = skip or bool(hidden)
    # a header inside an article is its heading; elsewhere it is the page's
    if tag == "header":
        skip = skip or not inside(parent)
    return Node(tag, name, skip or bool(parent and parent.skip), parent, first)


def parse(page: str) -> tuple[list[tuple[str, Node, float]], list[Node]]:
    """Blocks (text, element, characters in links) in page order, and the block elements."""
    root = Node("#root", "", False, None, 0)
    top, nodes, blocks = root, [], []
    text: list[str] = []
    linked, in_link = 0, 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            s = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if s and not top.skip:
                blocks.append((s, top, float(min(linked, len(s)))))
            text.clear()
        linked = 0

    def close(node: Node) -> None:
        node.last = len(blocks)

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            if in_link:
                linked += size - at
            break
        if m.start() > at:
            text.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCKS:
                flush()
                up = top
                while up is not root and up.tag != tag:
                    up = up.parent
                if up is not root:
                    while top is not up:
                        close(top)
                        top = top.parent
                    close(top)
                    top = top.parent
            continue
        if tag in RAW:
            if tag != "head" and not m[3].endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else size
            elif tag == "head":
                end = _RAW_END[tag].search(page, at)
                # a head that is never closed holds only what may stand in a head
                at = end.end() if end else at
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = 1 if not m[3].endswith("/") else in_link
        elif tag in BLOCKS:
            flush()
            if tag == "hr":
                continue
            # an element that a new one ends, unless a container stands between
            if ends := _IMPLIED.get(tag):
                up = top
                while up is not root and up.tag not in CONTAINERS and up.tag not in ("ul", "ol", "table") and up.tag not in ends:
                    up = up.parent
                if up is not root and up.tag in ends:
                    while top is not up.parent:
                        close(top)
                        top = top.parent
            elif top.tag == "p":
                close(top)
                top = top.parent
            top = _node(tag, m[3], top, len(blocks))
            nodes.append(top)
    flush()
    while top is not root:
        close(top)
        top = top.parent
    for s, node, in_links in blocks:
        worth = len(s) - 2 * in_links
        if worth <= 0:
            continue
        up, share = node, 1.0
        while up is not None and share > 0.2:
            if up.tag in CONTAINERS:
                up.score += worth * share
                share /= 2
            up = up.parent
    return blocks, nodes


def best(nodes: list[Node]) -> Node | None:
    """The container with the highest score; of equals the one that comes first."""
    found = None
    for n in nodes:
        if n.tag in CONTAINERS and not n.skip and n.score > 0:
            # what is an article by name counts for more than the same text in a nameless box
            worth = n.score * (1.3 if n.tag in ("article", "main") else 0.9 if n.tag == "body" else 1.0)
            if found is None or worth > found[0]:
                found = (worth, n)
    return found and found[1]


def text_at(page: str | None, path: str | None) -> str:
    """The main text of a page, read at ``path`` where the page has it."""
    if not page:
        return ""
    blocks, nodes = parse(page)
    same = [n for n in nodes if path and n.path == path and n.tag in CONTAINERS and not n.skip and n.score > 0]
    node = max(same, key=lambda n: n.score) if same else best(nodes)
    if node is None:
        return "\n\n".join(s for s, _, _ in blocks)
    # an article can be cut into containers of one path that stand side by side
    beside = [n for n in same if n.parent is node.parent] or [node]
    return "\n\n".join(s for n in beside for s, _, _ in blocks[n.first : n.last])


def host_of(url: str = "url") -> Column:
    part = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(part, r"^.*@", ""), r":\d*$", ""))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, pages = b.column(0).to_pylist(), b.column(1).to_pylist()
        out = []
        for h, p in zip(hosts, pages):
            node = best(parse(p)[1]) if p else None
            if node is not None:
                out.append((h, node.path, node.score))
        kinds = (pa.string(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, kinds)], ["host", "path", "score"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of a host."""
    votes = pages.select(host_of().alias("host"), "html").mapInArrow(_vote, "host string, path string, score double")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 3).alias("total"))
    order = F.struct(-F.col("n"), -F.col("total"), F.col("path"))
    return counted.groupBy("host").agg(F.min(order).getField("path").alias("path"))


#: Winning paths of at most so many bytes go to all executors; more are joined by host, large hosts in parts.
BROADCAST_BYTES = 16 << 20


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pages, paths = b.column(2).to_pylist(), b.column(3).to_pylist()
        for lo, hi in slices(pages, 8_000_000):
            texts = [text_at(p, w) for p, w in zip(pages[lo:hi], paths[lo:hi])]
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(texts, pa.string()), n], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its code points for every row of ``pages``."""
    kept_columns(pages, ("page_id", "url", "html"))
    paths = written(winning_paths(pages))
    size = paths.agg(F.sum(F.length("host") + F.length("path") + 64)).first()[0] or 0
    marked = pages.select("page_id", "url", "html").withColumn("__h", host_of())
    paths = paths.withColumnRenamed("host", "__h")
    joined = marked.join(F.broadcast(paths), "__h", "left") if size <= BROADCAST_BYTES else salted(marked, paths, ["__h"], "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(_read, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
