"""Main text of web pages, with the templates of their sites removed.

Every block element of a page is hashed with all that it holds. Spark counts, per host, on how many different pages each
hash occurs; what recurs on many of them is template and is deleted. From the rest the article is taken, without the parts
that HTML itself or their class names mark as no part of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealwright.llm.common import BATCH_BYTES, stored

#: A subtree is template if it is on so many different pages of its host.
MIN_PAGES = 5

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element: the element, and what stops the search for it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Elements whose text is never main text.
OUTSIDE = frozenset(
    "head script style noscript template iframe object embed svg math canvas audio video map nav footer aside form button "
    "select textarea dialog menu search title xmp noembed noframes datalist".split()
)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in classes and ids of what is beside the article: menus, headers, footers, sidebars, notices, adverts, comments.
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices "
    "notification pager pagination popup promo promotion related reply replies respond share sharing sidebar signup skip "
    "social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that, within an article, may stand beside those names in a class or id that marks what is no part of it. Others
#: tell that the name is about the text (``reply-to-critics``).
STRUCTURE = frozenset(
    "area articles bar block body bottom box btn button buttons center column container content fixed form group icons "
    "inline inner item items left line link links list main middle nav outer panel post posts row section site slot small "
    "sticky tool tools top right unit wrap wrapper".split()
)
#: Words that name readers' comments whatever stands before them in a class, and words for those who wrote them.
COMMENTS = frozenset("comments commentlist replies".split())
READERS = frozenset("reader readers user users visitor visitors guest guests member members".split())
#: Elements whose ids within an article are slugs of their text.
SLUGGED = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are text of the article itself; within it, they are never taken for template.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre body html article main td th li dd dt".split())

_TOKEN = re.compile(
    r"<!--(?:(?!-->).)*+(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<(?P<broken>/?[a-zA-Z][^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_CLASS_OR_ID = re.compile(r"""(?<![\w-])(class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_ROLE = re.compile(r"""\brole\s*=\s*["']?([a-zA-Z]+)""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}


@dataclass
class Node:
    tag: str
    attrs: str = ""
    children: list = field(default_factory=list)  # texts and nodes
    hash: int = 0


def parse(html: str) -> Node:
    """A tree of the elements; never fails, whatever the markup. Raw elements keep no text."""
    root = Node("#root")
    stack, at = [root], 0
    while at < len(html):
        m = _TOKEN.match(html, at)
        at = m.end()
        if m["text"] is not None:
            stack[-1].children.append(m["text"])
            continue
        name = m["tag"] or m["broken"]
        if name is None:
            continue
        end = m["end"] if m["tag"] else name[:1] == "/"
        tag = _SPLIT.split(name.lstrip("/").lower() + " ", 1)[0] if m["broken"] else name.lower()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in BLOCK and tag != "p" and stack[-1].tag == "p" or tag == "p":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSES:
            ended, stops = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stops:
                    break
                if stack[i].tag in ended:
                    del stack[i:]
        node = Node(tag, m["attrs"] or "")
        stack[-1].children.append(node)
        if tag in RAW:
            found = _RAW_END[tag].search(html, at)
            at = found.end() if found else len(html)
        elif tag not in VOID and not node.attrs.endswith("/"):
            stack.append(node)
        elif node.attrs.endswith("/") and tag not in VOID:
            stack.append(node)
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes, parents before their children; without recursion, as pages may nest deeply."""
    nodes = [root]
    for node in nodes:
        nodes.extend(c for c in node.children if isinstance(c, Node))
    return nodes


def hash_subtrees(root: Node) -> list[Node]:
    """Sets the hash of every node from its tag, its names, its text and its children's hashes."""
    nodes = _walk(root)
    for node in reversed(nodes):
        h = blake2b(digest_size=8)
        h.update(f"{node.tag} {' '.join(_NAMED.findall(node.attrs))}".encode("utf-8", "surrogatepass"))
        for child in node.children:
            if isinstance(child, Node):
                h.update(b"<%d>" % child.hash)
            elif child.strip():
                h.update(" ".join(child.split()).encode("utf-8", "surrogatepass"))
        node.hash = int.from_bytes(h.digest(), "big", signed=True)
    return nodes


def _articles(nodes: list[Node]) -> list[Node]:
    """The outermost article elements, or the main one; none if the page has neither."""
    for tag in ("article", "main"):
        found = [n for n in nodes if n.tag == tag or tag == "main" and _ROLE.findall(n.attrs)[:1] == ["main"]]
        if found:
            inner = {id(c) for n in found for c in _walk(n)[1:]}
            return [n for n in found if id(n) not in inner]
    return []


def _is_outside(node: Node, in_article: bool) -> bool:
    if node.tag in OUTSIDE or node.tag == "header" and not in_article:
        return True
    if not node.attrs or node.tag in ("html", "body", "article", "main"):
        return False
    if re.search(r"\bhidden\b(?!\s*=\s*[\"']?until)", node.attrs) and "hidden" in _SPLIT.split(re.sub(r"\"[^\"]*\"|'[^']*'", " ", node.attrs)):
        return True
    role = _ROLE.search(node.attrs)
    if role and role[1].lower() in OUTSIDE_ROLES:
        return True
    if not in_article:
        return not OUTSIDE_NAMES.isdisjoint(w for value in _NAMED.findall(node.attrs) for w in _SPLIT.split(value.lower()))
    for kind, value in _CLASS_OR_ID.findall(node.attrs):
        if kind.lower() == "id" and node.tag in SLUGGED:
            continue
        for name in value.strip("\"'").lower().split():
            words = {w for w in _SPLIT.split(name) if w and not w.isdigit()}
            if (words - {"header", "banner"}) & OUTSIDE_NAMES and words <= OUTSIDE_NAMES | STRUCTURE:
                return True
            if words & READERS and words & (COMMENTS | {"comment", "reply"}) and words <= OUTSIDE_NAMES | STRUCTURE | READERS:
                return True
    return False


def _maybe_comments(node: Node) -> bool:
    """Whether a class says comments of some kind (``latest-comments``); ids may be slugs of a section's heading."""
    for kind, value in _CLASS_OR_ID.findall(node.attrs):
        for name in value.strip("\"'").lower().split() if kind.lower() == "class" else ():
            words = [w for w in _SPLIT.split(name) if w and not w.isdigit() and w not in STRUCTURE]
            if words[-1:] and words[-1] in COMMENTS:
                return True
    return False


def _sizes(nodes: list[Node]) -> dict[int, int]:
    """Words that each node holds, by its id, from all nodes with parents before their children."""
    sizes: dict[int, int] = {}
    for node in reversed(nodes):
        sizes[id(node)] = sum(sizes[id(c)] if isinstance(c, Node) else len(c.split()) for c in node.children)
    return sizes


def main_text(html: str, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's blocks in page order, joined by an empty line."""
    root = parse(html)
    nodes = hash_subtrees(root)
    roots = _articles(nodes)
    blocks: list[str] = []
    line: list[str] = []
    sizes: dict[int, int] = {}

    def is_comments(node: Node) -> bool:
        """Comments by their class, unless that is most of the article."""
        if not roots or node.tag in ("article", "main") or not _maybe_comments(node):
            return False
        if not sizes:
            sizes.update(_sizes(nodes))
        return 2 * sizes[id(node)] <= sum(sizes[id(r)] for r in roots)

    def end_block():
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    todo: list = list(reversed(roots or [root]))
    while todo:
        node = todo.pop()
        if node is None:
            end_block()
        elif isinstance(node, str):
            line.append(unescape(node))  # here, as a reference never reaches into the next element
        else:
            if node.tag in ("br", "img", "wbr", "input"):
                line.append("" if node.tag == "wbr" else " ")
                continue
            if _is_outside(node, bool(roots)) or is_comments(node) or node.hash in template and not (roots and node.tag in PROSE):
                continue
            if node.tag in BLOCK or node.tag == "#root":
                todo.append(None)
                end_block()
            todo.extend(reversed(node.children))
    end_block()
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    """Host in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, k1, k2, page, subtrees): block elements of each page once; ``page`` is the hash of all its content."""
    for batch in batches:
        pages, subtrees = [], []
        for html in batch.column("html"):
            nodes = hash_subtrees(parse(html.as_py() or ""))
            subtrees.append(list({n.hash for n in nodes if n.tag in BLOCK and n.tag not in ("html", "head", "body")}))
            pages.append(nodes[0].hash)
        kept = [batch.column(c) for c in ("host", "_k1", "_k2")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(pages, pa.int64()), pa.array(subtrees, pa.list_(pa.int64()))], ["host", "_k1", "_k2", "page", "subtrees"]
        )


def _named(pages: DataFrame) -> DataFrame:
    """page_id, url and html with the host and two hashes of the html."""
    html = F.coalesce("html", F.lit(""))
    hashes = F.xxhash64(html).alias("_k1"), F.xxhash64(F.lit(1), html).alias("_k2")
    return pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), *hashes)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, k1, k2, template): for each different page, by the hashes of its html, those of its own subtrees that recur
    on at least ``min_pages`` different pages of its host. Pages without any have no row.

    Exact copies of a page are one page, so a page that is stored many times is not its own template.
    """
    kinds = "host string, _k1 long, _k2 long, page long, subtrees array<long>"
    found = stored(_named(pages).select("host", "_k1", "_k2", "html").mapInArrow(_hashes, kinds))
    once = found.select("host", "page", "subtrees").dropDuplicates(["host", "page"]).select("host", F.explode("subtrees").alias("subtree"))
    recurring = stored(once.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select("host", "subtree"))
    rows = found.select("host", "_k1", "_k2", F.explode("subtrees").alias("subtree"))
    return rows.join(recurring, ["host", "subtree"]).groupBy("host", "_k1", "_k2").agg(
        F.sort_array(F.collect_set("subtree")).alias("template")
    )


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null or empty html, or a page without an article or other text, gives an empty text. A null url belongs to the host
    without name. Repeated rows give repeated rows; extra columns play no part.
    """
    known = stored(templates(pages, min_pages))
    rows = _named(pages).join(known, ["host", "_k1", "_k2"], "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, texts, size = 0, [], 0
            for i in range(batch.num_rows):
                hashes = batch.column("template")[i].as_py()
                texts.append(main_text(batch.column("html")[i].as_py() or "", frozenset(hashes or ())))
                size += len(texts[-1])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    kept = [batch.column(c).slice(start, i + 1 - start) for c in ("page_id", "url")]
                    n = [len(t) for t in texts]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array(texts, pa.string()), pa.array(n, pa.int64())], ["page_id", "url", "text", "n_chars"]
                    )
                    start, texts, size = i + 1, [], 0

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
