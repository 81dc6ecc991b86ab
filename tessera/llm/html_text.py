"""Main text of HTML pages by composite text density.

A page becomes a tree; every node gets its characters per tag, lowered by the share of its
characters and tags that are links. The node whose children's densities have the largest sum
holds the article; the least density on the path from the body to it is the threshold at which
what stands beside that path belongs to the article too. Article and main elements play no part
in this; they only keep what holds them from being dropped for its marks.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.shared import mapped, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head script style noscript template iframe textarea title annotation annotation-xml desc metadata nav aside footer button select option menu dialog object audio video canvas".split())
#: Words of class, id or role (``site-footer`` has two) that mark what is not article, unless it holds the article
#: or, inside one, is as dense as the article.
BOILERPLATE = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related replies reply respond share sharing "
    "sidebar skip social sponsor sponsored subscribe widget toolbar complementary contentinfo search".split()
)
#: Those of reader comments, which are as dense as an article and never of it.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: With these a name tells of comments, but not that they are inside.
ABOUT = frozenset("open closed no has enabled disabled with without".split())
#: Words that are a part's subject as well: in an article such a part goes only if it is mostly links or, where
#: the word is the whole name, if it is far less dense than the article.
DOUBTFUL = frozenset("banner menu navigation notice notices popup promoted related search skip social toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
#: What a start tag closes, beyond a paragraph that any block closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("table ul ol dl div article section main body td th".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


class Node:
    __slots__ = ("blocks", "children", "chars", "density", "doubtful", "dropped", "link_chars", "link_tags", "marked", "parent", "summed", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, marked: bool = False, doubtful: int = 0):
        self.tag, self.parent, self.dropped, self.marked, self.doubtful = tag, parent, dropped or marked, marked and not dropped, 0 if dropped or marked else doubtful
        self.children: list[Node | str] = []


def boilerplate(tag: str, attrs: str) -> bool:
    """Whether an element is dropped whatever it holds."""
    if tag in DROPPED:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    return bool(_HIDDEN.search(attrs))


def marks(tag: str, attrs: str, in_article: bool) -> tuple[bool, int]:
    """(marked, doubtful): whether an element is dropped unless it holds the article; or whether, standing in
    an article, it is judged by its density, 1 for a part of a name and 2 for a whole one."""
    if tag == "form" or (tag == "header" and not in_article):
        return True, 0
    if not attrs or tag in ("html", "body", "main"):
        return False, 0
    doubtful = 0
    for name in (w for m in _NAMED.finditer(attrs) for w in (m[1] or m[2] or m[3] or "").split()):
        found = {w.lower() for w in _SPLIT.split(name)}
        if found & COMMENTS:
            if not found & ABOUT:
                return True, 0
        elif tag != "article" and (mark := found & BOILERPLATE):
            if not in_article or mark - DOUBTFUL:
                return True, 0
            doubtful = max(doubtful, 2 if len(found) == 1 else 1)
    return False, doubtful


def parse(page: str) -> Node:
    """The tree of ``page``. Unclosed and misnested tags close as browsers close them, nearly; text stays undecoded."""
    top = here = Node("html", None)
    at = 0
    articles = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            node = here
            while node.parent and node.tag != tag and not (node.tag in FENCE and tag not in BLOCK):
                node = node.parent
            if node.tag == tag and node.parent:
                closed = here
                while closed is not node.parent:
                    articles -= closed.tag in ("article", "main")
                    closed = closed.parent
                here = node.parent
            continue
        if tag in ("html", "body") and any(isinstance(c, Node) and c.tag == tag for c in top.children) or tag == "html":
            continue
        if tag in BLOCK:  # an open paragraph ends, with the inline tags inside it
            node = here
            while node.parent and node.tag not in FENCE and node.tag != "p":
                node = node.parent
            if node.tag == "p":
                here = node.parent
        if shut := CLOSES.get(tag):
            node = here
            while node.parent and node.tag not in shut and node.tag not in FENCE - shut:
                node = node.parent
            if node.tag in shut:
                here = node.parent
        if tag == "body":
            here = top
        node = Node(tag, here, boilerplate(tag, m[3]), *marks(tag, m[3], articles > 0))
        here.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK):
            here = node
            articles += tag in ("article", "main")
    if at < len(page):
        here.children.append(page[at:])
    return top


def _walk(top: Node) -> list[Node]:
    """Kept nodes, parents first; a loop, for pages can nest deeply."""
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and not c.dropped]
    return out


def _text_chars(nodes: list[Node]) -> dict[int, int]:
    """Characters outside links below each of ``nodes`` (parents first), by identity."""
    out: dict[int, int] = {}
    for node in reversed(nodes):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        out[id(node)] = 0 if node.tag == "a" else own + sum(out.get(id(c), 0) for c in node.children if isinstance(c, Node))
    return out


def restore(top: Node) -> Node:
    """Keeps marked nodes that contain an article or main element or most of the page's text, unless
    such an element elsewhere has text already."""
    every, todo = [], [top]
    while todo:
        node = todo.pop()
        every.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and (not c.dropped or c.marked)]
    if not any(n.marked for n in every):
        return top
    chars = _text_chars(every)
    for node in every:
        # a header below the body, with a headline and what it heads beside it, is a part's own and not the page's
        if node.tag == "header" and node.marked and node.parent is not top and node.parent.tag != "body" and chars[id(node.parent)] > 2 * chars[id(node)] > 0:
            todo, headed = [node], False
            while todo and not headed:
                todo += [c for c in todo.pop().children if isinstance(c, Node) and not c.dropped]
                headed = any(c.tag in HEADINGS for c in todo)
            if headed:
                node.dropped = node.marked = False
    holds: set[int] = set()
    for node in reversed(every):
        if (node.tag in ("article", "main") and not node.marked) or any(id(c) in holds for c in node.children if isinstance(c, Node)):
            holds.add(id(node))
    wanted = [n for n in every if n.marked and chars[id(n)] and (id(n) in holds or 2 * chars[id(n)] > chars[id(top)])]
    for node in wanted:
        above, up = set(), node
        while up.parent:
            up = up.parent
            above.add(id(up))
        kept = _walk(top)
        left = _text_chars(kept)
        # within an article, only one more article tells such a part from its comments
        if all(id(n) in above and (n.tag == "main" or id(node) in holds) for n in kept if n.tag in ("article", "main") and left[id(n)]):
            node.dropped = False
    return top


def measure(top: Node) -> list[Node]:
    """Sets each kept node's composite density and the sum of its children's.

    Children are blocks; the text and inline elements between them count as one child, so that
    a paragraph's emphasis is no block of its own.
    """
    nodes = _walk(top)
    for node in reversed(nodes):
        chars = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        kids = [c for c in node.children if isinstance(c, Node) and not c.dropped]
        node.chars = chars + sum(k.chars for k in kids)
        node.tags = len(kids) + sum(k.tags for k in kids)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(k.link_chars for k in kids)
        node.link_tags = node.tags if link else sum(k.link_tags + (k.tag == "a") for k in kids)
    body, whole = top, max(top.chars, 1)

    def density(c: int, t: int, lc: int, lt: int) -> float:
        t, rest = max(t, 1), max(c - lc, 1)
        base = math.log(c / rest * lc + body.link_chars / whole * c + math.e)
        ratio = max(c / max(lc, 1) * t / max(lt, 1), 1.0)
        return c / t * math.log(ratio, base) if c and base > 1 else (c / t * math.log(ratio + 1) if c else 0.0)

    for node in reversed(nodes):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags)
        kids = [c for c in node.children if isinstance(c, Node) and not c.dropped]
        inline = [k for k in kids if not k.blocks]
        node.blocks = node.tag in BLOCK or len(inline) < len(kids)
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(k.chars for k in inline)
        between = density(own, len(inline) + sum(k.tags for k in inline), sum(k.link_chars for k in inline), sum(k.link_tags + (k.tag == "a") for k in inline))
        node.summed = between + sum(k.density for k in kids if k.blocks)
    return nodes


def select(top: Node) -> list[Node | str]:
    """What makes up the article, in page order.

    The node with the largest sum is taken whole. The least density on the path from it to the
    body is the threshold: beside that path, at whatever depth, a block that reaches it and is
    not mostly links belongs to the article, and so does what stands between two such blocks or,
    as a heading, before one.
    """
    nodes = measure(top)
    best = max((n for n in nodes if n.blocks), key=lambda n: n.summed)
    path = [best]
    while path[-1].parent:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    for node in nodes:
        sparse = node.doubtful == 2 and 2 * node.density < threshold
        if node.doubtful and node not in path and (sparse or 2 * node.link_chars > node.chars):
            node.dropped = True
    out: list[Node | str] = [best]
    for child, parent in zip(path, path[1:], strict=False):
        # runs of inline content are one block
        parts: list[list[Node | str]] = []
        for c in parent.children:
            if isinstance(c, Node) and c.dropped:
                continue
            whole = isinstance(c, Node) and (c.blocks or c is child)
            if whole or not parts or parts[-1] == [] or (isinstance(parts[-1][-1], Node) and (parts[-1][-1].blocks or parts[-1][-1] is child)):
                parts.append([c])
            else:
                parts[-1].append(c)
        at = next(k for k, part in enumerate(parts) if part[0] is child)
        keep = [k == at or _belongs(part, threshold) for k, part in enumerate(parts)]
        first, last = keep.index(True), len(keep) - 1 - keep[::-1].index(True)
        while first and _heading(parts[first - 1]):
            first -= 1
        around: list[Node | str] = []
        for k in range(first, last + 1):
            around += out if k == at else [_Break, *parts[k], _Break] if keep[k] or _plain(parts[k]) else []
        out = around
    return out


#: Between parts, so that text beside a block does not run into it.
_Break = "\0"


def _size(part: list[Node | str]) -> tuple[int, int]:
    """Characters, and those in links."""
    chars = sum(len(c.strip()) if isinstance(c, str) else c.chars for c in part)
    return chars, sum(c.link_chars for c in part if isinstance(c, Node))


def _plain(part: list[Node | str]) -> bool:
    chars, linked = _size(part)
    return 2 * linked <= chars


def _belongs(part: list[Node | str], threshold: float) -> bool:
    chars, _ = _size(part)
    density = part[0].density if isinstance(part[0], Node) and part[0].blocks else chars / max(sum(isinstance(c, Node) for c in part), 1)
    return chars > 0 and density >= threshold and _plain(part)


def _heading(part: list[Node | str]) -> bool:
    chars, _ = _size(part)
    return not chars or isinstance(part[0], Node) and part[0].tag in HEADINGS and _plain(part)


def text_of(roots: list[Node | str]) -> str:
    """Blocks of text in page order, joined by an empty line."""
    blocks: list[str] = []
    held: list[str] = []

    def flush():
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                blocks.append(text)
            held.clear()

    todo: list[Node | str | None] = list(reversed(roots))
    while todo:
        item = todo.pop()
        if item is None or item is _Break:
            flush()
        elif isinstance(item, str):
            held.append(item)
        elif item.tag == "br":
            held.append("\n")
        elif not item.dropped:
            if item.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(item.children)
    flush()
    return "\n\n".join(blocks)


def main_text(page: str | None) -> str:
    return text_of(select(restore(parse(page)))) if page else ""


def _batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``. Null, empty and textless pages have an
    empty text. Null ids and repeated rows return like any other; other columns are ignored."""
    own = pages.selectExpr(f"cast(`{id_col}` as long) AS page_id", f"`{url_col}` AS url", f"`{html_col}` AS html")
    return mapped(own, _batches, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
