"""Main text of HTML pages by composite text density.

A page is tokenised into a node tree in one pass (unclosed and misnested tags
are closed as browsers do for the cases that matter to text). Elements that hold
no article text by their kind (menus, headers, footers, asides, forms, scripts,
styles ...) are left out. Those whose class, id or role has a word of adverts,
notices, sidebars, comments ... are left out unless the text is mostly theirs:
where the article, main or kept element around them (else the page) has text in
further articles, they are kept when they hold some of it and more of it lies in
such elements than outside; where it has none, with more text than there is outside of such elements (so a long comment
section can outweigh a short text that no article or main marks). Words after
has-, no-, with-, without- or not- do not count, nor do ids of text elements and words that also name a topic (legal, search, tags ...)
inside an article. A form counts like such a word, as some pages lie in one form altogether. For every other node the characters per
tag, adjusted for link characters and link tags, give its density; a node's
density sum adds the densities of its children. The subtree with the largest
density sum is selected; the smallest density on its path up to the body is the
threshold above which further subtrees are taken in, and the text is that of the
smallest node that spans them.

Character references are decoded, white space inside a block becomes one blank,
blocks are joined in page order by one line feed. Table cells and list items are
blocks, a line break inside a block is white space. Elements nested deeper than
``MAX_DEPTH`` become siblings, as in browsers, so that no page takes more time
than a multiple of its length.

Defined cases: null or empty html gives the empty text; html without tags is one
block of the body; repeated rows are extracted alike; other columns are ignored;
texts of any length are processed whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertape.llm.common import map_text, slices

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
#: Kinds of element that never hold article text.
_DROP = frozenset(
    "head title script style noscript template nav footer aside button select option input textarea label iframe object embed"
    " svg math canvas audio video map menu dialog datalist xmp noembed noframes".split()
)
#: Words of class, id or role that mark boilerplate.
_DROP_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|sidebar|side-bar|nav(?:bar|igation)?|menu"
    r"|breadcrumbs?|footer|masthead|site-header|page-header|topbar|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter"
    r"|subscribe|signup|login|share|sharing|social|related|recommend(?:ed|ations?)|comments?|commentlist|respond|disqus|widget|pagination|pager"
    r"|toolbar|search|complementary|contentinfo|skip-link|tags|legal|disclaimer)(?=$|[\s_-])",
    re.I,
)
#: Of these, words that name a topic inside an article, and elements whose id is then an anchor in the text.
_TOPIC = frozenset("legal disclaimer search tags alert overlay login recommendation recommendations".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre span em strong b i u a code q cite sup sub figcaption".split())
#: Nesting beyond which elements become siblings.
MAX_DEPTH = 512
#: Class words that only say what else the page has or lacks.
_MODIFIER = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|not|with|without)[_-]\S*", re.I)
#: An attribute as the HTML tokeniser reads it: a quote opens a string only as the first character of a value.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>"'][^\s>]*+))?+)?+""")
_SCOPE = frozenset("table td th html body article section div ul ol".split())


class Node:
    __slots__ = ("tag", "up", "kids", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "best_at",
                 "worded", "plain", "free", "articles", "free_articles")

    def __init__(self, tag: str, up: "Node | None", dropped: bool, worded: bool = False) -> None:
        self.tag, self.up, self.dropped, self.worded = tag, up, dropped, worded
        self.kids: list[Node | str] = []


def _boilerplate(tag: str, attrs: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element is never article text, and whether a word of its class, id or role marks boilerplate."""
    if tag in _DROP or (tag == "header" and not inside_article):
        return True, False
    worded = tag == "form"
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = next((v for v in m.groups()[1:] if v is not None), "")
        if name in ("class", "id", "role") and tag not in ("body", "html") and not (name == "id" and inside_article and tag in _TEXT):
            found = (x[0].strip(" \t\r\n\f_-").lower() for x in _DROP_WORD.finditer(_MODIFIER.sub(" ", value)))
            worded = worded or any(not (inside_article and w in _TOPIC) for w in found)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, False
    return False, worded


def _drop_worded(root: Node) -> None:
    """Drop the elements marked by a word, unless the text around them is mostly theirs."""
    order, todo = [], [(root, False)]
    while todo:
        node, link = todo.pop()
        link = link or node.tag == "a"
        node.plain = 0 if link else sum(len(k) - k.count(" ") - k.count("\n") for k in node.kids if isinstance(k, str))
        order.append(node)
        todo += [(k, link) for k in node.kids if isinstance(k, Node) and not k.dropped]
    # plain: characters outside of links; free: those outside of marked elements below; articles: those in unmarked articles below,
    # free_articles: of these, those outside of marked elements
    for node in reversed(order):
        node.free, node.articles, node.free_articles = node.plain, 0, 0
        for k in node.kids:
            if isinstance(k, Node) and not k.dropped:
                marked, article = k.worded, k.tag in ("article", "main")
                node.plain += k.plain
                node.free += 0 if marked and not article else k.free
                node.articles += k.plain if article and not marked else k.articles
                node.free_articles += 0 if marked and not article else k.free_articles if marked or not article else k.plain
    around = [(root, root)]
    while around:
        node, frame = around.pop()
        for k in node.kids:
            if not isinstance(k, Node) or k.dropped:
                continue
            inner = frame
            if k.tag in ("article", "main"):
                inner = frame if k.worded else k
            elif k.worded:
                mostly = k.articles and frame.articles > 2 * frame.free_articles if frame.articles else k.plain > frame.free
                k.dropped = not mostly
                inner = k
            if not k.dropped:
                around.append((k, inner))


def parse(html: str) -> Node:
    """The node tree of a page; the root stands for the body's ancestors."""
    root = Node("#root", None, False)
    stack, at, end = [root], 0, len(html)
    articles, still = 0, Counter()  # open articles, open elements of each tag

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].kids.append(unescape(html[at:upto]))

    def pop_to(depth: int) -> None:
        nonlocal articles
        while len(stack) > depth:
            tag = stack.pop().tag
            still[tag] -= 1
            articles -= tag in ("article", "main")

    def close_within(tags: tuple[str, ...], stop: frozenset[str]) -> None:
        if not any(still[t] for t in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                pop_to(depth)
                return
            if stack[depth].tag in stop:
                return

    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            break
        text(m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].kids.append(" ")
                continue
            for depth in range(len(stack) - 1 if still[tag] else 0, 0, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    break
                if tag not in _BLOCK and stack[depth].tag in _BLOCK:
                    break  # an inline end tag does not close blocks
            continue
        if tag in _CLOSES_P:
            close_within(("p",), _SCOPE)
        if tag == "li":
            close_within(("li",), frozenset(("ul", "ol", "menu")))
        elif tag in ("dt", "dd"):
            close_within(("dt", "dd"), frozenset(("dl",)))
        elif tag in ("td", "th"):
            close_within(("td", "th"), frozenset(("table", "tr")))
        elif tag == "tr":
            close_within(("tr",), frozenset(("table",)))
        elif tag == "option":
            close_within(("option",), frozenset(("select",)))
        elif tag == "body":
            close_within(("head",), frozenset())
        elif tag == "a":
            close_within(("a",), _BLOCK)
        if len(stack) > MAX_DEPTH:
            pop_to(MAX_DEPTH)
        never, worded = _boilerplate(tag, m[3], articles > 0)
        node = Node(tag, stack[-1], stack[-1].dropped or never, worded)
        if tag in _VOID:
            if tag == "br":
                stack[-1].kids.append(" ")
            elif tag == "hr":
                stack[-1].kids.append(node)
            continue
        stack[-1].kids.append(node)
        if m[3].endswith("/") and tag in ("svg", "path", "use", "circle", "rect"):
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            stop = close.start() if close else end
            if not node.dropped:
                node.kids.append(html[at:stop])
            at = close.end() if close else end
            continue
        stack.append(node)
        still[tag] += 1
        articles += tag in ("article", "main")
    text(end)
    _drop_worded(root)
    return root


def _measure(root: Node) -> None:
    """Characters, tags and densities of every kept node, children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if isinstance(k, Node) and not k.dropped]
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for k in node.kids:
            if isinstance(k, str):
                node.chars += len(k) - k.count(" ") - k.count("\n")
            elif not k.dropped:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = root
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if not c:
            node.density = 0.0
        else:
            plain = max(1, c - node.link_chars)
            base = math.log(c / plain * node.link_chars + ratio * c + math.e)
            node.density = c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(base) if base > 1.0001 else c / t
            node.density = max(node.density, 0.0)
        kids = [k for k in node.kids if isinstance(k, Node) and not k.dropped]
        node.total = sum(k.density for k in kids)
        if not kids:
            node.total = node.density
        # the best subtree at or below; of equals the one nearest the root
        node.best, node.best_at = node.total, node
        for k in kids:
            if k.best > node.best:
                node.best, node.best_at = k.best, k.best_at


def _path(node: Node) -> list[Node]:
    out = [node]
    while out[-1].up is not None:
        out.append(out[-1].up)
    return out


def select(root: Node) -> Node:
    """The smallest node that spans every subtree above the body-path threshold."""
    _measure(root)
    best = root.best_at
    threshold = min(n.density for n in _path(best))
    marked, todo = [best], [root]
    while todo:
        node = todo.pop()
        if node.density < threshold or not node.chars:
            continue
        marked.append(node.best_at)
        todo += [k for k in node.kids if isinstance(k, Node) and not k.dropped]
    # what spans the first and the last of them in page order spans all
    place, todo = {}, [root]
    while todo:
        node = todo.pop()
        place[id(node)] = len(place)
        todo += reversed([k for k in node.kids if isinstance(k, Node) and not k.dropped])
    marked.sort(key=lambda n: place[id(n)])
    common = root
    for one, other in zip(_path(marked[0])[::-1], _path(marked[-1])[::-1]):
        if one is not other:
            break
        common = one
    return common


def blocks(node: Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        line = " ".join("".join(run).split())
        run.clear()
        if line:
            out.append(line)

    todo: list[Node | str | None] = [node]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif not item.dropped:
            if item.tag in _BLOCK or item.tag == "#root":
                flush()
                todo.append(None)
            todo += reversed(item.kids)
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    return "\n".join(blocks(select(root)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_text(rows, run, f"page_id {kind}, url string, text string, n_chars bigint")
