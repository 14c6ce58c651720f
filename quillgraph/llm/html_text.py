"""Main text of web pages by composite text density.

A page is read into a tree of elements by a linear tag scanner (no external
parser).  Elements that can't be article text by their name or role (menus,
footers, sidebars, forms, scripts, adverts, notices, comments) are cut first.
For every other node::

    density = chars / tags * log(chars / link_chars * tags / link_tags) to the base
              log(chars / plain_chars * link_chars + link_share * chars + e)

which lowers nodes whose characters are mostly links.  A node's density sum is
the sum over its children; the node with the greatest sum is the root of the
article, and the least density on its path up to the body is the threshold that
its parts, and nodes beside it, have to reach.  Below the root, only parts made
mostly of links fall out, and none inside an article or main element, so loose text,
short paragraphs, headings and lists of sources stay.  A role doesn't cut what
holds nearly all of the page's plain text.

Character references are decoded; white space within a block becomes one space,
blocks are trimmed and joined in page order by one space.

Defined results
* null and empty html, and pages without text: an empty text.
* plain text without markup: itself.  Unclosed elements close at the next block or
  at the end; a tag that is never closed swallows the rest.  Repeated rows: a row
  each.  Very long pages: whole, in time linear in their length, also where tags,
  quotes and comments stay open.
* deep nesting is read with an explicit stack; nothing recurses.
* empty table: no rows.  Other columns take no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

_START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
_QUOTED = re.compile(r"=\s*([\"'])")
_ROLE = re.compile(r"(?i)(?:\b(?:class|id|role)\s*=\s*)(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HIDDEN = re.compile(r"(?i)(?:^|\s)(?:hidden(?=[\s=/]|\Z)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*|'[^']*|\S*)(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden))")
_VALUES = re.compile(r"(?i)(?<=[\s\"'])(?!style\b|aria-hidden\b)([\w:-]+)\s*=\s*(?:\"[^\"]*\"|'[^']*')")

# fixed values: element names
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = RAW | frozenset("head nav footer aside form button select option input dialog menu canvas audio video map noscript template svg math object".split())
WRAPPERS = frozenset("form aside dialog menu".split())  # of these, some wrap a page
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
P_CLOSERS = BLOCK - {"br"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section main div body html td th blockquote".split())
# fixed values: words in class, id or role that mark what isn't the article
NOISE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner sidebar side-bar menu nav navbar navigation navigator breadcrumb breadcrumbs"
    " footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social"
    " comment comments commentlist disqus respond replies reply related recommended toolbar widget pagination pager skip-link complementary contentinfo search paywall disclaimer".split()
)
TALK = frozenset("comment comments commentlist disqus respond replies reply".split())
STATES = frozenset("has no with without not is hide show".split())
# fixed values: words that only say where or how such a part stands
LAYOUT = frozenset(
    "site page main top bottom left right header box bar block list container wrapper wrap area section slot unit item items link links post posts content inner outer group primary secondary global local"
    " mobile desktop sticky fixed form button buttons icon icons panel column row col trail region wide small large module modules zone frame card cards head body xs sm md lg xl".split()
)
_PART = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("name", "parent", "items", "cut", "chars", "tags", "link_chars", "link_tags", "density", "total", "talk", "inside")

    def __init__(self, name: str, parent: Node | None, cut: bool):
        self.name, self.parent, self.cut, self.talk = name, parent, cut, False
        self.inside = name in ("article", "main") or parent is not None and parent.inside
        self.items: list[str | Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def noisy(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element can't be article text by its name or role, and whether
    its role is reader comments."""
    if name in NEVER:
        return True, False
    if not attributes or name in ("body", "html", "article", "main"):
        return False, False
    for m in _ROLE.finditer(attributes):
        for token in (m.group(1) or m.group(2) or m.group(3) or "").lower().replace("_", "-").split():
            if token.split("-")[0] in STATES:  # has-sidebar says what is near
                continue
            words = {token} if token in NOISE_WORDS else {m.group() for part in re.split(r"[^a-z0-9]+", token) if (m := _PART.match(part))}
            # the whole token must say so: a history of notice boards is no notice
            if not words.isdisjoint(NOISE_WORDS) and words <= NOISE_WORDS | LAYOUT:
                return True, not words.isdisjoint(TALK)
    return bool(_HIDDEN.search(_VALUES.sub(r"\1=", attributes))), False


class Scanner:
    """Finds tags; every character is looked at a bounded number of times."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.unclosed = {'"': len(html), "'": len(html)}  # from there on no such quote follows

    def end_of(self, at: int) -> int:
        """Place of the ">" that ends the tag whose name ends at ``at``; one follows.

        A quoted value may hold others; a quote that never closes isn't one.
        """
        html, first = self.html, self.html.find(">", at)
        end = first
        while True:
            m = _QUOTED.search(html, at, end)
            if m is None:
                return end
            quote = m.group(1)
            if m.start() >= self.unclosed[quote]:
                return first
            close = html.find(quote, m.end())
            if close < 0:
                self.unclosed[quote] = m.start()
                return first
            at = close + 1
            if at > end:
                if at > self.last:
                    return first
                end = html.find(">", at)


class Open:
    """The open elements: the innermost, and how many there are of each name."""

    def __init__(self, root: Node):
        self.top, self.names = root, Counter()

    def push(self, node: Node) -> None:
        self.top = node
        self.names[node.name] += 1

    def leave(self, node: Node) -> None:
        """Close ``node`` and all inside it."""
        while self.top is not node.parent:
            self.names[self.top.name] -= 1
            self.top = self.top.parent


def parse(html: str) -> tuple[Node, list[Node]]:
    """(root, all nodes in document order)."""
    root = Node("html", None, False)
    open_, nodes, at, size = Open(root), [root], 0, len(html)
    scanner, low, text = Scanner(html), None, 0  # text: where the text begins that isn't kept yet
    while True:
        at = html.find("<", at)
        m = _START.match(html, at) if at >= 0 else None
        if m is None and at >= 0:
            at += 1  # a "<" of the text
            continue
        if at < 0 or at > text:
            open_.top.items.append(html[text : at if at >= 0 else size])
        if at < 0 or at > scanner.last:
            break
        name = m.group(2)
        if not name:
            if m.group() == "<!--":
                stop = html.find("-->", at + 4)
                if stop < 0:
                    break
                at = text = stop + 3
            else:
                at = text = html.find(">", at) + 1
            continue
        end = scanner.end_of(m.end())
        attributes, name = html[m.end() : end], name.lower()
        at = text = end + 1
        if m.group(1):
            _close(open_, name)
            continue
        _imply(open_, name)
        top = open_.top
        if name in ("html", "body") and (top is root or name == "html"):
            if name == "body":
                node = Node("body", top, False)
                top.items.append(node)
                nodes.append(node)
                open_.push(node)
            continue
        node = Node(name, top, False)
        node.cut, node.talk = noisy(name, attributes)
        node.cut = node.cut or name == "header" and _page_header(top)
        top.items.append(node)
        nodes.append(node)
        if name in RAW:
            if low is None:
                low = html.lower()
                if len(low) != size:  # a letter that changes length
                    low = "".join(c if len(c.lower()) != 1 else c.lower() for c in html)
            stop = low.find(f"</{name}", at)
            if stop < 0 and name == "title":
                stop = html.find("<", at) - 1  # a title is one line of text
                at = text = stop + 1 if stop >= 0 else size
            elif stop < 0:
                break
            else:
                at = text = html.find(">", stop) + 1
            if not text:
                break
        elif name not in VOID and not attributes.endswith("/"):
            open_.push(node)
    return root, nodes


def _page_header(top: Node) -> bool:
    """A header outside the article is the page's, not the article's."""
    while top is not None:
        if top.name in ("article", "main"):
            return False
        top = top.parent
    return True


def _close(open_: Open, name: str) -> None:
    if not open_.names[name]:
        return
    node = open_.top
    while node.parent is not None:
        if node.name == name:
            open_.leave(node)
            return
        if name not in BLOCK and node.name in SCOPES:
            return  # a stray inline end tag doesn't leave its block
        node = node.parent


def _imply(open_: Open, name: str) -> None:
    """End tags that the start of ``name`` implies."""
    if name in P_CLOSERS and open_.names["p"]:
        node = open_.top
        while node.parent is not None and node.name not in SCOPES:
            if node.name == "p":
                open_.leave(node)
                break
            node = node.parent
    if name in CLOSES and any(open_.names[x] for x in CLOSES[name]):
        node = open_.top
        while node.parent is not None and (node.name not in SCOPES or node.name in CLOSES[name]):
            inside = node.parent
            if node.name in CLOSES[name]:
                open_.leave(node)
                if name != "tr" or node.name == "tr":
                    break
            node = inside


def _weigh(nodes: list[Node]) -> None:
    """Counts and densities, children before parents."""
    for node in reversed(nodes):
        if node.cut:
            continue
        for x in node.items:
            if isinstance(x, str):
                node.chars += len(x) if not x.isspace() else 0
            elif not x.cut:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.name == "a")
        if node.name in ("a", "button"):
            node.link_chars = node.chars
    body = next((n for n in nodes if n.name == "body"), nodes[0])
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        if not node.cut and node.chars:
            plain, links = max(1, node.chars - node.link_chars), max(1, node.link_chars)
            base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
            inner = node.chars / links * max(1, node.tags) / max(1, node.link_tags)
            node.density = node.chars / max(1, node.tags) * math.log(max(inner, 1.0)) / base
    for node in nodes:
        if node.parent is not None and not node.cut:
            node.parent.total += node.density


def _spare(nodes: list[Node]) -> None:
    """What holds nearly all of the page's plain text isn't cut for its role.

    Reader comments are, wherever something else is marked as the article.
    """
    plain: dict[Node, int] = {}
    wraps, marked = set(), {}
    for node in reversed(nodes):
        if node.name in ("p", "article", "main") or node in wraps:
            wraps.add(node.parent)
        never = node.name in NEVER and node.name not in WRAPPERS or node.name == "a"
        plain[node] = 0 if never else sum(len(x) * (not x.isspace()) if isinstance(x, str) else plain[x] for x in node.items)
        marked[node] = (node.name in ("article", "main", "h1")) + sum(marked[x] for x in node.items if not isinstance(x, str))
    for node in nodes:
        if node.cut and node in wraps and (node.name not in NEVER or node.name in WRAPPERS) and 5 * plain[node] > 4 * plain[nodes[0]]:
            node.cut = node.talk and marked[node] < marked[nodes[0]]


def _cut_below(nodes: list[Node]) -> None:
    for node in nodes:
        if node.parent is not None and node.parent.cut:
            node.cut = True


def _article(nodes: list[Node]) -> tuple[Node, float]:
    """Root of the article and the threshold on its path to the body."""
    live = [n for n in nodes if not n.cut and n.name not in ("html",)] or nodes[:1]
    best = max(live, key=lambda n: n.total)
    if not best.total:
        best = nodes[0]
    threshold, node = best.density, best
    while node.parent is not None and node.name != "body":
        threshold = min(threshold, node.density) if node.density else threshold
        node = node.parent
    # blocks of one article often hang side by side: climb while the parent is an
    # article or main element, or holds nothing of lower density
    node = best
    while node.parent is not None and node.parent.name not in ("body", "html"):
        siblings = [x for x in node.parent.items if isinstance(x, Node) and not x.cut and x.chars]
        if node.parent.name in ("article", "main") or node.name in INLINE or all(x.density >= threshold for x in siblings):
            node = node.parent
        else:
            break
    return node, threshold


INLINE = frozenset("b i em strong span font u s a small big sub sup code mark q cite abbr p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre".split())


def extract(html: str | None) -> str:
    """The article's text of one whole page."""
    if not html:
        return ""
    root, nodes = parse(html)
    _spare(nodes)
    _cut_below(nodes)
    _weigh(nodes)
    if not nodes[0].chars:
        return ""
    chosen, threshold = _article(nodes)
    body = next((n for n in nodes if n.name == "body"), root)
    out: list[str] = []
    if chosen.name in INLINE or chosen is root:
        chosen = body if body.chars else root
    tops: list[str | Node] = [chosen]
    if chosen is not body and chosen is not root and chosen.parent is not None:
        # loose text, text blocks and what is as dense as the path, in the same parent
        named = chosen.name in ("article", "main")
        tops = [x for x in chosen.parent.items if x is chosen or (_beside(x, threshold, named) if isinstance(x, Node) else not named)]
    for t in tops:
        _write(t, out)
    return " ".join("".join(out).split())


TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())


def _beside(x: Node, threshold: float, named: bool) -> bool:
    return not x.cut and 2 * x.link_chars < x.chars and (x.density >= threshold or not named and x.name in TEXTUAL)


def _write(top: str | Node, out: list[str]) -> None:
    stack: list = [top]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(unescape(x) if "&" in x else x)
            continue
        menu = x.name in BLOCK and not x.inside and x.link_tags > 2 and x.link_chars > 0.8 * x.chars
        if x.cut or menu:
            continue
        if x.name in BLOCK:
            out.append(" ")
            stack.append(" ")
        stack += x.items[::-1]


DIGEST = "page_id long, url string, text string, n_chars long"


def extract_pages(pages: DataFrame) -> DataFrame:
    """Digest form: page_id, url, text, n_chars."""

    def run(batches):
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, DIGEST)
