"""Main text of web pages by composite text density.

A page is read into a tree of its block elements.  Parts that are never article text
(menus, headers, footers, sidebars, forms, notices, adverts, comments, scripts, hidden
parts) are left out by tag, role and class.  Every remaining node gets its composite
text density, characters per tag adjusted for link characters and link tags, and the sum
of its children's densities.  The node of the greatest sum is the article's core and is
taken whole.  The least density on the path from the core to the body is the threshold for
what stands beside that path: containers (div, section) stay if they reach it; text,
headings, paragraphs and other blocks of text stay, in page order.  Lists that are nearly
all links count as menus if they stand beside the path or before any text of the core, but
not within an ``article`` or ``main`` element of the path.

Edge cases: null or empty html, or a page without text, gives an empty text; unclosed
and stray tags are tolerated; nesting depth and length are unbounded (no recursion); of
nodes with the same greatest sum the first is the core; repeated rows are each extracted;
an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
DROPPED = frozenset("head nav header footer aside form button select option datalist dialog menu svg canvas object video audio map math".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address center details summary fieldset legend hgroup hr search".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"} | DROPPED - {"button", "select", "option", "svg", "canvas", "object", "video", "audio", "map", "math", "datalist"}
#: Opening one of these ends an open one of the listed kind, within the listed bounds.
SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Words in class or id that mark what is not article text.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login paywall sidebar sidenav aside widget related recommended recommendations share sharing social comment comments commentlist disqus respond reply replies discussion nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar skip hidden".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
NEVER_BY_CLASS = frozenset("html body main article".split())

#: Blocks that hold others; beside the core only these are judged by their density.
CONTAINERS = frozenset("html body div section center fieldset search".split())

_ATTRS = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "items", "chars", "tags", "link_chars", "links", "density", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.total = 0.0


def _unwanted(tag: str, attrs: str) -> bool:
    if tag in DROPPED:
        return True
    if not attrs or attrs == ">":
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs[:-1])}
    if tag in NEVER_BY_CLASS:
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    named = f"{found.get('class', '')} {found.get('id', '')}"
    return any(w.lower() in BOILERPLATE for w in _TOKEN.findall(named)) or any(w.lower() in BOILERPLATE for w in re.split(r"[^A-Za-z]+", named))


def parse(page: str) -> Node:
    """Tree of the wanted block elements, with their text runs in page order."""
    root = Node("#page", None)
    node = root
    run: list[str] = []  # text of the open block since the last block boundary
    link_run = 0
    # Open elements: (tag, node to return to or None for an inline one, dropped, link)
    stack: list[tuple[str, Node | None, bool, bool]] = []
    dropped = in_link = 0
    end, at = len(page), 0

    def flush() -> None:
        nonlocal link_run
        if run:
            text = " ".join("".join(run).split())
            if text:
                node.items.append(text)
                node.chars += len(text)
                node.link_chars += min(link_run, len(text))
            run.clear()
        link_run = 0

    def say(text: str) -> None:
        nonlocal link_run
        if dropped or not text:
            return
        text = html_lib.unescape(text) if "&" in text else text
        run.append(text)
        if in_link:
            link_run += len(" ".join(text.split()))

    def pop() -> None:
        nonlocal node, dropped, in_link
        _, back, was_dropped, link = stack.pop()
        if back is not None:
            flush()
            node = back
        dropped -= was_dropped
        in_link -= link

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        nxt = page[lt + 1 : lt + 2]
        if not (nxt.isalpha() and nxt.isascii()) and nxt not in ("/", "!", "?"):
            say(page[at : lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        closing = nxt == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if name is None:  # a declaration or a stray end tag
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        attrs = _ATTRS.match(page, name.end())
        if attrs is None:
            stop = page.find(">", name.end())
            at = end if stop < 0 else stop + 1
            rest = page[name.end() : at]
        else:
            at, rest = attrs.end(), attrs[0]
        tag = name[0].lower()
        if closing:
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in ("td", "th", "table") and tag not in BLOCK:
                    break
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
            at = end if close is None else close.end()
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][1] is not None:
                    break
        if tag in SAME_LEVEL:
            same, bounds = SAME_LEVEL[tag]
            cut = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in bounds:
                    break
                if stack[i][0] in same:
                    cut = i
            while cut is not None and len(stack) > cut:
                pop()
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag in BLOCK:
                flush()
            continue
        bad, link = _unwanted(tag, rest), tag == "a"
        if tag in BLOCK or bad and tag in DROPPED:
            flush()
            child = Node(tag, node)
            if not (dropped or bad):
                node.items.append(child)
            stack.append((tag, node, bad, False))
            node = child
        else:
            stack.append((tag, None, bad, link))
            if link and not dropped:
                node.links += 1
        dropped += bad
        in_link += link and tag not in BLOCK
        if rest.endswith("/>") and tag not in BLOCK and tag != "a":
            pop()
    while stack:
        pop()
    flush()
    return root


def _order(root: Node) -> list[Node]:
    """Nodes of a subtree in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.items) if isinstance(c, Node)]
    return out


def weigh(root: Node) -> list[Node]:
    """Set every node's counts, composite density and density sum."""
    nodes = _order(root)
    for n in reversed(nodes):
        for c in n.items:
            if isinstance(c, Node):
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.links += c.links
    all_chars, all_links = max(root.chars, 1), root.link_chars
    for n in nodes:
        tags = max(n.tags, 1)
        plain = n.chars / tags
        if n.chars and all_links:
            base = math.log(n.chars / max(n.chars - n.link_chars, 1) * n.link_chars + all_links / all_chars * n.chars + math.e)
            gain = math.log(max(n.chars / max(n.link_chars, 1) * tags / max(n.links, 1), 1.0)) / math.log(max(base, 1.000001))
            plain *= gain
        n.density = plain
    for n in nodes:
        inner = [c.density for c in n.items if isinstance(c, Node)]
        n.total = sum(inner) if inner else n.density
        if inner and any(isinstance(c, str) for c in n.items):
            n.total += n.density
    return nodes


def _link_list(n: Node) -> bool:
    return n.tag in ("ul", "ol", "div", "section", "table", "dl") and n.links >= 3 and n.link_chars > 0.9 * n.chars


def _blocks(n: Node, menu_first: bool = False) -> list[str]:
    out: list[str] = []
    todo: list[Node | str] = [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not (menu_first and not out and x is not n and _link_list(x)):
            todo += reversed(x.items)
    return out


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by line feeds."""
    root = parse(page or "")
    nodes = weigh(root)
    if not root.chars:
        return ""
    body = next((n for n in nodes if n.tag == "body"), root)
    if not body.chars:
        body = root
    inside = _order(body)
    core = max(inside, key=lambda n: n.total)
    path = []
    n: Node | None = core
    while n is not None and n is not body.parent:
        path.append(n)
        n = n.parent
    least = min(n.density for n in path)
    # From the body down: the path's own text, the core, and what belongs to it beside them.
    out: list[str] = []
    chain = set(map(id, path))
    todo: list[tuple[Node | str, bool]] = [(body, False)]  # with whether an article encloses it
    while todo:
        x, within = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        inner = within or id(x) in chain and x.tag in ("article", "main")
        if x is core and x is not body:
            out += _blocks(x, menu_first=not inner)
        elif id(x) in chain:
            todo += [(c, inner) for c in reversed(x.items)]
        elif (within or not _link_list(x)) and (core is body or x.tag not in CONTAINERS or x.chars and x.density >= least):
            out += _blocks(x)
    return "\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
