"""Trees and text blocks of HTML pages, and the matching of trees."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

MAX_DEPTH, MAX_NODES = 48, 512  # beyond them an element's text counts as its parent's; no text is lost

_TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/<>]*)((?:[^<>=]|=\s*(?:"[^"]*"|'[^']*')?)*+)>|[!?/][^>]*>)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_LABEL = re.compile(r"[^a-z#]+")

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe xmp noembed noframes textarea title svg canvas object audio video select datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr area map".split()
)
TRANSPARENT = frozenset(["html", "head", "body"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
MAIN = frozenset(["article", "main"])
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
    "menu nav ol p pre section table ul".split()
)
# An element that opens ends the open ones of these names, up to the list or table it belongs to.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS |= {x: ("tr", "td", "th", "thead", "tbody", "tfoot") for x in ("thead", "tbody", "tfoot")}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
# Names, roles and words of classes and ids that mark what isn't part of an article.
ASIDE = frozenset("nav footer aside form dialog menu button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored sponsors promo promotion".split())
PAGE_PARTS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar masthead topbar footer colophon copyright sidebar sidebars aside "
    "widget widgets related recommended recommendations trending cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login paywall alert share sharing social search searchbox header banner".split()
)
CONTENT_WORDS = frozenset("article post entry content story main text".split())
NEGATED = frozenset("has with no without".split())


@dataclass
class Node:
    label: str
    children: list[Node] = field(default_factory=list)
    support: int = 1
    place: int = -1  # preorder number in the tree it stands for


@dataclass
class Block:
    """A run of text: its element, its place there, the characters that are links, and whether an article holds it."""

    node: Node
    text: str
    links: int
    main: bool


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _refused(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    """True for an element whose text isn't part of an article, by its name, role, class, id or state."""
    if tag in ASIDE or (tag == "header" and not in_main):
        return True
    if not attributes or tag in TRANSPARENT:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    if tag not in MAIN and attributes.get("role", "").lower() in ROLES:
        return True
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in _WORD.findall(name)]
        if not words or words[0] in NEGATED:
            continue
        found = set(words)
        if found & COMMENTS or found & ADVERTS:
            return True
        if tag in MAIN or tag in HEADINGS:
            continue
        parts = found & PAGE_PARTS
        if parts and not (parts <= {"header", "banner"} and (in_main or found & CONTENT_WORDS)):
            return True
    return False


def _label(tag: str, attributes: dict[str, str]) -> str:
    """The name of an element with its classes, or else its id; digits don't tell elements apart."""
    name = attributes.get("class") or attributes.get("id") or ""
    words = _LABEL.sub(" ", re.sub(r"\d+", "#", name.lower())).split()
    return ".".join([re.sub(r"[^a-z0-9-]", "", tag), *words])[:80]


def parse(html: str, by_class: bool = True) -> tuple[Node, list[Block]]:
    """The tree of block elements under a root of its own, and the blocks of text outside refused elements.

    Inline elements don't end a block; a line break is white space. Elements that are left open end as in
    browsers: at the next paragraph, item or cell, or with an element around them. Without by_class only
    names of elements are judged, and an article in a refused element counts.
    """
    root = Node("root")
    # tag, node, refused, in main, is link
    stack: list[tuple[str, Node, bool, bool, bool]] = [("", root, False, False, False)]
    blocks: list[Block] = []
    buffer: list[str] = []
    links = 0
    count = 1

    def flush() -> None:
        nonlocal links
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                blocks.append(Block(stack[-1][1], text, links, stack[-1][3]))
            buffer.clear()
        links = 0

    def put(text: str) -> None:
        nonlocal links
        if not text or stack[-1][2]:
            return
        if "&" in text:
            text = unescape(text)
        buffer.append(text)
        if stack[-1][4]:
            links += len("".join(text.split()))

    def close(size: int) -> None:
        while len(stack) > size:
            if stack[-1][0] not in INLINE:
                flush()
            stack.pop()

    at = 0
    while True:
        m = _TAG.search(html, at)
        if m is None:
            put(html[at:])
            break
        put(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = len(html) if end is None else end.start()
            if tag not in INLINE and tag not in ("script", "style", "noscript", "template"):
                put(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ENDS[tag]:
                    close(k)
                    if tag != "tr" and not tag.startswith("t"):
                        break
                elif stack[k][0] in BOUNDS.get(tag, ("table",)) or stack[k][0] in MAIN:
                    break
        attributes = _attributes(m[3]) if m[3] and not m[3].isspace() else {}
        _, parent, refused, in_main, link = stack[-1]
        is_main = tag in MAIN
        bad = _refused(tag, attributes, in_main) if by_class else tag in ASIDE
        if tag in INLINE:
            stack.append((tag, parent, refused or bad, in_main, link or tag == "a"))
            continue
        flush()
        if tag in TRANSPARENT:
            continue
        node = parent
        if len(stack) < MAX_DEPTH and count < MAX_NODES:
            node = Node(_label(tag, attributes))
            parent.children.append(node)
            count += 1
        refused = (refused and not (is_main and not by_class)) or bad
        stack.append((tag, node, refused, in_main or is_main, False))
    close(1)
    flush()
    return root, blocks


# ---- skeletons ---------------------------------------------------------------


def skeleton(root: Node) -> str:
    """The tree as text, neighbours of equal shape folded into one; sets `place` of every node."""
    shape: dict[int, str] = {}
    order = [root]
    for node in order:
        order.extend(node.children)
    for node in reversed(order):
        parts: list[str] = []
        for child in node.children:
            if not parts or parts[-1] != shape[id(child)]:
                parts.append(shape[id(child)])
        shape[id(node)] = f"{node.label}({','.join(parts)})" if parts else node.label
    number = 0
    waiting = [[root]]
    while waiting:
        group = waiting.pop()
        for node in group:
            node.place = number
        number += 1
        below: list[list[Node]] = []
        for node in group:  # all have the same folded children
            k, last = -1, None
            for child in node.children:
                if shape[id(child)] != last:
                    k, last = k + 1, shape[id(child)]
                    if k == len(below):
                        below.append([])
                below[k].append(child)
        waiting.extend(reversed(below))
    return shape[id(root)]


_TOKEN = re.compile(r"([^(),]+)|([(),])")


def read(text: str, support: int = 1) -> Node:
    """A tree from its text; `label:n` gives a node its own support."""
    top = Node("")
    stack, last, number = [top], top, 0
    for m in _TOKEN.finditer(text):
        if m[1]:
            label, _, n = m[1].partition(":")
            last = Node(label, [], int(n) if n else support, number)
            number += 1
            stack[-1].children.append(last)
        elif m[2] == "(":
            stack.append(last)
        elif m[2] == ")":
            last = stack.pop()
    return top.children[0]


def write(node: Node) -> str:
    head = f"{node.label}:{node.support}"
    return f"{head}({','.join(map(write, node.children))})" if node.children else head


def nodes_of(root: Node) -> list[Node]:
    """All nodes in preorder."""
    out, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        out.append(node)
        waiting.extend(reversed(node.children))
    return out


# ---- matching -----------------------------------------------------------------


def matching(a: Node, b: Node, known: dict | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the most pairs of nodes with equal labels that keep parents and the order of
    siblings; (their number, the matched children of a and b). Roots of different labels match nowhere."""
    known = {} if known is None else known
    key = (id(a), id(b))
    if key in known:
        return known[key]
    if a.label != b.label:
        known[key] = (0, [])
        return known[key]
    left, right = a.children, b.children
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(right):
            value = above[j + 1] if above[j + 1] >= row[j] else row[j]
            if x.label == y.label:
                value = max(value, above[j] + matching(x, y, known)[0])
            row[j + 1] = value
    pairs = []
    i, j = len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((left[i], right[j]))
    known[key] = (1 + best[-1][-1], pairs[::-1])
    return known[key]


def merge(wrapper: Node, tree: Node) -> None:
    """Adds the nodes of tree to wrapper: matched ones by their support, others as new nodes in their order."""
    known: dict = {}
    waiting = [(wrapper, tree)] if matching(wrapper, tree, known)[0] else []
    while waiting:
        to, of = waiting.pop()
        to.support += of.support
        pairs = {id(y): x for x, y in matching(to, of, known)[1]}
        places = {id(x): k for k, x in enumerate(to.children)}
        fresh, after = [], 0
        for child in of.children:
            if id(child) in pairs:
                waiting.append((pairs[id(child)], child))
                after = places[id(pairs[id(child)])] + 1
            else:
                fresh.append((after, child))
        for place, child in reversed(fresh):
            to.children.insert(place, child)


def prune(root: Node, limit: int) -> None:
    """Leaves the `limit` nodes of most support; a node never has more than its parent."""
    nodes = nodes_of(root)
    if len(nodes) <= limit:
        return
    kept = {id(node) for _, _, node in sorted(((-n.support, i, n) for i, n in enumerate(nodes)), key=lambda x: x[:2])[:limit]}
    for node in nodes:
        node.children = [child for child in node.children if id(child) in kept]


def aligned(wrapper: Node, tree: Node) -> dict[int, int]:
    """{place in tree: place in wrapper} of all matched nodes."""
    known: dict = {}
    out: dict[int, int] = {}
    waiting = [(wrapper, tree)] if matching(wrapper, tree, known)[0] else []
    while waiting:
        to, of = waiting.pop()
        out[of.place] = to.place
        waiting.extend(matching(to, of, known)[1])
    return out
