"""A small, lenient HTML reader: elements that matter for page structure, and their text.

Inline markup is passed over; block elements become nodes; script, style and the like vanish.
End tags that HTML lets an author leave out are implied.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

# fixed values of the HTML standard
_RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg math select object canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var html head picture".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
#: An open element of the first kind ends where one of the second starts, unless an element of the third is between.
_IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
}
_TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)|(/))")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_QUOTE = re.compile(r"""=\s*(["'])""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: What class, id and role name of a branch says of it.
HARD_NOISE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion comment comments reply replies respond disqus related recommended recommendation recommendations".split())
SOFT_NOISE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer masthead contentinfo complementary "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal dialog overlay newsletter subscribe subscription "
    "paywall disclaimer signup login share sharing social pagination pager toolbar search searchbox form banner".split()
)
_NOISE_TAGS = frozenset("nav footer aside form button dialog menu noscript fieldset search".split())
_MAIN_WORDS = frozenset(["content", "article", "post", "entry", "story", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = HEADINGS | frozenset("p li pre blockquote dd dt td th tr tbody figcaption".split())
#: Elements nested deeper are no nodes of their own; their text stays, block by block.
MAX_DEPTH = 64


class Node:
    """An element: its label (tag and names), role, and kids (nodes, texts, or None for a break)."""

    __slots__ = ("tag", "label", "role", "tier", "kids", "links")

    def __init__(self, tag: str, label: str, role: str, tier: int) -> None:
        self.tag, self.label, self.role, self.tier = tag, label, role, tier
        self.kids: list = []
        self.links = [0, 0]  # links and their characters, of this node's own text


@lru_cache(maxsize=4096)
def described(tag: str, attributes: str) -> tuple[str, str, int]:
    """(label, role, tier) of a start tag.

    Roles: hard, soft, header or none.  Tier 3 marks an article, 2 a main part, 1 a name that
    says so, 0 none of these.
    """
    found = {}
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), unescape(next(filter(None, values), "")))
    names = " ".join(found.get(k, "") for k in ("class", "id"))
    words = {w.lower() for w in _WORD.findall(names)}
    aria = found.get("role", "").lower()
    label = tag
    if found.get("class"):
        label += "." + ".".join(sorted(set(found["class"].split())))[:40].replace("/", "_")
    hidden = "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    if hidden or words & HARD_NOISE:
        role = "hard"
    elif tag in _NOISE_TAGS or words & SOFT_NOISE or {aria} & SOFT_NOISE:
        role = "soft"
    elif tag == "header" or "header" in words:
        role = "header"
    else:
        role = ""
    if tag == "article" or aria == "article" or found.get("itemprop") == "articleBody":
        tier = 3
    elif tag == "main" or aria == "main":
        tier = 2
    else:
        tier = 1 if words & _MAIN_WORDS and tag in ("div", "section", "td") else 0
    if role == "soft" and tier >= 2 and tag in ("article", "main"):
        role = ""
    return label, role, tier


def parse(html: str) -> Node:
    """The tree of a page, below one root of the label ``body``."""
    root = Node("body", "body", "", 0)
    stack, over, in_link, at = [root], {}, 0, 0
    last = {q: html.rfind(q) for q in "\"'>"}
    search = _TAG.search

    def add(text: str) -> None:
        if "&" in text:
            text = unescape(text)
        top = stack[-1]
        top.kids.append(text)
        if in_link:
            top.links[1] += len(text.strip())

    def pop_inline() -> None:
        while stack[-1].tag in _INLINE:
            stack.pop()

    while True:
        m = search(html, at)
        if m is None:
            if at < len(html):
                add(html[at:])
            break
        start = m.start()
        if start > at:
            add(html[at:start])
        comment, bogus, closing, tag, slash = m.groups()
        if comment:
            end = html.find("-->", m.end() - 2)
            at = len(html) if end < 0 else end + 3
            continue
        if last[">"] < m.end():
            if tag or bogus:
                break  # an unfinished tag ends the page
            add(html[start : m.end()])
            at = m.end()
            continue
        end = html.index(">", m.end())
        if bogus or slash:
            at = end + 1
            continue
        # a ">" inside a quoted value does not end the tag
        seen = m.end()
        while (value := _QUOTE.search(html, seen, end)) and last[value[1]] >= value.end():
            close = html.index(value[1], value.end())
            seen = close + 1
            if close > end:
                if last[">"] < close:
                    break
                end = html.index(">", close)
        attributes = html[m.end() : end]
        at, tag = end + 1, tag.lower()
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if over.get(tag):
                over[tag] -= 1
                stack[-1].kids.append(None)
            elif tag not in _VOID:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in ("td", "th", "caption") and tag not in _TABLE:
                        break
            elif tag == "br":
                stack[-1].kids.append(" ")
            continue
        if tag in _RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                end = -1 if close is None else html.find(">", close.end())
                at = len(html) if end < 0 else end + 1
            continue
        if tag in _VOID:
            stack[-1].kids.append(None if tag == "hr" else " " if tag == "br" else "")
            continue
        if tag == "a":
            in_link += 1
            stack[-1].links[0] += 1
        if tag in _INLINE:
            if attributes and tag not in ("html", "head"):
                label, role, _ = described(tag, attributes)
                if role in ("hard", "soft") and len(stack) < MAX_DEPTH:
                    node = Node(tag, label, role, 0)
                    stack[-1].kids.append(node)
                    stack.append(node)
            continue
        in_link = 0
        pop_inline()
        if tag in _CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        if tag in _IMPLIED:
            ends, between = _IMPLIED[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in between:
                    break
                if stack[i].tag in ends:
                    del stack[i:]
                    if tag != "tr":
                        break
        if tag == "body":
            _, role, tier = described(tag, attributes)
            root.tier = max(root.tier, tier)
            continue
        if len(stack) >= MAX_DEPTH:
            over[tag] = over.get(tag, 0) + 1
            stack[-1].kids.append(None)
            continue
        node = Node(tag, *described(tag, attributes))
        stack[-1].kids.append(node)
        stack.append(node)
    return root


def text_length(node: Node) -> int:
    return sum(len(k.strip()) if isinstance(k, str) else text_length(k) for k in node.kids if k is not None)


def link_share(node: Node) -> tuple[int, int]:
    """Links below a node, and the characters in them."""
    n, chars = node.links
    for k in node.kids:
        if isinstance(k, Node):
            a, b = link_share(k)
            n, chars = n + a, chars + b
    return n, chars


def article_parts(root: Node) -> tuple[list[tuple[Node, str]], bool]:
    """The branches that a page declares its main text, with their paths; else the whole page.

    The strongest kind of declaration that is outside noise counts, or else one inside soft noise.
    """
    found: list[tuple[int, int, Node, str]] = []

    def look(node: Node, path: str, soft: bool, inside: int) -> None:
        for k in node.kids:
            if isinstance(k, Node) and k.role != "hard":
                here = f"{path}/{k.label}"
                if k.tier > inside:
                    found.append((int(soft or k.role == "soft"), -k.tier, k, here))
                look(k, here, soft or k.role == "soft", max(inside, k.tier))

    look(root, root.label, False, 0)
    found = [f for f in found if text_length(f[2])]
    if not found:
        return [(root, root.label)], False
    best = min(f[:2] for f in found)
    return [(n, p) for a, b, n, p in found if (a, b) == best], True


def blocks(root: Node, removed: frozenset[str] | set[str] = frozenset(), visited: dict[str, Node] | None = None) -> list[str]:
    """The texts of the main part's blocks, in page order.

    Left out are noise by role, link lists where nothing is declared, and the branches whose
    path is in ``removed``, unless one holds more than half of the part's text.
    ``visited`` collects the branches that may be removed.
    """
    parts, declared = article_parts(root)
    out: list[str] = []
    buf: list[str] = []

    def flush() -> None:
        if buf:
            text = " ".join("".join(buf).split())
            buf.clear()
            if text:
                out.append(text)

    def skipped(node: Node) -> bool:
        if node.role in ("hard", "soft"):
            return True
        if declared or node.tag in HEADINGS:
            return False
        n, chars = link_share(node)
        return n > 1 and 3 * chars > 2 * text_length(node)

    def walk(node: Node, path: str, headings: bool, whole: int) -> None:
        own = not headings or node.tag in HEADINGS
        for k in node.kids:
            if isinstance(k, str):
                if own:
                    buf.append(k)
            elif k is None:
                flush()
            elif k.tag in _INLINE:
                continue  # noise
            else:
                cell = k.tag in ("td", "th")
                if not cell:
                    flush()
                here = f"{path}/{k.label}"
                if not skipped(k):
                    if k.role != "header" or declared:
                        open_ = not (declared and k.tag in FLOW) and 2 * text_length(k) <= whole
                        if open_ and visited is not None:
                            visited[here] = k
                        if not (open_ and here in removed):
                            # an article's header keeps its title
                            walk(k, here, (headings or k.role == "header") and k.tag not in HEADINGS, whole)
                if cell:
                    buf.append(" ")
                else:
                    flush()

    for node, path in parts:
        walk(node, path, False, text_length(node))
        flush()
    return out


def branches(root: Node) -> list[tuple[str, list[tuple[str, ...]], list[str]]]:
    """(path, the child labels of each occurrence, own texts) for the page's element nodes."""
    styles: dict[str, list[tuple[str, ...]]] = {}
    texts: dict[str, list[str]] = {}

    def go(node: Node, path: str) -> None:
        labels: list[str] = []
        own = []
        for k in node.kids:
            if isinstance(k, Node):
                labels.append(k.label)
                go(k, f"{path}/{k.label}")
            elif k and not k.isspace():
                own.append(k)
                if not labels or labels[-1] != "#text":
                    labels.append("#text")
        styles.setdefault(path, []).append(tuple(labels))
        if own:
            texts.setdefault(path, []).append(" ".join("".join(own).split()))

    go(root, root.label)
    return [(p, s, texts.get(p, [])) for p, s in styles.items()]
