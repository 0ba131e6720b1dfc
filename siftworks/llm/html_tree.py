"""HTML to a tree of block elements and text runs, tolerant of unclosed tags.  No Spark here."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body main article section aside nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption form fieldset legend address details summary center dialog hgroup menu search hr".split()
)
SKIPPED = frozenset("script style template head title iframe select option optgroup textarea button datalist".split())  # never text: code, and controls of forms
_RAW = frozenset(("script", "style", "textarea", "title", "iframe", "template"))
_IN_HEAD = frozenset("base link meta noscript script style template title head html".split())  # other start tags, and text, end a head
#: A start tag of the first kind ends an open element of the second kinds, up to one of the third.
_CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
_CELLS = ("td", "th", "table")  # an end tag inside a cell does not end what was opened outside, but for these
_ENDS_CELLS = frozenset("table tr tbody thead tfoot body html".split())
_PROSE = frozenset("p li dd dt td th h1 h2 h3 h4 h5 h6 blockquote figcaption".split())
_INLINE_BUTTON = "#button"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACES = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    """An element, or a text run (tag ''): the inline text between two block boundaries."""

    tag: str
    parent: int
    names: str = ""  # class, id and role, in lower case
    text: str = ""
    linked: int = 0  # characters inside links
    label: int = -1  # of training pages
    hidden: bool = False
    children: list[int] = field(default_factory=list)


def parse(html: str) -> list[Node]:
    """Nodes in document order, parents before children; node 0 is the root."""
    nodes = [Node("#root", -1)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements; inline ones share their block's node
    opened: dict[str, list[int]] = {}  # depths of the open elements of each tag, so that no tag searches the stack
    blocks: list[int] = [0]  # depths of the open block elements
    skip = links = 0
    pieces: list[tuple[str, bool]] = []

    def close_run() -> None:
        if pieces:
            text = _SPACES.sub(" ", unescape("".join(p for p, _ in pieces))).strip()
            if text:
                at = stack[-1][1]
                linked = sum(len(p.strip()) for p, link in pieces if link)
                nodes.append(Node("", at, text=text, linked=min(linked, len(text)), label=nodes[at].label, hidden=nodes[at].hidden))
                nodes[at].children.append(len(nodes) - 1)
            pieces.clear()

    def push(tag: str, node: int) -> None:
        opened.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append((tag, node))

    def pop_to(depth: int) -> None:
        nonlocal skip, links
        if blocks[-1] >= depth:
            close_run()
        for t, _ in stack[depth:]:
            opened[t].pop()
            skip -= t in SKIPPED
            links -= t == "a"
        del stack[depth:]
        while blocks[-1] >= depth:
            blocks.pop()

    def deepest(tags: frozenset[str] | tuple[str, ...]) -> int:
        """Depth of the innermost open element of these tags; 0 if none is open."""
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    at, lower = 0, None
    while at < len(html):
        m = _TOKEN.match(html, at)
        if m is None:  # a quote that never ends: take the rest up to the next '>'
            end = html.find(">", at)
            at = end + 1 if end >= 0 else len(html)
            continue
        at = m.end()
        if m[4] is not None:
            if stack[-1][0] == "head" and not m[4].isspace():
                pop_to(len(stack) - 1)
            if not skip:
                pieces.append((m[4], links > 0))
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            tag = _INLINE_BUTTON if tag == "button" and opened.get(_INLINE_BUTTON) else tag
            depth = deepest((tag,))
            if depth and (tag in _ENDS_CELLS or depth >= deepest(_CELLS)):
                pop_to(depth)
            continue
        if stack[-1][0] == "head" and tag not in _IN_HEAD:
            pop_to(len(stack) - 1)
        if tag == "br":
            if not skip:
                pieces.append((" ", links > 0))
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in BLOCK:
            if stack[blocks[-1]][0] == "p":
                pop_to(blocks[-1])
            close_run()
        if tag in _CLOSES:
            same, stop = _CLOSES[tag]
            if deepest(same) > deepest(stop):
                pop_to(deepest(same))
        if tag == "button" and stack[blocks[-1]][0] in _PROSE and not opened.get("form"):
            tag = _INLINE_BUTTON  # a word of a sentence, not a control beside one
        if tag == "hr":
            continue
        if tag in SKIPPED:
            if tag in _RAW:
                lower = html.lower() if lower is None else lower
                end = lower.find(f"</{tag}", at)
                stop = html.find(">", end) if end >= 0 else -1
                at = stop + 1 if stop >= 0 else len(html)
                continue
            push(tag, stack[-1][1])
            skip += 1
            continue
        if tag in BLOCK and not skip:
            parent = stack[-1][1]
            got = {a[1].lower(): next((v for v in a.groups()[1:] if v is not None), "") for a in _ATTRIBUTE.finditer(m[3])}
            style = got.get("style", "").lower().replace(" ", "")
            hidden = nodes[parent].hidden or "hidden" in got or "display:none" in style
            label = {"0": 0, "1": 1}.get(got.get("data-label"), nodes[parent].label)  # other values are the page's own
            nodes.append(Node(tag, parent, " ".join(got.get(k, "") for k in ("class", "id", "role")), label=label, hidden=hidden))
            nodes[parent].children.append(len(nodes) - 1)
            push(tag, len(nodes) - 1)
        else:
            links += tag == "a"
            push(tag, stack[-1][1])
    close_run()
    return nodes
