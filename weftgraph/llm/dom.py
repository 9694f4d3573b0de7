"""A small, forgiving HTML tree: enough structure to find blocks, roles and repeated layout.

A node is an ``Element`` with a tag, attributes that matter here, and children that are elements
or strings. Broken markup never fails: unknown end tags are ignored, open elements end with
their parent, and a paragraph or list item ends where the next block begins.
"""

from __future__ import annotations

import html
import re
from collections import Counter

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: An open element of the first kind ends where one of the second begins.
_ENDS_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]), "option": frozenset(["option"]),
}
_ENDING = {tag: ("p", *(t for t, by in _ENDS_BY.items() if tag in by)) for tag in BLOCK}
#: Ending one of these never ends what stands outside.
_WALLS = frozenset("ul ol dl table article section aside nav header footer main body html form".split())

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|--!>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.DOTALL,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


class Element:
    __slots__ = ("tag", "attrs", "children", "template", "common", "frame", "titled")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.template, self.common, self.frame, self.titled = tag, attrs or {}, [], False, False, False, False

    def elements(self):
        """This element and all below it, in page order."""
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def own_text(self) -> str:
        """The text that is directly in this element, white space folded."""
        return " ".join(" ".join(c for c in self.children if isinstance(c, str)).split())


def _attributes(text: str) -> dict[str, str]:
    if "=" not in text:
        return {}
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
    return out


def parse(source: str) -> Element:
    """The tree of a page; its root stands above everything."""
    root = Element("#root")
    stack = [root]
    opened: Counter[str] = Counter()
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            stack[-1].children.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            _end(stack, opened, tag)
            continue
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        if tag in BLOCK:
            _end_implied(stack, opened, tag)
        element = Element(tag, _attributes(attrs))
        stack[-1].children.append(element)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(source, at)
            element.children.append(source[at : close.start() if close else n])
            at = close.end() if close else n
        elif tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
            stack.append(element)
            opened[tag] += 1
    return root


def _close(stack: list[Element], opened: Counter[str], at: int) -> None:
    for e in stack[at:]:
        opened[e.tag] -= 1
    del stack[at:]


def _end(stack: list[Element], opened: Counter[str], tag: str) -> None:
    """Ends the innermost such element; ``opened`` counts the open ones by name, so an end tag without one costs nothing."""
    if not opened[tag]:
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            _close(stack, opened, i)
            return
        if stack[i].tag in _WALLS and tag not in _WALLS:
            return


def _end_implied(stack: list[Element], opened: Counter[str], tag: str) -> None:
    if not any(opened[t] for t in _ENDING[tag]):
        return
    for i in range(len(stack) - 1, 0, -1):
        open_tag = stack[i].tag
        if open_tag == "p" or tag in _ENDS_BY.get(open_tag, ()):
            _close(stack, opened, i)
            if open_tag == "p":
                _end_implied(stack, opened, tag)
            return
        if open_tag in _WALLS or open_tag in ("div", "blockquote", "details", "figure"):
            return
