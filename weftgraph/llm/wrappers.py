"""Wrapper induction: the pages of one host are laid over each other by simple tree matching.

A wrapper is a merged tree of the pages of a host. Aligning a page with it is the simple tree
matching of two ordered trees: children with equal labels are paired so that the number of
matched nodes is largest, in order. Each node counts its pages and summarises the texts that
stood in its place. A place that nearly always held the same text is template; one whose text
varies is content.

Wrappers of parts of a host can be merged in the same way, so a host with a third of all pages is
built in many tasks. Size is bounded: siblings with equal labels are one repeated node, whose texts are each
counted once a page; a place keeps ``KEPT`` candidate texts for each text that a page has there (counts that never
overestimate, and are short by an error of at most a 21st of the pages), and rare nodes are dropped
when a wrapper passes ``MOST_NODES``. A place that comes back after that is held to be missing as many pages as
any dropped one had, at most a tenth of all, and counts with them.
"""

from __future__ import annotations

import pickle
import re
import zlib

import xxhash

from weftgraph.llm.dom import RAW, Element

#: A place is template if at least this share of its pages has one of its commonest texts, over so many pages.
SHARE, LEAST_PAGES = 0.9, 5
#: A place is common, part of a host's layout, if so many pages have it.
COMMON = 0.4
KEPT, MOST_NODES = 20, 1500
_MANY = 12

# A wrapper node: label, pages, pages with a text, {hash: pages}, children, what a count may be short by, most texts of a page,
# most pages that dropped children had, and most pages that this node may have lost.
LABEL, PAGES, SEEN, TEXTS, KIDS, SHORT, WIDE, LOST, MISSED = range(9)

_SKIPPED = RAW | {"head", "br", "noscript", "template", "svg"}
_DIGITS = re.compile(r"\d+")


def _label(e: Element) -> str:
    return f"{e.tag}.{_DIGITS.sub('', e.attrs.get('class', ''))}#{_DIGITS.sub('', e.attrs.get('id', ''))}" if e.attrs else e.tag


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _add_texts(into: list, other: list) -> None:
    """Sums the counts of two nodes; beyond the bound all are lowered until the rarest are gone."""
    texts = into[TEXTS]
    for h, n in other[TEXTS].items():
        texts[h] = texts.get(h, 0) + n
    into[SHORT] += other[SHORT]
    into[WIDE] = max(into[WIDE], other[WIDE])
    most = KEPT * max(1, into[WIDE])
    if len(texts) > most:
        least = sorted(texts.values(), reverse=True)[most]
        into[TEXTS] = {h: n - least for h, n in texts.items() if n > least}
        into[SHORT] += least


def _groups(elements: list[Element]) -> tuple[list, list[list[Element]]]:
    """A wrapper node of equally labelled elements, without children yet, and the groups of equally labelled children."""
    texts: dict[int, int] = {}
    kids: list[Element] = []
    for e in elements:
        if text := e.own_text():
            texts[_hash(text)] = 1
        kids += [c for c in e.children if isinstance(c, Element) and c.tag not in _SKIPPED]
    groups: list[list[Element]] = []
    anywhere = len(kids) > _MANY
    place: dict[str, int] = {}
    for kid in kids:
        label = _label(kid)
        if groups and label in place and (anywhere or place[label] == len(groups) - 1):
            groups[place[label]].append(kid)
        else:
            place[label] = len(groups)
            groups.append([kid])
    return [_label(elements[0]), 1, int(bool(texts)), texts, [], 0, len(texts), 0, 0], groups


def outline(elements: list[Element]) -> tuple[list, list]:
    """A wrapper node of equally labelled elements, and the same tree of the elements themselves. Depth is no matter here and below."""
    node, groups = _groups(elements)
    ref: list = [elements, []]
    stack = [(node, ref, groups)]
    while stack:
        above, above_ref, groups = stack.pop()
        for group in groups:
            child, below = _groups(group)
            child_ref: list = [group, []]
            above[KIDS].append(child)
            above_ref[1].append(child_ref)
            stack.append((child, child_ref, below))
    return node, ref


Pairs = dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]


def match(a: list, b: list) -> Pairs:
    """Simple tree matching of two nodes with equal labels and of all below that may be paired.

    For each pair of nodes (by ``id``) the most nodes that can be matched, and the children paired for that.
    """
    known: Pairs = {}
    stack = [(a, b, False)]
    while stack:
        x, y, ready = stack.pop()
        key = id(x), id(y)
        if key in known:
            continue
        left, right = x[KIDS], y[KIDS]
        if not left or not right:
            known[key] = 1, []
            continue
        labels = [k[LABEL] for k in left]
        aligned = len(set(labels)) == len(labels) and labels == [k[LABEL] for k in right]
        if aligned:
            open_ = list(zip(left, right, strict=True))
        else:
            by_label: dict[str, list] = {}
            for k in right:
                by_label.setdefault(k[LABEL], []).append(k)
            open_ = [(k, other) for k in left for other in by_label.get(k[LABEL], ())]
        if not ready:
            stack.append((x, y, True))
            stack += [(k, other, False) for k, other in open_ if (id(k), id(other)) not in known]
        elif aligned:
            known[key] = 1 + sum(known[id(k), id(other)][0] for k, other in open_), [(i, i) for i in range(len(left))]
        else:
            known[key] = _best(left, right, known)
    return known


def _best(left: list, right: list, known: Pairs) -> tuple[int, list[tuple[int, int]]]:
    """The ordered pairing of children with most matched nodes."""
    n, m = len(left), len(right)
    gain = [[known[id(x), id(y)][0] if x[LABEL] == y[LABEL] else 0 for y in right] for x in left]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            got = best[i - 1][j - 1] + gain[i - 1][j - 1] if gain[i - 1][j - 1] else 0
            best[i][j] = max(got, best[i - 1][j], best[i][j - 1])
    pairs, i, j = [], n, m
    while i and j:
        if gain[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + gain[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[n][m], pairs[::-1]


def merge(tree: list, added: list) -> None:
    """Lays ``added`` over ``tree``; nodes without a counterpart are kept at their place."""
    known = match(tree, added)
    stack = [(tree, added)]
    while stack:
        into, other = stack.pop()
        pairs = known[id(into), id(other)][1]
        into[PAGES] += other[PAGES]
        into[SEEN] += other[SEEN]
        _add_texts(into, other)
        into[MISSED] += other[MISSED]
        stack += [(into[KIDS][i], other[KIDS][j]) for i, j in pairs]
        if other[LOST]:
            matched = {i for i, _ in pairs}
            for i, kid in enumerate(into[KIDS]):
                if i not in matched:
                    _miss(kid, other[LOST])
        if len(pairs) < len(other[KIDS]):
            place, spot, extra = {j: i for i, j in pairs}, 0, 0
            for j, kid in enumerate(other[KIDS]):
                if j in place:
                    spot = place[j] + 1 + extra
                else:
                    if into[LOST]:
                        _miss(kid, into[LOST])
                    into[KIDS].insert(spot, kid)
                    spot, extra = spot + 1, extra + 1
        into[LOST] += other[LOST]


def _nodes(node: list):
    """A node and all below it, each before its children and these in order."""
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack += reversed(node[KIDS])


def _size(node: list) -> int:
    return sum(1 for _ in _nodes(node))


def _miss(node: list, pages: int) -> None:
    for k in _nodes(node):
        k[MISSED] += pages


def _prune(tree: list, least: float) -> None:
    for node in _nodes(tree):
        node[LOST] = max([node[LOST], *(k[PAGES] + k[MISSED] for k in node[KIDS] if k[PAGES] + k[MISSED] <= least)])
        node[KIDS] = [k for k in node[KIDS] if k[PAGES] + k[MISSED] > least]


def _flat(tree: list | None) -> list[list]:
    """The nodes in order, each with its number of children in place of them."""
    return [[*n[:KIDS], len(n[KIDS]), *n[KIDS + 1 :]] for n in _nodes(tree)] if tree is not None else []


def _grown(nodes: list[list]) -> list | None:
    """The tree that ``_flat`` has laid out."""
    open_: list[tuple[list, int]] = []
    for node in nodes:
        n, node[KIDS] = node[KIDS], []
        if open_:
            above, left = open_.pop()
            above[KIDS].append(node)
            if left > 1:
                open_.append((above, left - 1))
        if n:
            open_.append((node, n))
    return nodes[0] if nodes else None


class Wrapper:
    """The merged tree of a host's pages, and the digest of their texts while all have the same."""

    def __init__(self, tree: list | None = None, same: int | None = None):
        self.tree, self.same, self._added = tree, same, 0

    @classmethod
    def of_page(cls, root: Element) -> Wrapper:
        texts = "\0".join(e.own_text() for e in root.elements() if e.tag not in _SKIPPED)
        return cls(outline([root])[0], _hash(texts))

    def add(self, other: Wrapper) -> None:
        if other.tree is None:
            return
        if self.tree is None:
            self.tree, self.same = other.tree, other.same
            return
        merge(self.tree, other.tree)
        if self.same != other.same:
            self.same = None
        self._added += 1
        if self._added % 32 == 0 and _size(self.tree) > MOST_NODES:
            _prune(self.tree, 0.1 * self.tree[PAGES])

    def dump(self, prune: bool = True) -> bytes:
        if prune and self.tree is not None and _size(self.tree) > MOST_NODES:
            _prune(self.tree, 0.1 * self.tree[PAGES])
        return zlib.compress(pickle.dumps((_flat(self.tree), self.same)), 1)

    @classmethod
    def load(cls, data: bytes) -> Wrapper:
        nodes, same = pickle.loads(zlib.decompress(data))
        return cls(_grown(nodes), same)

    def layout(self) -> Wrapper | None:
        """This wrapper with only its template texts, and places that nearly half of the pages have; None if the host shows no layout: few pages, or copies of one.

        In what is returned PAGES says whether a place is common; it is not merged any more and dumped without pruning.
        """
        pages = self.tree[PAGES] if self.tree is not None else 0
        if pages < LEAST_PAGES or self.same is not None:
            return None
        nodes = []
        for node in _flat(self.tree):
            enough = node[SEEN] >= LEAST_PAGES and node[SEEN] + node[MISSED] >= SHARE * pages
            most = {h: n for h, n in node[TEXTS].items() if n + node[SHORT] >= SHARE * node[SEEN]} if enough else {}
            nodes.append([node[LABEL], int(node[PAGES] + node[MISSED] >= COMMON * pages), node[SEEN], most, node[KIDS], 0, 0, 0, 0])
        return Wrapper(_grown(nodes))

    def mark(self, root: Element) -> None:
        """Marks the elements of a page whose own text is template (``template``), and those at common places (``common``)."""
        if self.tree is None:
            return
        page, refs = outline([root])
        pairs = match(self.tree, page)
        stack = [(self.tree, page, refs)]
        while stack:
            known, node, (elements, below) = stack.pop()
            for e in elements:
                e.common = bool(known[PAGES])
                e.template = bool(known[TEXTS]) and _hash(e.own_text()) in known[TEXTS]
            stack += [(known[KIDS][i], node[KIDS][j], below[j]) for i, j in pairs[id(known), id(node)][1]]
