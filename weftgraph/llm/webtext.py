"""Main text of web pages: wrapper induction per host, then the roles of what is left.

First every host's wrapper is built (see ``wrappers``): each task merges the pages that it reads, by host,
and the partial wrappers of a host are merged in two steps, so no task sees all pages of a host and only
pages that occur several times on a host move: they count once. Then each page is laid over its host's wrapper again:
places with constant text are template and dropped, wherever they are; slots whose text varies are content.

What varies but is no article text needs another sign. Elements that HTML itself sets apart (nav, aside, footer,
script) go always, a form unless it is the frame of the page, and so does what is named after nothing but furniture (``class="ad-box"``, ``id="comments"``).
Names that articles use too (``related``, ``search``) are only believed if the wrapper shows that place to be
part of the host's layout, or, on a host without a wrapper, outside the article.

Wrappers are broadcast if they take no more than ``BROADCAST_BYTES`` together; otherwise pages and
wrappers are joined by host, where Spark splits the pages of a hot host.

Cases: a null or empty page has an empty text; pages without an address form one host; hosts with
few pages, or whose pages are copies of one page, have no wrapper and are told by elements and names alone; if
the template would leave nothing, these alone decide; broken markup and nesting of any depth never fail and take time in proportion to
their length; of several main elements all are text, in page order; text that is hidden by a style is text; repeated rows and page
identifiers each get their text; a column that is named like the text is replaced, other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph import scratch
from weftgraph.llm.dom import BLOCK, RAW, Element, parse
from weftgraph.llm.textcols import without
from weftgraph.llm.wrappers import Wrapper

BROADCAST_BYTES = 32 << 20
#: Partial wrappers of a host are merged in so many parts before they meet.
PARTS = 16
#: A form that holds half of a page's text is the page's frame if it has so many characters.
LEAST_FORM = 200

# Elements that are not article text.
_DROPPED = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video nav footer aside form button select textarea input "
    "datalist dialog menu search title".split()
)
# Elements of forms whose text is not counted to what a form holds.
_CONTROLS = frozenset("button select textarea datalist label legend".split())
# Names of furniture: a class or id made of these words alone, and of the words below, is not article text.
_FURNITURE = frozenset(
    "ad ads adv adslot adbox adunit advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu "
    "sidebar aside footer masthead topbar breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notices popup comment comments "
    "commentlist disqus share sharing newsletter subscribe paywall".split()
)
_PARTS = frozenset("box slot unit wrap wrapper container block section area list item items inner outer top bottom left right panel bar links buttons form".split())
# Names that furniture shares with articles.
_DOUBTFUL = frozenset(
    "banner header alert modal overlay discussion replies reply respond social related recommended recommendations subscription signup login search "
    "widget toolbar skip copyright".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_CONTENT = frozenset("content article post entry story".split())
_WORDS = re.compile(r"[a-z]+")
_KEPT_ROOTS = ("html", "body", "#root", "main")


def _tokens(e: Element) -> list[set[str]]:
    """The words of each class and id."""
    return [set(_WORDS.findall(t)) for t in f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}".lower().split()]


def _names(e: Element) -> set[str]:
    return set().union(*_tokens(e))


def survey(page: Element) -> None:
    """Notes at each element what the elements below it are, in one pass from the leaves up.

    ``frame``: below it is a main element or an article, or, for a form, a first heading or half of the page's text; ``titled``: below
    it is a heading of the first two levels. A page within a form is thus told from a form within a page.
    """
    order = list(page.elements())
    size: dict[int, int] = {}
    heading: set[int] = set()
    for e in reversed(order):
        held = 0 if e.tag in RAW or e.tag in _CONTROLS else sum(len(c) - c.count(" ") if isinstance(c, str) else size[id(c)] for c in e.children)
        size[id(e)] = held
        for c in e.children:
            if isinstance(c, Element):
                e.frame = e.frame or c.frame or c.tag == "main" or (c.tag == "article" and not not_article(c))
                e.titled = e.titled or c.titled or c.tag in ("h1", "h2")
                if c.tag == "h1" or id(c) in heading:
                    heading.add(id(e))
    for e in order:
        if e.tag == "form":
            e.frame = e.frame or id(e) in heading or 0 < size[id(page)] <= 2 * size[id(e)] and size[id(e)] >= LEAST_FORM


def not_article(e: Element, inside: bool = False, laid_out: bool = False) -> bool:
    """Whether an element of a surveyed page is something else than article text.

    ``inside``: it stands in the article; ``laid_out``: the page has been laid over a wrapper.
    """
    if e.tag == "form" and e.frame and not inside:
        return False
    if e.tag in _DROPPED:
        return True
    if e.tag == "header" and not (inside and e.titled):
        return True
    if not e.attrs or e.tag in _KEPT_ROOTS:
        return False
    if e.attrs.get("role", "").lower() in _ROLES:
        return True
    tokens = _tokens(e)
    named = any(t & _FURNITURE and t <= _FURNITURE | _PARTS for t in tokens)
    if not named and (e.common if laid_out else not inside):
        doubtful = _DOUBTFUL - {"header"} if inside or e.tag == "article" else _DOUBTFUL
        named = any(t & doubtful and t <= _FURNITURE | _PARTS | _DOUBTFUL for t in tokens)
    if not named:
        return False
    # Such words also name the frame of a whole page; a frame holds the article.
    return e.tag == "article" or not e.frame


def roots(page: Element) -> list[Element]:
    """Where the article is: the main elements, else articles, else a content element with most text, else all."""
    mains, articles, named = [], [], []
    stack = [page]
    while stack:
        e = stack.pop()
        if e.tag == "main" or e.attrs.get("role", "").lower() == "main":
            mains.append(e)
            continue
        elif not_article(e):
            continue
        elif e.tag == "article":
            articles.append(e)
            continue
        elif e.attrs and e.tag in ("div", "section", "td") and _names(e) & _CONTENT:
            named.append(e)
        stack.extend(c for c in reversed(e.children) if isinstance(c, Element))
    if mains:
        return mains
    if articles:
        return articles
    if named:
        size = {id(e): len(_joined([e])) for e in named}
        best = max(named, key=lambda e: size[id(e)])
        if 2 * size[id(best)] >= len(_joined([page])):
            return [best]
    return [page]


def _joined(tops: list[Element], use_template: bool = False, inside: bool = True, laid_out: bool = False) -> str:
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            blocks.append(text)
        run.clear()

    for top in tops:
        stack: list = [top]
        while stack:
            e = stack.pop()
            if e is None:
                flush()
            elif isinstance(e, str):
                run.append(e)
            else:
                if e is not top and not_article(e, inside, laid_out):
                    if e.tag in BLOCK:
                        flush()
                    continue
                if e.tag == "br":
                    run.append("\n")
                    continue
                block = e.tag in BLOCK or e is top
                if block:
                    flush()
                    stack.append(None)
                drop = use_template and e.template
                stack.extend(c for c in reversed(e.children) if not (drop and isinstance(c, str)))
    flush()
    return " ".join(blocks)


def main_text(source: str | None, wrapper: Wrapper | None = None) -> str:
    """The article of one page, given its host's layout."""
    if not source:
        return ""
    page = parse(source)
    survey(page)
    tops = roots(page)
    inside, laid_out = tops != [page], wrapper is not None
    if laid_out:
        wrapper.mark(page)
        if text := _joined(tops, True, inside, True):
            return text
    return _joined(tops, False, inside, laid_out)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\w+://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each run of equal hosts in a sorted partition."""
    host, wrapper = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([wrapper.dump()], pa.binary())], ["host", "wrapper"])
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if wrapper is not None and name != host:
                yield out()
                wrapper = None
            if wrapper is None:
                host, wrapper = name, Wrapper()
            wrapper.add(Wrapper.load(data.as_py()))
    if wrapper is not None:
        yield out()


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) of every host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Wrapper] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([w.dump() for w in found.values()], pa.binary())], ["host", "wrapper"])

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text := source.as_py():
                    found.setdefault(host, Wrapper()).add(Wrapper.of_page(parse(text)))
            if len(found) > 5000:
                yield out()
                found = {}
        if found:
            yield out()

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("html <> ''").withColumn("page", F.xxhash64("host", "html"))
    repeated = scratch.written(rows.groupBy("page").agg(F.count("*").alias("n")).where("n > 1").select("page"), "repeated")
    once = rows.join(repeated, "page", "left_anti").select("host", "html")
    if not repeated.isEmpty():
        once = once.unionByName(rows.join(repeated, "page", "left_semi").groupBy("page", "host").agg(F.min("html").alias("html")).select("host", "html"))
    parts = once.mapInArrow(run, "host string, wrapper binary")
    part = F.pmod(F.xxhash64("wrapper"), F.lit(PARTS))
    once = parts.withColumn("part", part).repartition("host", "part").sortWithinPartitions("host", F.xxhash64("wrapper")).select("host", "wrapper").mapInArrow(_merged, "host string, wrapper binary")
    return once.repartition("host").sortWithinPartitions("host", F.xxhash64("wrapper")).mapInArrow(_merged, "host string, wrapper binary")


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The layout of each host that shows one: all that its pages need of the wrapper."""
    for batch in batches:
        found = [(host, known.dump(prune=False)) for host, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if (known := Wrapper.load(data.as_py()).layout())]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([d for _, d in found], pa.binary())], ["host", "wrapper"])


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_as: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``pages`` with their main text in place of the html."""
    if text_as not in (url_col, html_col):
        pages = without(pages, text_as)
    pages = without(pages, "_host", "_wrapper")
    induced = scratch.written(induce(pages, url_col, html_col).mapInArrow(_layouts, "host string, wrapper binary"), "wrappers")
    size = induced.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()[0]
    fields = [f for f in pages.schema.fields if f.name != html_col]
    schema = T.StructType([*fields, T.StructField(text_as, T.StringType())])
    rows = pages.withColumn("_host", host_of(F.col(url_col)))
    shipped = None
    if size <= broadcast_bytes:
        shipped = pages.sparkSession.sparkContext.broadcast({r.host: bytes(r.wrapper) for r in induced.toLocalIterator()})
    else:
        rows = rows.join(induced.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper")), "_host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Wrapper | None] = {}
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            given = column.get("_wrapper")
            texts = []
            for i, host in enumerate(column["_host"].to_pylist()):
                if host not in ready:
                    if len(ready) > 2000:
                        ready.clear()
                    data = shipped.value.get(host) if shipped is not None else given[i].as_py()
                    ready[host] = Wrapper.load(data) if data else None
                texts.append(main_text(column[html_col][i].as_py(), ready[host]))
            yield pa.RecordBatch.from_arrays([*(column[f.name] for f in fields), pa.array(texts, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def report(pages: DataFrame) -> DataFrame:
    """The contract's row for each page."""
    return extract(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("bigint"))
