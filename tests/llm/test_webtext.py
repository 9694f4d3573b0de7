import html as H
import random
import time

from pyspark.sql import functions as F

from weftgraph.llm import webtext as X
from weftgraph.llm.dom import parse
from weftgraph.llm.wrappers import Wrapper, match, outline


def page(i, rng, article=True, extra=""):
    words = lambda n: " ".join(rng.choice(["été", "the", "of", "<x>", "a&b", "fish", "zu"]) for _ in range(n))
    paragraphs = [words(rng.randrange(1, 30)) + f" {i}" for _ in range(rng.randrange(1, 5))]
    title = words(4) + f" t{i}"
    e = H.escape
    body = f"<h1>{e(title)}</h1><p><b>{e(paragraphs[0])}<br>" + "".join(f"<p>{e(p)}</p>" for p in paragraphs[1:])
    box = ("<article>", "</article>") if article else ('<div id="x">', "</div>")
    out = (
        f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';track({i});</script></head><body>"
        f"<header>Site</header><nav><ul><li><a href='/a'>{e(words(1))}</a></ul></nav><!-- no --><div class=\"ad\">Buy {e(words(2))}</div>"
        f"<div class='cookie-notice'>We use cookies</div>{box[0]}{body}{extra}{box[1]}<aside>side {i}</aside>"
        f"<form><label>Mail</label><input value=q></form><section id=comments><p>nice {i}</p></section><p>All rights kept.</p><footer>&copy; {i}</footer></body></html>"
    )
    return out, " ".join(" ".join(x.split()) for x in [title, *paragraphs])


def test_parser_survives_broken_markup():
    for bad in ["", "<", "<p", "a<b c='>x", "</p></p>", "<ul><li>a<li>b</ul>c", "<script>x", "<!--", "<p><div>q</p>", "<a href=\"x>y", "\x00<b>"]:
        parse(bad)
    assert X.main_text("<ul><li>a<li>b</ul>c<b>d</b>e") == "a b cde"
    assert X.main_text("x&nbsp;&amp;&#233;\n\n y<br>z") == "x &é y z"


def test_a_frame_named_after_its_parts_is_kept():
    page = "<div class='page with-sidebar'><div class=sidebar>no</div><article>yes<section class=comments><h2>Said</h2><article class=comment>no</article></section></article></div>"
    assert X.main_text(page) == "yes"


def test_simple_tree_matching_counts_nodes():
    a, b = (outline([parse(s)])[0] for s in ("<div><p>1</p><ul><li>2</ul><i>3</i></div>", "<div><ul><li>9</ul><b>8</b><i>7</i></div>"))
    assert match(a, b)[id(a), id(b)][0] == 5  # root, div, ul, li, i


def brute_matching(a, b):
    """The textbook recursion."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            best[i][j] = max(best[i][j - 1], best[i - 1][j], best[i - 1][j - 1] + brute_matching(x, y))
    return best[-1][-1] + 1


def test_matching_is_that_of_the_textbook():
    rng = random.Random(8)

    def tree(depth):
        return [rng.choice("abc"), [tree(depth - 1) for _ in range(rng.randrange(5) if depth else 0)]]

    def node(t):
        return [t[0], 1, 0, {}, [node(k) for k in t[1]], 0, 0, 0, 0]

    for _ in range(300):
        a, b = (["r", [tree(3) for _ in range(rng.randrange(5))]] for _ in range(2))
        x, y = node(a), node(b)
        assert match(x, y)[id(x), id(y)][0] == brute_matching(a, b)


def test_any_depth():
    rng = random.Random(3)
    deep = lambda i: "<div>" * 10_000 + f"<p>{i} {rng.random()}</p><p>legal</p>" + "</div>" * 10_000 + "<span>" * 5_000 + "x"
    pages = [deep(i) for i in range(6)]
    w = Wrapper()
    for source in pages:
        w.add(Wrapper.of_page(parse(source)))
    known = Wrapper.load(w.dump()).layout()
    for source in pages:
        assert X.main_text(source) == source.replace("</p><p>", " ").split("<p>")[1].split("</p>")[0] + " x"
        assert "legal" not in X.main_text(source, known)


def test_a_form_around_the_page_is_no_form():
    words = "word " * 60
    article = "<h1>T</h1><p>a</p><form><p>mail me</p><button>go</button></form>"
    for page in (
        f'<form id="aspnetForm"><nav>n</nav><article>{article}</article></form>',
        f'<form><main>{article}</main></form>',
        f"<form><div>{article}</div><footer>f</footer></form>",
    ):
        assert X.main_text(page) == "T a", page
    assert X.main_text(f"<p>before</p><form><p>{words}</p><label>{words}</label></form>") == f"before {words}{words}".strip()
    # A form beside the article goes, however long it is.
    assert X.main_text(f"<article><p>a</p></article><form><p>{words}</p></form>") == "a"
    assert X.main_text(f"<p>{words}</p><form><p>mail me</p></form>") == words.strip()
    assert X.main_text("<p>short</p><form><p>give us your address</p></form>") == "short"
    assert X.main_text("<main><p>a</p></main><nav>x</nav><main><p>b</p><main>c</main></main>") == "a b c"


def test_nesting_takes_time_in_proportion():
    n = 20_000
    start = time.monotonic()
    for opened, closed, text in (('<div class="ad">', "</div>", "<article>x</article>"), ("<form>", "</form>", "<main>x</main>")):
        assert X.main_text(opened * n + text + closed * n) == "x"
    assert X.main_text("<b>" * n + "x" + "</i>" * n) == "x"
    assert X.main_text("<span>" * n + "<p>x" + "</span></i><p>y" * n).startswith("x y")
    assert time.monotonic() - start < 20


def test_parts_of_any_cut_give_the_same_texts(spark):
    rng = random.Random(12)
    made = [page(i, rng, article=i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame([(i, "http://one.example/x", s) for i, (s, _) in enumerate(made)], "page_id long, url string, html string")
    got = [{r.page_id: r.text for r in X.report(df.repartition(n)).collect()} for n in (1, 7)]
    assert got[0] == got[1] == {i: t for i, (_, t) in enumerate(made)}


def test_names_that_articles_use_are_believed_where_the_wrapper_shows_furniture():
    for name in ("related work", "search results", "social history", "alert-levels"):
        assert X.main_text(f"<article><p>a</p><div class='{name}'><p>b</p></div></article>") == "a b"
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))
    rows = [(text(), text(), text()) for _ in range(40)]
    pages = [f"<article><p>{a}</p>{f'<div class=search-results>{c}</div>' if i == 7 else ''}<div class=related>{b}</div></article>" for i, (a, b, c) in enumerate(rows)]
    w = Wrapper()
    for source in pages:
        w.add(Wrapper.of_page(parse(source)))
    known = w.layout()
    assert [X.main_text(s, known) for s in pages] == [a if i != 7 else f"{a} {c}" for i, (a, b, c) in enumerate(rows)]
    assert X.main_text("<article>a<div class='ad-box'>b</div><p hidden>c</p><div class=comments>d</div><div class='share bar'>e</div></article>") == "a c"


def test_the_wrapper_decides_without_an_article(spark):
    rng = random.Random(10)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    made = {i: (text(25), text(30)) for i in range(80)}
    source = lambda a, b: f"<body><div>The Daily Thing</div><div><p>{a}</p><p>{b}</p><p>Send us your letters</p></div><div>All rights kept</div></body>"
    df = spark.createDataFrame([(i, f"http://one.example/{i}", source(*t)) for i, t in made.items()], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in X.report(df).collect()} == {i: " ".join(t) for i, t in made.items()}
    alone = df.withColumn("url", F.concat(F.lit("http://h"), F.col("page_id").cast("string"), F.lit(".example/")))
    assert {r.page_id: r.text for r in X.report(alone).collect()} == {i: f"The Daily Thing {a} {b} Send us your letters All rights kept" for i, (a, b) in made.items()}


def test_constant_places_become_template():
    rng = random.Random(1)
    pages = [page(i, rng, article=False, extra="<p class=tag>Read more below</p>") for i in range(30)]
    whole = Wrapper()
    for k in range(0, 30, 10):
        part = Wrapper()
        for source, _ in pages[k : k + 10]:
            part.add(Wrapper.of_page(parse(source)))
        whole.add(Wrapper.load(part.dump()))
    known = whole.layout()
    for source, want in pages:
        assert X.main_text(source, known) == want
        assert "Read more below" in X.main_text(source)


def test_a_constant_text_among_equal_siblings_is_template():
    rng = random.Random(5)
    unlike = lambda i: " ".join(f"w{i}x{rng.randrange(10**6)}" for _ in range(9))
    for tag in ("div", "p", "li"):
        articles = [[unlike(i) for _ in range(rng.randrange(1, 6))] for i in range(400)]
        pages = ["<body>" + "".join(f"<{tag}>{t}</{tag}>" for t in ("site notice", *a, "legal line")) + "</body>" for a in articles]
        whole = Wrapper()
        for k in range(0, 400, 100):
            part = Wrapper()
            for source in pages[k : k + 100]:
                part.add(Wrapper.of_page(parse(source)))
            whole.add(Wrapper.load(part.dump()))
        known = whole.layout()
        assert [X.main_text(s, known) for s in pages] == [" ".join(a) for a in articles]


def test_a_place_that_was_dropped_while_rare_is_template():
    letters = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))
    once = lambda i: "".join(f"<i class={letters(1000 * i + k)}>{i} {k}</i>" for k in range(60))
    # The notice is on 3 of the first 33 pages, when rare nodes are dropped, and on all later ones: 270 of 300.
    pages = [f"<body>{'' if 2 < i < 33 else '<p>notice</p>'}<div>text {i}</div>{once(i) if i < 33 else ''}</body>" for i in range(300)]
    w = Wrapper()
    for source in pages:
        w.add(Wrapper.of_page(parse(source)))
    known = w.layout()
    assert all("notice" not in X.main_text(s, known) for s in pages)


def test_copies_of_one_page_keep_their_text():
    source, want = page(1, random.Random(2))
    w = Wrapper()
    for _ in range(50):
        w.add(Wrapper.of_page(parse(source)))
    assert w.layout() is None
    assert X.main_text(source, w.layout()) == want


def test_a_long_constant_block_and_copies_leave_the_layout(spark):
    rng = random.Random(6)
    legal = "legal " * 80
    text = lambda i: f"{i} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
    texts = {i: text(i) for i in range(20)}
    texts |= {i: texts[0] for i in range(20, 60)}
    df = spark.createDataFrame([(i, f"http://h.example/{i}", f"<body><p>{legal}</p><p>{t}</p></body>") for i, t in texts.items()], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in X.report(df).collect()} == texts


def test_report(spark):
    rng = random.Random(4)
    made = {i: page(i, rng) for i in range(60)}
    rows = [(i, f"http://h{i % 3}.example/{i}", s, "x") for i, (s, _) in made.items()] + [(100, None, "<p>only</p>", "x"), (101, "http://h1.example/z", None, "x"), (102, "u", "", "x"), (None, "u", "<main>m</main>q", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for limit in (X.BROADCAST_BYTES, 0):
        got = {r.page_id: r.text for r in X.extract(df, broadcast_bytes=limit).collect()}
        assert got == {i: t for i, (_, t) in made.items()} | {100: "only", 101: "", 102: "", None: "m"}
    assert all(r.n_chars == len(r.text) for r in X.report(df).collect())
    assert X.report(df.limit(0)).count() == 0


def test_table_keeps_articles_only(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in X.report(pages).collect():
        article = sources[r.page_id].split("<article>")[1].split("</article>")[0]
        for tag in ("h1", "p", "b"):
            article = article.replace(f"<{tag}>", " " if tag != "b" else "").replace(f"</{tag}>", " " if tag != "b" else "")
        assert r.text == " ".join(H.unescape(article.replace("<br>", " ")).split())
