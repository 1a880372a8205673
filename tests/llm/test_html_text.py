from ranklake.llm.html_text import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy now, it is cheap.</div>
<article><h1>A &amp;amp; B</h1><p><b>First  para,<br>with more text. <p>Second para, long enough to count.</p><p>Be.</p>
<form><input>Name</form><div class="comments"><p>Nice, thanks for it.</p></div></article>
<aside>Side</aside><footer>&copy; x</footer>"""


def test_article_only():
    assert main_text(PAGE) == "A &amp; B\nFirst para, with more text.\nSecond para, long enough to count.\nBe."
    assert main_text(None) == main_text("") == main_text("<script>x") == ""
    assert main_text("<p>a < b") == "a < b"


def test_sample_pages(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<b>|</b>", "", x)).split()) for x in re.split("<br>|</?p>|</?h1>", inner)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


LONG = " ".join(["A sentence, with some words in it."] * 8)


def page(inner):
    return f'<html><body><nav><ul><li><a href="/">Home</a></ul></nav>{inner}<footer>(c) x</footer></body></html>'


def test_whole_article():
    for inner, want in [
        (f"<article><h1>Title</h1><div class='body'><p>{LONG}</p><p>{LONG}</p></div></article>", ["Title", LONG, LONG]),
        (f"<article><section><p>{LONG}</p><p>{LONG}</p></section><section><p>{LONG}</p></section></article>", [LONG] * 3),
        (f"<article><h1><a href='x'>Title</a></h1><p>{LONG}</p><ul><li><a href='y'>One</a><li><a href='z'>Two</a></ul></article>", ["Title", LONG, "One", "Two"]),
        (f"<div><h1><a href='x'>Title</a></h1><div><p>{LONG}</p><p>{LONG}</p></div></div><div><a href='y'>More</a></div>", ["Title", LONG, LONG]),
        (f"<div><section><p>{LONG}</p><p>{LONG}</p></section><section><h2>Part</h2><p>{LONG}</p></section></div>", [LONG, LONG, "Part", LONG]),
    ]:
        assert main_text(page(inner)).split("\n") == want, inner


def test_marked_wrappers():
    article, side = f"<article><h1>Title</h1><p>{LONG}</p></article>", f"<p>{LONG}</p>"
    for start in ("<div class='layout has-sidebar'>", "<div class='no-sidebar'>", "<div class='post social-share-on'>", "<div id='content-widget'>", "<form action='x'>"):
        assert main_text(page(f"{start}{article}")).split("\n")[:2] == ["Title", LONG], start
        assert main_text(page(f"{start}<div><p>{LONG}</p><p>{LONG}</p></div><nav>Menu</nav>")).split("\n")[:2] == [LONG, LONG], start
    assert main_text(f"<html><body><form>{page(article)}</form>") == f"Title\n{LONG}"
    # what is not the main text stays out, however long, with an article in it or not
    for start in ("<div class='comments'>", "<div class='sidebar'>", "<div class='site-footer'>", "<div class='cookie-banner'>", "<form>", "<aside>"):
        end = f"</{start[1:].split('>')[0].split()[0]}>"
        assert main_text(page(f"{article}{start}{side * 3}{end}")) == f"Title\n{LONG}", start
    assert main_text(page(f"{article}<div class='comments'>{article * 3}</div>")) == f"Title\n{LONG}"
    assert main_text(page(f"{article}<div class='sidebar'><article><p>Short.</p></article></div>")) == f"Title\n{LONG}"
    assert main_text(page(f"<p>{LONG}</p><div class='comments'>{side * 4}</div>")) == LONG


def test_attributes_and_wrappers_do_not_swallow_text():
    article = f"<article><h1>Title</h1><p>{LONG}</p></article>"
    for start in ("<div title=it's>", "<div title='a>b' data-id=ad>", '<div title="class=ad">', '<div class="content with-sidebar">', '<div id="page-header-wrap">', "<div hidden class>", "<div a=\"x'y\" b='p\"q'>"):
        assert main_text(page(f"{start}{article}")) == f"Title\n{LONG}", start
    inner = f"<p title=it's>{LONG}</p><p>It's {LONG}</p>"
    assert main_text(page(f"<article>{inner}</article>")) == f"{LONG}\nIt's {LONG}"


def test_rows(spark):
    """Repeated rows, names that clash, a long page, an empty table."""
    rows = [(1, "u", "<p>Text of it.</p>", 5), (1, "u", "<p>Text of it.</p>", 5), (None, None, None, None), (2, "v", f"<article>{'<p>' + LONG * 3000}</article>", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int").withColumnRenamed("n_chars", "text")
    got = sorted(extract(pages).collect(), key=lambda r: (r.page_id or 0))
    assert [(r.page_id, r.text) for r in got[:3]] == [(None, ""), (1, "Text of it."), (1, "Text of it.")] and got[3].n_chars == len(" ".join([LONG * 3000]))
    assert extract(pages.limit(0)).count() == 0
