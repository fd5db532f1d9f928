import time

from basalt.llm import maintext as M

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><header><div>Site</div><form><label>Find</label><input></form></header>
<nav><a href="1">Home</a> <a href="2">News</a></nav><div class="cookie-notice">We use cookies to make all of this much better for each of you.</div>
<main><article class="post"><header><h1>The <a href="x">Title</a></h1></header><p>First &amp; par&eacute; <a href="q">link</a> and<br>more&nbsp;text.<p>Unclosed <b>bold
 one</b><div class="ad">Buy now</div><aside>Pulled</aside><ul><li>item</li></ul><!-- <p>gone</p> --><script>var a="<p>x</p>";</script><p>Short.</p>
<section id="comments"><h2>Comments</h2><p>A long comment by a reader who had very many words to say about it.</p></section></article></main>
<div class="sidebar"><p>Side text that is rather long and has no link in it at all, but stands aside.</p></div><footer>&copy; me</footer></body></html>"""
TEXT = "The Title\nFirst & paré link and more text.\nUnclosed bold one\nitem\nShort."


def test_page():
    assert M.main_text(PAGE) == TEXT


def test_without_a_named_region():
    long = "This is a plain paragraph of the story which has more than enough words to be taken for content by density alone."
    page = f"<div><a href=1>a</a> <a href=2>b</a></div><h2>A heading of it</h2><p>{long}</p><p>{long}</p><div><a href=3>next</a></div>"
    assert M.main_text(page) == f"A heading of it\n{long}\n{long}"


def test_broken_markup():
    assert M.main_text(None) == "" and M.main_text("") == "" and M.main_text("<script>x") == "" and M.main_text("<!-- x") == ""
    assert M.main_text("<article><p>a < b &lt; c</article>") == "a < b < c"
    assert M.main_text("<article><p title='a>b'>x</p></div></article>") == "x"


def test_nothing_else_of_the_article_goes():
    assert M.main_text('<article><h2>Results and discussion</h2><section id="results-discussion"><p>A paragraph.</p></section></article>') == "Results and discussion\nA paragraph."
    assert M.main_text('<article><p>Some text.</p><div class="widget-content"><p>A paragraph of it.</p></div><p>More.</p></article>') == "Some text.\nA paragraph of it.\nMore."
    long = "A paragraph that its author calls a notice, which has very many more words than any notice of a site would ever have, so that it is text of the article as it stands here for all to read."
    assert M.main_text(f'<article><p>Some text.</p><p class="notice">{long}</p><p class="notice">Do note.</p></article>') == f"Some text.\n{long}"
    assert M.main_text("<article><p>Some text.</p><p><a href=x>All of this paragraph is a link to elsewhere.</a></p><p>More.</p></article>") == "Some text.\nAll of this paragraph is a link to elsewhere.\nMore."
    assert M.main_text("<article><p>Some text.</p><p><a href=x>All</a></p><p><a href=x>of it</a></p><p><a href=x>menu</a></p><p>More.</p></article>") == "Some text.\nMore."


def test_lists_of_links_in_the_article_stay():
    page = "<nav><ul><li><a href=1>Home page here</a><li><a href=2>News and more</a></ul></nav><article><h1>Head</h1><p>Some text of the article.</p><ul>%s</ul><p>And more text of it.</p></article><ul><li><a href=9>One other story here</a><li><a href=8>Two other stories here</a></ul>"
    for items in (["First source title", "Second source title"], ["See the manual of it", "Then read the notes on this", "And the last one of all these sources"], ["A source whose title is much longer than any menu entry would be", "Short but of three"]):
        listed = "".join(f"<li><a href=x>{t}</a></li>" for t in items)
        assert M.main_text(page % listed) == "\n".join(["Head", "Some text of the article.", *items, "And more text of it."])


def measured(page, wanted):
    """(right, found, wanted) of the blocks that are kept."""
    got = M.main_text(page).split("\n")
    return len(set(got) & set(wanted)), len(set(got)), len(set(wanted))


def test_precision_and_recall_on_pages_of_the_table():
    """Blocks of real pages, labelled by what their marks say: text under an element whose tag or class names furniture is none of the article."""
    import pyarrow.parquet as pq

    right = found = wanted = 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        content = [b[0] for b in M.blocks(page or "") if b[3] == 1 and b[4] == 0]
        if content:
            r, f, w = measured(page, content)
            right, found, wanted = right + r, found + f, wanted + w
    assert wanted > 500 and right / found >= 0.98 and right / wanted >= 0.98, (right, found, wanted)


def test_neighbours_decide():
    """In the article as elsewhere the class of many blocks follows from those around them."""
    for region in (0, 1):
        changed = sum(len({M.is_content((region, 0, 0, w, d, *a, *b)) for a in ((0, 0), (50, 0), (2, 1)) for b in ((0, 0), (50, 0), (2, 1))}) > 1 for w in range(1, 30) for d in (0, 0.2, 0.5, 1))
        assert changed >= 8


def test_quotes_that_are_never_closed():
    assert M.main_text('<article><p title="abc>hello</p><p>world</p></article>') == "hello\nworld"
    assert M.main_text("<article><p title=it's>hello</p><p>don't</p></article>") == "hello\ndon't"
    assert M.main_text('<article><p title="abc>hello</p><p>"quoted" words</p></article>') == 'hello\n"quoted" words'
    assert M.main_text("<article><p title='a>b' class=x>x</p><p a = \"<i>\" b='>'>y</p></article>") == "x\ny"


def test_long_and_hostile_pages_take_linear_time():
    page = "<article>" + '<p>hello <b class="x">world</b> and some more words &amp; so on</p>\n' * 70_000 + "</article>"
    began = time.time()
    assert M.main_text(page) == "\n".join(["hello world and some more words & so on"] * 70_000)
    for junk in ('<a "x" \' ', '<p title="x>', "<div>", "<p a='", "<", "</", "<!", "<!--", '<div class="', "<b ", " <p a='x\">", "<script>"):
        M.main_text("<article>" + junk * 100_000 + '"')
    assert time.time() - began < 30


def test_furniture_that_is_never_closed():
    page = "<body><nav><ul><li><a href=1>Home</a><div class=ad>Buy</div><article><h1>Head</h1><p>Text of it.</p><div class=ad>Buy</div></article><footer>x</footer>"
    assert M.main_text(page) == "Head\nText of it."


def test_tree_fits_its_table():
    rows = M.labelled()
    assert all(M.is_content(tuple(r[:-1])) == bool(r[-1]) for r in rows)


def test_odd_rows(spark):
    rows = [(1, "u", PAGE, "t", 3), (None, None, None, "t", 3), (2, "", "", "t", 3), (1, "u", PAGE, "t", 3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, c0 int")
    got = sorted((r["page_id"] or 0, r["url"], r["text"]) for r in M.extract(df).where("page_id is not null").collect())
    assert got == [(1, "u", TEXT), (1, "u", TEXT), (2, "", "")]
    assert M.extract(df).where("page_id is null").collect()[0]["text"] == "" and M.extract(df.limit(0)).count() == 0
