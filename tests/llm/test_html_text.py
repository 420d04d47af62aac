import re
import time
from html import unescape

import pytest

from corvane.llm import html_text

TREE = html_text.trained()


def by_markup(page):
    """The article's headings and paragraphs, for pages whose article has nothing else."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", inner)
    return "\n\n".join(x for x in (" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", y))).split()) for y in parts) if x)


def test_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {r.page_id: by_markup(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in html_text.extracted(pages).collect()}
    assert {i: r.text for i, r in got.items()} == truth
    assert all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("<p>", ""),
        ("<article>A &lt;b&gt; &amp;amp;\n\n  c&#233;<br>d<p>e</article>", "A <b> &amp; cé d\n\ne"),
        ('<nav>x y z</nav><article><script>var a="</p>"</script>one<style>p{}</style><!-- two <p> --> three</article><footer>four</footer>', "one three"),
        ('<header><p>top words here</p></header><article><header><h1>Title</h1></header><p>Body of it.</p></article><aside>side</aside>', "Title\n\nBody of it."),
        ('<article><p>Body</p><div class="comments"><p>a reader said a long thing here</p></div><form><p>sign up now please</p></form></article>', "Body"),
        ('<div id="cookieNotice"><p>we use cookies here and there and everywhere</p></div><main><p>Text</p></main>', "Text"),
        ('<article><p class="ad">buy <b>now</b> please</p><p>Body one.</p><h2 id="related">More</h2><p>Body two.</p></article>', "Body one.\n\nBody two."),
        ('<article><h1>T</h1><p>Body words are here.</p><ul><li><a href=x>a</a></li><li><a href=y>b c</a></li><li><a href=z>d</a></li></ul></article>', "T\n\nBody words are here."),
        ("<article><p>Some text of it.</p><p><a href=x>a lone link</a></p><p>More text of it here.</p></article>", "Some text of it.\n\na lone link\n\nMore text of it here."),
        ('<article><p>Some text of it.</p><div class="related-posts"><p><a href=x>read this too</a></p></div><p>More text.</p><aside><a href=y>and that</a></aside><p>End.</p></article>', "Some text of it.\n\nMore text.\n\nEnd."),
        ("<div>Some words of the site stand here before it all.</div><article><p>Body.</p></article><div>And some more of these stand after it all.</div>", "Body."),
        ("<article><p>one <a href=x>two</a> three four five</p>", "one two three four five"),
    ],
)
def test_small_pages(html, want):
    assert html_text.main_text(html, TREE) == want


def test_page_without_article():
    long = "word " * 60
    page = f'<ul><li><a href="/">home</a></li><li><a href="/b">news</a></li></ul><div><h1>A title of it</h1><p>{long}</p><p>{long}</p></div><div class="footer">imprint and so on</div>'
    got = html_text.main_text(page, TREE)
    assert got.count(long.strip()) == 2 and "home" not in got and "imprint" not in got
    assert html_text.main_text(f"<div><p>{long}</p><p>{long}</p></div>", TREE).count(long.strip()) == 2


def test_edge_rows(spark):
    rows = [(None, None, None, "x"), (1, "u", "<article><p>a</p>", "y"), (1, "u", "<article><p>a</p>", "y"), (2, "v", "<article><p>" + "w " * 300_000, "z")]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 599_999)]
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


STORY = "<h1>A title of it</h1>" + "".join(f"<p>{'word ' * n}</p>" for n in (40, 3, 50, 2, 44))
SAID = ["A title of it", *(" ".join(["word"] * n) for n in (40, 3, 50, 2, 44))]


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "site modal-open", "col-main with-nav", "social-science", "l-legal-news", "banner-free"])
@pytest.mark.parametrize("tag", ["article", "section", "div"])
def test_names_of_wrappers_drop_nothing(name, tag):
    page = f'<nav><a href=x>home</a> <a href=y>news</a></nav><div class="{name}"><{tag}>{STORY}</{tag}></div><footer><p>foot words</p></footer>'
    assert html_text.main_text(page, TREE).split("\n\n") == SAID


@pytest.mark.parametrize("tag", ["article", "section", "div"])
def test_page_in_a_form(tag):
    assert html_text.main_text(f'<form id="aspnetForm"><{tag}>{STORY}</{tag}></form>', TREE).split("\n\n") == SAID


def test_short_parts_of_a_plain_division():
    inner = [("h1", "T t"), ("p", "w " * 60), ("p", "a b"), ("p", "a b c"), ("p", "a b c d e"), ("li", "one"), ("li", "two of it"), ("pre", "x = 1\ny = 2"), ("td", "1"), ("td", "2 3"), ("p", "w " * 60)]
    page = "<ul><li><a>x</a></li><li><a>y z</a></li></ul><div>" + "".join(f"<{t}>{x}</{t}>" for t, x in inner) + "</div><div class=footer>f o o</div>"
    assert html_text.main_text(page, TREE).split("\n\n") == [" ".join(x.split()) for _, x in inner]


def test_comments_that_outgrow_the_text():
    page = f'<div class="post">{STORY}</div><div id="comments">' + f"<p>{'said ' * 90}</p>" * 9 + '</div><div class="site-footer"><p>imprint</p></div>'
    assert html_text.main_text(page, TREE).split("\n\n") == SAID


@pytest.mark.parametrize("piece", ["<a ", '<p title="a ', "<div>", "<div class='x'>", "<!--", "<script>", "<button>a", "<svg>", "<p x='", "<p x=\"'>", "</div>", "<", "&", "<li>", "<p class "])
def test_time_is_linear(piece):
    n = 2_000_000 // len(piece)
    began = time.process_time()
    html_text.main_text(piece * n, TREE)
    assert time.process_time() - began < 10


def test_table_is_learned():
    right = total = 0
    for html, labels in html_text.table_pages():
        share = TREE.share(html_text.features(html_text.parsed(html)))
        right += sum((x >= 0.5) == bool(y) for x, y in zip(share, labels, strict=True))
        total += len(labels)
    assert total > 300 and right / total > 0.98
