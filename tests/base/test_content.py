"""Content of pages by block scores."""

import pytest
from pyspark.sql import functions as F

from docloom.functions.content import blocks, decoded, page_content

LONG = "A paragraph of running text has many words and few links, which is how content is told from menus and other furniture of a page."
MENU = "".join(f'<a href="/{i}">Menu {i}</a> ' for i in range(8))


def content(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").repartition(2)
    return [r["content"] for r in page_content(df).orderBy("page_id").collect()]


def test_page_without_article(spark):
    html = f"<html><head><title>t</title></head><body><div class=m><div>{MENU}</div><div>{MENU}</div></div><h1>Title</h1><div><p>{LONG}</p><div>{LONG}</div></div><h2>More</h2><div>{MENU}</div><div>© 2024 us</div></body></html>"
    assert content(spark, html) == [f"# Title\n\n{LONG}\n\n{LONG}"]


def test_nested_furniture_leaves_no_rest(spark):
    html = f"<body><nav><ul><li>one</li></ul><nav>inner</nav><p>{LONG}</p></nav><header>site</header><article><header><h1>T</h1></header><p>{LONG}</p><footer>by me</footer></article><footer>end</footer></body>"
    assert content(spark, html) == [f"# T\n\n{LONG}\n\nby me"]


def test_code_tables_lists_and_references(spark):
    html = f"""<main><p>{LONG}</p><pre><code>def f():
    return 1 &lt; 2
</code></pre><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>
    <ul><li>one<ul><li>deep</li></ul></li><li><b>two</b></li></ul><blockquote>said <i>so</i></blockquote>
    <p>caf&eacute; &#233; &#x41;&amp;lt; &bogus; &#xD800; R&D<br>line<img src="a.png" alt="A"> <a href="/x">go</a> on and on with some more words</p></main>"""
    expected = f"{LONG}\n\n```\ndef f():\n    return 1 < 2\n```\n\na | b\n1 | 2\n\n- one\n  - deep\n- **two**\n\n> said *so*\n\ncafé é A&lt; &bogus; &#xD800; R&D\nline![A](a.png) [go](/x) on and on with some more words"
    assert content(spark, html) == [expected]


def test_link_lists_in_an_article_and_short_pages(spark):
    got = content(spark, f"<article><p>{LONG}</p><div>{MENU}</div></article>", "<body><p>Short.</p></body>", None, "", "no blocks", f"<p>{LONG}<p>unclosed <b>tag")
    assert got == [LONG, "Short.", None, None, None, f"{LONG}\n\nunclosed **tag"]


def test_blocks_tell_words_and_links(spark):
    df = spark.createDataFrame([(1, f'<body><p>two words</p><p><a href="#">all links</a></p><p>{LONG}</p><p>{LONG}</p></body>')], "page_id bigint, html string")
    got = [(r["tag"], r["words"], r["links"], r["kept"]) for r in blocks(df).orderBy("place").collect()]
    assert got == [("p", 2, 0.0, False), ("p", 2, 1.0, False), *[("p", len(LONG.split()), 0.0, True)] * 2]


@pytest.mark.parametrize("text, expected", [(None, None), ("", ""), ("&", "&"), ("a&b", "a&b"), ("&amp;&amp;lt;", "&&lt;"), ("&#128512;&hellip;", "\U0001f600…"), ("&#0;&#1114112;", "&#0;&#1114112;"), ("x&nbsp;y;", "x\xa0y;")])
def test_character_references(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(decoded(F.col("t"))).first()[0] == expected
