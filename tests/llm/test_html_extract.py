import html
import re
import time

import duckdb
import pytest
from simloom.llm.html_extract import extracted, main_text

PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><body><div class="header">Logo</div><div class="menu"><a href=x>Home</a> <a href=y>B</a></div>'
    '<div id="content"><h2>Title here</h2><p>First para, with some text. More of it.</p><ul><li>one item, ok<li>two item</ul><p>Second&nbsp;para   with\n text &lt;b&gt;.</p>'
    '<div class="comment"><p>I agree, with all. Yes.</p></div></div><div class="sidebar"><p>Side text, yes it is.</p></div><form>Name <input></form><footer>foot</footer></body></html>'
)


@pytest.mark.parametrize(
    "page,text",
    [
        (PAGE, "Title here\nFirst para, with some text. More of it.\none item, ok\ntwo item\nSecond para with text <b>."),
        ("<p>just a para", "just a para"), ("plain text only", "plain text only"), ("", ""), (None, ""), ("<div></div>", ""), ("<<<>>><p", "<<<>>>"),
        ("<p>a<b>b</b> c<br>d</p>", "ab c\nd"), ("<table><tr><td>Cell one, text.<td>Cell two</table>", "Cell one, text.\nCell two"),
        ("<article><h1>H</h1><p>x &amp;amp; y.</p><script>var t='</p>'</script></article>", "H\nx &amp; y."), ("<!-- a --><article>t<!-- <p>no -->", "t"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("put", [None, '<div class="c1">', '<div class="post-body"><section class="a">', '<td class="x">'])
def test_articles_of_the_test_pages(put):
    """Also with the article's tag replaced, so that only ratios tell it from the rest."""
    for page_id, page in duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall():
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        lines = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br|div)[^>]*>", "\n", body)).split("\n")
        page = page if put is None else page.replace("<article>", put).replace("</article>", "</" + re.findall(r"<(\w+)", put)[0] + ">")
        assert main_text(page) == "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in lines) if x), page_id


SENTENCES = [f"Sentence number {i}, of some length, stands in this place; it goes on for a while and then ends." for i in range(40)]
PARA = lambda a, b: "<p>" + " ".join(SENTENCES[a:b]) + "</p>"
ROWS = "<ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(30)) + "</ul>"


def words_of(*spans):
    return [" ".join(SENTENCES[a:b]) for a, b in spans]


def test_ratios_choose_without_marks():
    page = f"<body><div class=x1>{ROWS}</div><div class=x2><h2>A heading</h2>{PARA(0, 5)}{PARA(5, 9)}<p>Short one.</p><ol><li>Item one<li>Item two</ol>{PARA(9, 14)}</div><div class=x3>Some words<br>more words<br>All rights</div><div class=x4>{ROWS}</div></body>"
    a, b, c = words_of((0, 5), (5, 9), (9, 14))
    assert main_text(page).split("\n") == ["A heading", a, b, "Short one.", "Item one", "Item two", c]


def test_sections_of_one_text_stay_together():
    page = f"<div class=head>Logo text</div><div class=content><section id=a>{''.join(PARA(i, i + 4) for i in range(5))}</section><section id=b>{PARA(30, 32)}</section></div>"
    assert main_text(page).split("\n") == words_of(*[(i, i + 4) for i in range(5)], (30, 32))
    page = page.replace("<section id=a>", "<section class=first>").replace("<section id=b>", "<section class=last>")
    assert main_text(page).split("\n") == words_of(*[(i, i + 4) for i in range(5)], (30, 32))


def test_a_wrapper_named_after_its_sidebar_is_no_sidebar():
    page = f"<div class=content-sidebar><h1>Title</h1>{PARA(0, 4)}<div class=sidebar>{PARA(5, 6)}</div></div><div class=comments>{PARA(7, 12)}</div>"
    assert main_text(page).split("\n") == ["Title", *words_of((0, 4))]


def test_deep_and_broken_pages_take_linear_time():
    def cost(n):
        began = time.process_time()
        assert main_text("<div>x " * n).split() == ["x"] * n
        main_text("<table><tr><td>" + "<i>y" * n + "</p>" * n)
        main_text("<ul>" + "<div><li>z" * n + "</b></em></td>" * n)
        return time.process_time() - began

    cost(200)
    assert cost(16000) < 14 * cost(2000) + 0.5


def test_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>é</p>", 1), (None, None, None, 2), (1, "u", "<p>é</p>", 3)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, extracted(df).collect()), key=repr) == [(1, "u", "é", 1), (1, "u", "é", 1), (None, None, "", 0)]
    assert extracted(df.limit(0)).count() == 0
