"""Articles stay whole whatever classes and forms stand around them, and odd markup takes linear time."""

import time

import pytest

from tidemill.llm import html


def texts(page):
    return [t for _, t in html.lines(page)]


@pytest.mark.parametrize(
    "page",
    [
        "<article class='post comments-open'><h1>T</h1><p>Body</p></article>",
        "<article class='related-party-law'><h1>T</h1><p>Body</p></article>",
        "<article class='comment'><h1>T</h1><p>Body</p></article>",
        "<form id=f><nav>x</nav><article><h1>T</h1><p>Body</p></article></form>",
        "<section class='legal'><article><h1>T</h1><p>Body</p></article></section>",
        "<div id='login'><main><h1>T</h1><p>Body</p></main></div>",
        "<div class='modal'><div class='overlay'><article><h1>T</h1></article><article><p>Body</p></article></div></div>",
        "<article><h1>T</h1><section class='legal notice'><p>Body</p></section></article>",
        "<article><h1>T</h1><article class='comment'><p>no</p></article><p>Body</p><div class='ad'>no</div></article><div class='comments'><article class='reply'>no</article></div>",
        "<aside><article>no</article></aside><div hidden><main>no</main></div><article><h1>T</h1><p>Body</p></article><div class='legal'>no</div>",
    ],
)
def test_articles_stay(page):
    assert texts(page) == ["T", "Body"]


def test_a_hint_in_an_article_is_left_to_differencing(spark):
    page = "<article><p>own {0}</p><section class='legal'><p>terms of the site</p></section><section class='legal'><p>case {0}</p></section></article>"
    rows = [(i, f"http://h/a/{i}", page.format(i)) for i in (1, 2)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"own {i}\n\ncase {i}" for i in (1, 2)}


def test_tags():
    assert texts("<p title='a > b'>x</p><p title=\"un'ed\">y</p>") == ["x", "y"]
    assert texts("<p>1 < 2 <! x> <b title='>never closed</b> z</p>") == ["1 < 2 never closed z"]
    assert texts("<p>a <![CDATA[no]]> b <![CDATA[ c > d</p>") == ["a b d"]
    assert texts(f"<p title='{'x' * 100_000}'>long</p>") == ["long"]
    assert texts("<p>end <a href='") == ["end <a href='"] and texts("") == [] and texts("<") == ["<"]


@pytest.mark.parametrize(
    "page",
    ["<a href=\"x " * 90_000, "<a href=\"x> " * 80_001, "<![CDATA[" * 110_000, "<div>" * 100_000 + "</b>" * 100_000, "<nav>" * 200_000, "<b>" * 100_000 + "x<hr>" * 100_000, "<" * 1_000_000, "<b><p>" * 150_000, "<p>" + "<b>" * 150_000 + "<p>" * 150_000, "<a '\" " * 150_000 + ">", "<i>" * 100_000 + "<nav>" + "</i>" * 150_000 + "</nav>", "<!--" * 250_000],
)
def test_odd_markup_takes_linear_time(page):
    def took(text):
        began = time.process_time()
        html.lines(text)
        return time.process_time() - began

    assert took(page) < 8  # quadratic, it would be minutes
