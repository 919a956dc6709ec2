import pytest

from brandlens.llm import main_text as X

ARTICLE = "<h1>Head</h1><p>A long first paragraph that is surely the bulk of this page, with words.</p><p>En.</p>"
EXPECTED = "Head\nA long first paragraph that is surely the bulk of this page, with words.\nEn."
AROUND = [
    "<nav><ul><li><a href='/a'>Menu</a></li></ul></nav>{}",
    "<header><div>Site name</div></header>{}<footer>&copy; us</footer>",
    "<div class='ad'>Buy this very long advert text that is as long as a paragraph can be, really.</div>{}",
    "{}<section id='comments'><p>A reader comment that is long, long, long, long, long, long, long, long.</p></section>",
    "{}<aside><p>Sidebar text that is long, long, long, long, long, long, long, long, long, long.</p></aside>",
    "<div class='cookie-notice'><p>We use cookies</p><div>nested</div></div>{}",
    "<form><input name=q><p>Search here</p></form>{}<script>var a='</p>';</script><style>p{{}}</style>",
    "<!-- <p>a comment</p> -->{}",
]


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("holder", ["article", "main", "div"])
def test_only_the_article_stays(around, holder):
    page = f"<html><head><title>T</title></head><body>{around.format(f'<{holder}>{ARTICLE}</{holder}>')}</body></html>"
    assert X.main_text(page) == EXPECTED


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<nav>only</nav>", ""), ("plain &lt;b&gt; &amp;amp; text", "plain <b> &amp; text"),
    ("<p>a&nbsp;&#233;\n\t b<br>c</p>", "a é b\nc"), ("<p>one<p>two", "one\ntwo"),
    ("<nav>never closed <p>text</p>", "never closed\ntext"), ("<p>5 < 6 and 7 > 2</p>", "5 < 6 and 7 > 2"),
    ('<p title="a > b">x</p>', "x"), ("<P CLASS=x>Up</P>", "Up"),
])
def test_defined_cases(page, text):
    assert X.main_text(page) == text


def test_whole_long_pages_and_odd_rows(spark):
    long_page = "<article>" + "".join(f"<p>paragraph number {i} of the page</p>" for i in range(5000)) + "</article>"
    rows = [(1, "u", long_page, "x"), (None, None, None, "x"), (2, "v", "", "x"), (2, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = X.extract(pages).collect()
    assert sorted((r.page_id, len(r.text.split("\n"))) for r in found if r.page_id) == [(1, 5000), (2, 1), (2, 1)]
    assert [(r.url, r.text) for r in found if r.page_id is None] == [(None, "")]
    assert X.extract(pages.limit(0)).collect() == []


LONG, SHORT = "word " * 200, "short end of the story with a few words"


@pytest.mark.parametrize("page, text", [
    (f"<main><section><p>{LONG}</p></section><section><p>{SHORT}</p></section></main>", f"{LONG.strip()}\n{SHORT}"),
    (f"<div class='layout has-sidebar'><article><p>{LONG}</p></article><div class='sidebar'>Side</div></div>", LONG.strip()),
    (f"<body><div id='news-alert'><h1>Head</h1><p>{LONG}</p></div></body>", f"Head\n{LONG.strip()}"),
    (f"<article><p>{LONG}</p></article>" + "<p class='ad'>Buy" * 1500, LONG.strip()),
    (f"<ul class='menu'><li class='nav'>One<li class='nav'>Two</ul><article><p>{LONG}</article>", LONG.strip()),
    (f"<div><p>{SHORT}</p></div><div class='comments'><p>{LONG}</p></div>", SHORT),
    ("<p>&#" + "0" * 5000 + "65; &#" + "9" * 5000 + ";</p>", "A \ufffd"),
    (f"<p title=don't>{LONG}</p><p title='x>y'>it's</p>", f"{LONG.strip()}\nit's"),
])
def test_wrappers_sections_and_open_elements(page, text):
    assert X.main_text(page) == text


@pytest.mark.parametrize("part", ["<p a=", "<script ", "<p a=\"", "<div>", "<p class='ad'>", "<!--", "<a '", "</p", "&#", "<li class=menu><p>x"])
def test_time_grows_with_the_length(part):
    import time

    page, began = part * (1_000_000 // len(part)), time.perf_counter()
    X.main_text(page)
    assert time.perf_counter() - began < 10


def test_bulk_against_plain_windows():
    import random

    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        length = [rng.choice([0, 3, 20, 60, 200]) for _ in range(rng.randrange(1, 30))]
        sums = [sum(length[i:i + 3]) for i in range(len(length))]
        level = min(90, max(1, max(sums) / 2))
        expected = [any(sums[i] >= level for i in range(max(0, k - 2), k + 1)) for k in range(len(length))]
        assert X.bulk_lines(np.array(length, float), 3, 90).tolist() == expected
