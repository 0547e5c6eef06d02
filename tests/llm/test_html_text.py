import itertools
import random

import numpy as np
import pytest

from lakeqa.llm import html_text as H

ARTICLE = "<article><h1>Title</h1><p>First <b>bold</b> para&shy;graph, with A &amp; B.<br><p>Second  one.</article>"
LONG = "This is a plain paragraph that goes on for quite a while, says things, and ends."

CASES = [
    (None, ""),
    ("", ""),
    ("   ", ""),
    (f"<body><nav><a href=/>Home</a></nav>{ARTICLE}<footer>&copy; us</footer>", "Title\n\nFirst bold para\xadgraph, with A & B.\n\nSecond one."),
    (f"<title>No</title><script>var x = '<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> -->{ARTICLE}", "Title\n\nFirst bold para\xadgraph, with A & B.\n\nSecond one."),
    (f"<article><p>{LONG}</p><div class='comments'><p>{LONG}</p></div><form>Name <input></form></article>", LONG),
    (f"<div class=cookie-notice>{LONG}</div><div id='sidebar'>{LONG}</div><main><p>{LONG}</main><aside>{LONG}</aside>", LONG),
    (f"<article><header><h1>Head</h1></header><p>{LONG}</article><header>Site</header>", f"Head\n\n{LONG}"),
    (f"<article><ul><li>{LONG}<li>{LONG}</ul><table><tr><td>{LONG}<td>x y</table></article>", f"{LONG}\n\n{LONG}\n\n{LONG}\n\nx y"),
    (f"<div><a href=a>One</a> <a href=b>Two</a></div><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
    ("<article><p>a<wbr>b<i>c</i> d<br>e</p></article>", "abc d e"),
    ("<article><p title='a > b'>x &lt;p&gt; &#228;&amp</p></article>", "x <p> ä&"),
    ("<article><p>open <b>tags <i>everywhere", "open tags everywhere"),
    ("<article><p hidden>gone</p><p>kept here.</p></article>", "kept here."),
    ("<script>never closed <p>text", ""),
    ("<article><p>5 < 6 and 7 > 3.</p></article>", "5 < 6 and 7 > 3."),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_pages(html, text):
    assert H.main_text(html, H.PRIOR) == text


WRAPPED = f"<div class='entry-content'><p>{LONG}</p><p>{LONG}</p></div>"
SITE = "<footer>All rights reserved here, and more of that.</footer>"


@pytest.mark.parametrize(
    "start",
    [
        "<body class='single right-sidebar'>", "<html class='search'><body id=hidden>", "<div class='no-sidebar'>", "<div class='overflow-hidden'>",
        "<div class='layout right-sidebar'>", "<div class='searchForm page'>", "<form id=aspnetForm>", "<div class='related'>", "<div class=share>", "<div class='sidebar'>",
    ],
)
def test_layout_names_do_not_lose_the_article(start):
    end = "</form>" if start[1] == "f" else "</div>" if start[1] == "d" else ""
    assert H.main_text(f"{start}{WRAPPED}{end}{SITE}", H.PRIOR) == f"{LONG}\n\n{LONG}"
    assert H.main_text(f"{start}<div><p>{LONG}</p><p>{LONG}</p></div>{end}{SITE}", H.PRIOR) == f"{LONG}\n\n{LONG}"


def test_named_boilerplate_stays_out():
    for name in ("comments", "right-sidebar", "related-posts", "visually-hidden", "search-form"):
        more = f"<div class='{name}'>" + f"<p>{LONG}</p>" * 5 + "</div>"
        assert H.main_text(f"<body>{more}{WRAPPED}{more}</body>", H.PRIOR) == f"{LONG}\n\n{LONG}"


def test_cut_against_exhaustive_search():
    draw = random.Random(5)
    for _ in range(300):
        n = draw.randint(1, 7)
        gains = [draw.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, draw.randint(0, 6)) for a, b in itertools.combinations(range(n), 2) if draw.random() < 0.5]

        def cost(side, gains=gains, edges=edges):
            lost = sum(g for g, s in zip(gains, side, strict=True) if g > 0 and not s)
            lost -= sum(g for g, s in zip(gains, side, strict=True) if g < 0 and s)
            return lost + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(cost(side) for side in itertools.product([False, True], repeat=n))
        assert cost(H.min_cut(gains, edges)) == best


def test_learned_weights_on_whole_table(spark):
    pages = [(i, f"<nav><a href=/>Home {i}</a></nav><article><h1>T {i}</h1><p>{LONG}</p></article><footer>(c) {i}</footer>", 3) for i in range(60)]
    pages += [(60, None, 3), (60, "", 3), (61, f"<article>{'<p>' + LONG + '</p>' : >9}" * 1500, 3)]
    rows = spark.createDataFrame(pages, "page_id long, html string, text int")
    weights = H.learn(rows.select("html"))
    got = {r["page_id"]: r["text"] for r in H.extract(rows, weights).collect()}
    assert all(got[i] == f"T {i}\n\n{LONG}" for i in range(60))
    assert got[60] == "" and got[61].count(LONG) == 1500


def test_empty_table(spark):
    rows = spark.createDataFrame([], "page_id long, html string")
    weights = H.learn(rows.select("html"))
    assert np.array_equal(weights, H.PRIOR) and H.extract(rows, weights).collect() == []
