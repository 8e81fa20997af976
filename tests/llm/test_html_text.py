import collections
import html
import re

import pytest

from roomwright.llm.html_text import classify, extract_text, main_text, read_blocks
from roomwright.llm.registry import QUERIES

LONG = "It was the best of times and it was the worst of times, and there was a man who said that he had been to the city by the sea with all of his friends."
FAR = "Kissa istui matolla ja katseli lintuja ikkunasta, kunnes ilta tuli ja kaikki talossa nukahtivat; silloin se nousi hitaasti ja venytteli pitkään hiljaa."
CASES = [
    (None, ""), ("", ""), ("plain words", ""), (LONG, LONG),
    (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{LONG}<p>Short.</article><footer>Imprint</footer>", f"T & U\n\n{LONG}\n\nShort."),
    (f"<main><p>{LONG}</p><div class='comments'><p>{LONG}</p></div><aside>{LONG}</aside></main>", LONG),
    (f"<div class='site-header'>Site name</div><div id='sidebar'>{LONG}</div><div><h2>Head</h2><p>{LONG}</p><p>Tail.</p></div><div class='cookie-notice'>{LONG}</div>", f"Head\n\n{LONG}\n\nTail."),
    (f"<body class='no-sidebar'><form action=/><input name=q><button>Go</button></form><p>a&nbsp;b <b>c</b><br>d</p><p>{LONG}</p>", f"a b c d\n\n{LONG}"),
    (f"<script>var x='</p><p>{LONG}</p>';</script><style>p{{}}</style><p>{LONG}</p><!-- <p>{LONG}</p> -->", LONG),
    (f"<article><header><h1>Title</h1></header><p>{LONG}</p><ul><li>one<li>two</ul><div class=share><a href=x>Share</a></div></article>", f"Title\n\n{LONG}\n\none\n\ntwo"),
    (f"<div class=ad><p>buy<article><p>{LONG}</p></article>", LONG),
    (f"<p>{LONG}</p><script>never closed <p>{LONG}</p>", LONG),
    (f'<p title="a > b">{LONG}</p><p hidden>{LONG}</p><p style="display:none">{LONG}</p>', LONG),
    (f"<p>{LONG}</p><p><a href=1>{LONG}</a></p><div role=contentinfo>{LONG}</div>", LONG),
    (f"<div class=menu>Menu</div><h2>Otsikko</h2><p>{FAR}</p><p>Loppu.</p>", f"Otsikko\n\n{FAR}\n\nLoppu."),
    ("<table><tr><td>" + LONG + "<td>x<tr><td>y</table>", f"{LONG}\n\nx\n\ny"),
    (f"<p>1 &lt; 2 &#233; &#x1F642; &unknown; {LONG}</p>", f"1 < 2 é \U0001f642 &unknown; {LONG}"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_pages(page, want):
    assert main_text(page) == want


def test_second_pass_takes_the_nearest_label():
    link = f"<p><a href=1>{LONG}</a></p>"
    blocks = read_blocks(f"{link}<p>x</p><p>{LONG}</p><p>y</p><p>{LONG}</p>{link}<p>z</p>{link}")
    assert [(b.text[:2], g) for b, g in zip(blocks, classify(blocks))] == [("It", False), ("x", False), ("It", True), ("y", True), ("It", True), ("It", False), ("z", False), ("It", False)]


def test_long_and_broken_pages():
    assert main_text("<p>" * 20_000 + LONG) == LONG
    assert main_text("<b>" * 20_000 + LONG + "</i>" * 20_000) == LONG
    assert main_text(("<p>" + LONG + "</p>") * 5_000).count(LONG) == 5_000
    main_text("<a href='" * 3_000)
    main_text("<" * 50_000)
    main_text("<!--" * 20_000)


def test_rows(spark):
    rows = [(k, p, "u", "t") for k, (p, _) in enumerate(CASES)] + [(None, CASES[3][0], None, None), (3, CASES[3][0], "u", "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    got = extract_text(pages, carry=("url",)).collect()
    assert sorted((str(r.page_id), r.url or "", r.text, r.n_chars) for r in got) == sorted((str(i), u or "", main_text(p), len(main_text(p))) for i, p, u, _ in rows)
    assert extract_text(pages.limit(0)).count() == 0


def test_query(spark):
    """The pages' only article elements, cut out by hand, are what the rules keep."""
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in QUERIES["op5_html_text"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split("</?(?:p|h1)>", article)
        want = [" ".join(html.unescape(re.sub("<[^>]+>", " ", p)).split()) for p in parts]
        assert got[r.page_id].text == "\n\n".join(w for w in want if w)
        assert (got[r.page_id].url, got[r.page_id].n_chars) == (r.url, len(got[r.page_id].text))


LINKED = "<p><a href=1>{0}</a> <a href=2>{0}</a></p>".format("One more page of this site that you may like to read")


def test_rules_decide_inside_articles_too():
    page = f"<article><p>{LONG}</p><p>near the good one</p>{LINKED}<p>near the links</p>{LINKED}</article>"
    assert main_text(page) == f"{LONG}\n\nnear the good one"
    assert main_text("<main><p>No block here is decided.</p></main>") == "No block here is decided."


PLAIN = f"<div>Home</div>{LINKED}<div>Small print</div><div><h2>A head</h2><p>{LONG}</p><p>{FAR}</p><p>A tail.</p></div><div>Other</div>{LINKED}"


def test_stop_words_and_bars_decide_on_plain_pages(monkeypatch):
    """Neither article nor classes: density, length and links alone."""
    from roomwright.llm import html_text as rules

    want = f"A head\n\n{LONG}\n\nA tail."
    assert main_text(PLAIN.replace(f"<p>{FAR}</p>", "")) == want
    assert FAR not in main_text(PLAIN)  # hardly any stop words next to a dense block
    assert FAR in main_text(PLAIN, frozenset())
    monkeypatch.setattr(rules, "LINKS", 2.0)
    assert "of this site" in main_text(PLAIN)
    monkeypatch.setattr(rules, "LINKS", 0.5)
    monkeypatch.setattr(rules, "LONG", 10**9)
    monkeypatch.setattr(rules, "MEDIUM", 10**9)
    assert main_text(PLAIN) == ""


def test_medium_paragraphs_without_stop_words_stay():
    short = [FAR[:100], FAR[20:130]]
    assert main_text("".join(f"<p>{p}</p>" for p in short) + LINKED) == "\n\n".join(s.strip() for s in short)


@pytest.mark.parametrize("page,want", [
    (f"<article><p title=it's>{LONG}</p><p>It's the end.</p></article>", f"{LONG}\n\nIt's the end."),
    (f"<p>{LONG}</p><p title='never closed>{LONG}</p><p>{FAR}", f"{LONG}\n\n{LONG}"),
    (f"<article><svg><path d='M0'><p>{LONG}</p></article>", LONG),
    (f"<article><svg><svg><title>x</title></svg><text>y</text></svg><p>{LONG}</p></article>", LONG),
    (f"<article><object data=x><p>{LONG}</p></object><p>so <math><mi>x</mi></math> is</p></article>", f"{LONG}\n\nso x is"),
    (f"<article><noscript>x<p>{LONG}</p></article>", f"x\n\n{LONG}"),
    (f"<article><iframe src=x>y</iframe><template><p>z</p></template><p a=\"1>2\" b='3>4'>{LONG}</p></article>", LONG),
    (f"<p \"odd>{LONG}</p>", LONG),
])
def test_malformed_pages_lose_no_text(page, want):
    assert main_text(page) == want


def test_articles_are_found_without_their_element():
    """The pages of sf0.1 without the article tags: only density, length, links and neighbours are left inside the body."""
    import pyarrow.parquet as pq

    same, hits, kept, wanted = 0, 0, 0, 0
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"]).column("html").to_pylist()
    for page in pages:
        want = main_text(page).split("\n\n")
        got = [b for b in main_text(re.sub("</?article>", "", page)).split("\n\n") if b]
        same += got == want
        common = sum((collections.Counter(got) & collections.Counter(want)).values())
        hits, kept, wanted = hits + common, kept + len(got), wanted + len(want)
    print("equal pages", same / len(pages), "recall", hits / wanted, "precision", hits / kept)
    assert same / len(pages) > 0.94 and hits / wanted > 0.97 and hits / kept > 0.99
