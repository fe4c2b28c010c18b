"""HTML extraction: cuts against all labellings, known pages, and the articles of the given pages."""

import html
import itertools
import random
import re

import pytest

from pairloom.llm import extraction as E


def cost(ties, edges, sides):
    total = sum(t for t, keep in zip(ties, sides) if t > 0 and not keep) - sum(t for t, keep in zip(ties, sides) if t < 0 and keep)
    return total + sum(w for u, v, w in edges if sides[u] != sides[v])


def test_cut_is_least_of_all_labellings():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(0, 9)
        ties = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 6)) for i in range(n) for j in range(i) if rng.random() < 0.4]
        best = min(cost(ties, edges, s) for s in itertools.product([False, True], repeat=n))
        sides = E.min_cut(ties, edges)
        assert cost(ties, edges, sides) == best
        most = max(sum(s) for s in itertools.product([False, True], repeat=n) if cost(ties, edges, s) == best)
        assert sum(sides) == most


NONE = E.Evidence(())

PAGES = [
    (
        "<html><head><title>A day | Site</title><script>var a='<p>no</p>'</script></head><body class='home with-sidebar'><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>"
        "<div class=cookie-notice>We use cookies <button>OK</button></div><main><article><header><h1>A  day</h1><p class=byline>By Ann</header><p>One &amp; two<br>three.<p>Of."
        "<div class='ad'>Buy &lt;now&gt;</div><p>x<b>y</b>z &#233;&nbsp;q<aside>Related: <a href=1>more</a></aside><ul><li>first</li><li>second</li></ul>"
        "<form><label>Mail</label><input><p>Sign up</p></form></article><section id=comments><article><p>I liked this long text, it said a lot of good things.</p></article></section></main>"
        "<footer>&copy; 2020</footer><script>",
        "A day\nBy Ann\nOne & two three.\nOf.\nxyz é q\nfirst\nsecond",
    ),
    (
        "<body><div id=top-menu><a href=1>a</a> <a href=2>b</a></div><div class='post-content'><h2>Title</h2><div>Some text, long enough to be read by people.</div><div>More.</div>"
        "<div class='share'>Tweet</div></div><div class=sidebar><p>Popular things here, sentence by sentence.</p></div><div class='post-comments'><div class=comment-body>Nice article!</div></div></body>",
        "Title\nSome text, long enough to be read by people.\nMore.",
    ),
    ("<nav>x</nav><footer>y</footer>", ""),
    ("<form id=aspnet><div class=menu>m</div><main><p>Kept text.</p></main></form>", "Kept text."),
    ("<article><!-- a <p>hidden</p> --><p hidden>no</p><p style='display:none'>no</p><p>a < b and c > d</p><p it's>ok</p><textarea>t</textarea><noscript>n</noscript></article>", "a < b and c > d\nok"),
    ("<article><p>one</p></div></p><p>two<table><tr><td>c1<td>c2</table></article><!-- open", "one\ntwo\nc1\nc2"),
]


@pytest.mark.parametrize(("page", "expected"), PAGES)
def test_known_pages(page, expected):
    assert E.main_text(page, NONE) == expected


def article(page):
    """The given pages hold one article of headings and paragraphs."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"</?(b|br)>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_articles_of_the_given_pages(spark, folder):
    expected = {r.page_id: article(r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = E.op12(spark, folder).collect()
    assert {r.page_id: r.text for r in rows} == expected
    assert all(r.n_chars == len(r.text) for r in rows)


def test_text_alone_tells_content_from_boilerplate(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    evidence = E.fit_evidence(pages)
    prose = "A rather long sentence of plain prose, which goes on for a while and then ends. " * 3
    page = f"<div><div><a href=1>Home</a></div><div><a href=2>News</a></div></div><div><div>{prose}</div><div>{prose}</div><div>Short.</div><div>{prose}</div></div><div><div><a href=3>Terms</a></div><div><a href=4>Help</a></div></div>"
    assert E.main_text(page, evidence).split("\n") == [prose.strip(), prose.strip(), "Short.", prose.strip()]


def test_defined_cases(spark):
    deep = "<div>" * 3000 + "<article><p>deep</p>" + "</div>" * 3000
    long = "<article>" + "<p>word word</p>" * 20000 + "</article><nav>" + "<a href=1>l</a><p>" * 2000
    rows = [(1, "u", None, 0), (2, "u", "", 0), (None, None, PAGES[0][0], 0), (4, "u", PAGES[0][0], 0), (4, "u", PAGES[0][0], 0), (5, "u", deep, 0), (6, "u", long, 0), (7, "u", "<", 0), (8, "u", "<a \"=\"" * 5000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = E.extract_text(pages, NONE).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and texts[1] == texts[2] == "" and texts[None] == texts[4] == PAGES[0][1]
    assert texts[5] == "deep" and texts[6] == "\n".join(["word word"] * 20000)
    assert E.extract_text(pages.limit(0)).count() == 0
    assert E.fit_evidence(pages.limit(0)) == NONE
