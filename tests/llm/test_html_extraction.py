import itertools
import random

import numpy as np
import pytest

from tidemark.llm import dom_blocks, html_extraction
from tidemark.llm.html_extraction import Crf


@pytest.fixture(scope="module")
def model():
    return html_extraction.default_model()


def test_blocks_of_broken_markup():
    page = "<p>a<b>b <br>c<p>d&amp;e&nbsp; f<script>if (a<b) x('<p>')</script><ul><li>x<li>y</ul><!-- <p>no -->z<style>q</style><div class='A-b' id=c>t</div> 1 < 2<p cl"
    assert [b.text for b in dom_blocks.blocks(page)] == ["ab c", "d&e f", "x", "y", "z", "t", "1 < 2"]
    assert dom_blocks.blocks(page)[5].path[-1] == ("div", ("a", "b", "c"))
    assert dom_blocks.blocks("") == [] and dom_blocks.blocks("<script>never closed") == []
    assert [b.linked for b in dom_blocks.blocks("<p>x <a href=1>abc</a></p>")] == [3]


def test_viterbi_is_the_best_path(model):
    rng = np.random.default_rng(0)
    for n in range(1, 7):
        page = [dom_blocks.Block("x" * (k + 1), (("p", ()),), 0, "") for k in range(n)]
        score = rng.normal(size=n)
        crf = Crf({}, rng.normal(size=(2, 2)), 0.3)
        crf.emission = lambda block, place, count, s=score: s[place]
        total = lambda y: sum(score[k] for k in range(n) if y[k]) + 0.3 * y[0] + sum(crf.move[a, b] for a, b in itertools.pairwise(y))
        assert total(crf.decode(page)) == pytest.approx(max(map(total, itertools.product((0, 1), repeat=n))))


def test_held_out_pages(model):
    rng = random.Random(4242)
    right = count = 0
    for _ in range(200):
        page = dom_blocks.blocks(dom_blocks.sample_page(rng))
        right += sum(str(y) == b.label or (y == 0 and not b.label) for y, b in zip(model.decode(page), page, strict=True))
        count += len(page)
    assert right / count > 0.97


def test_whole_table(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = {r["page_id"]: r for r in pages.collect()}
    for r in html_extraction.extract(pages, model).collect():
        inner = rows[r["page_id"]]["html"].partition("<article>")[2].partition("</article>")[0]
        assert r["text"] == "\n".join(b.text for b in dom_blocks.blocks(inner))
        assert r["n_chars"] == len(r["text"]) and r["url"] == rows[r["page_id"]]["url"]


def test_boilerplate_of_every_kind(spark, model):
    page = """<html><body><header><p>Site</p></header><div class="cookie-notice"><p>We use cookies on this site.</p></div>
    <aside class="sidebar"><h3>Related</h3><p>Another story that is long enough to look like text.</p></aside>
    <article><h1>Title</h1><p>First  &lt;real&gt; text.</p><div class="ad">Buy now, cheap things.</div><p>Second.</p>
    <form><label>Mail</label><button>Go</button></form></article>
    <section class="comments"><h2>Comments</h2><p>I think this is very good.</p></section><footer>(c)</footer></body></html>"""
    schema = "page_id long, url string, html string, text string, n_chars int"
    got = html_extraction.extract(spark.createDataFrame([(1, "u", page, "x", 1), (2, None, None, "y", 2), (3, "u", "", "z", 3), (3, "u", "", "z", 3)], schema), model).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == [(1, "Title\nFirst <real> text.\nSecond."), (2, ""), (3, ""), (3, "")]
    assert html_extraction.extract(spark.createDataFrame([], schema), model).count() == 0


def texts(page):
    return [b.text for b in dom_blocks.blocks(page)]


def test_nothing_inside_the_article_is_dropped():
    page = "<article><p>One.</p><svg/><p>Two <math><mi>x</mi></math> <object data=a>three</object></p><noscript>Four</noscript><svg><text>five</text></svg><p>Six</article>"
    assert " ".join(texts(page)) == "One. Two x three Four five Six"
    assert texts("<p>a<script>b<p></script>c<style>d</style><textarea>e</textarea><iframe>f</iframe>") == ["ac"]


def test_sample_marks_are_no_ancestors():
    page = '<body><div data-label="1"><article><p>in</p></article></div><div><p>out</p></div></body>'
    one, two = dom_blocks.blocks(page)
    assert [e for e, _ in one.path] == ["body", "article", "p"] and one.label == "1"
    assert [e for e, _ in two.path] == ["body", "div", "p"] and two.label == ""


ODD_PAGES = [
    # no article element, content in bare paragraphs between menus
    ("<body><ul class=nav><li><a href=/>Home</a><li><a href=/a>News</a></ul><h1>A title here</h1><p>The first paragraph of the text tells something at some length, as such do.</p><p>And the second one goes on with more of it, again at some length.</p><div class=footer>&copy; 2020 The site</div></body>",
     "A title here\nThe first paragraph of the text tells something at some length, as such do.\nAnd the second one goes on with more of it, again at some length."),
    # nested asides and an advert in the middle
    ("<body><header><div>Site</div></header><main><article><h1>On rivers</h1><p>Rivers carry water to the sea, and they have done so for a very long time indeed.</p><aside class=related><h3>Related</h3><ul><li><a href=/x>Other rivers of the world</a></ul></aside><div class=advert><p>Buy boots now</p></div><p>They also carry sand and stones, which settle where the water slows down.</p></article></main><footer>Imprint</footer></body>",
     "On rivers\nRivers carry water to the sea, and they have done so for a very long time indeed.\nThey also carry sand and stones, which settle where the water slows down."),
    # reader comments inside the article's section
    ("<body><section><h1>On hills</h1><p>Hills are lower than mountains, although nobody has said by how much they must be.</p></section><section class=comments><h2>Comments</h2><div class=comment><p>I like hills a lot, thank you for this text about them.</p></div></section></body>",
     "On hills\nHills are lower than mountains, although nobody has said by how much they must be."),
]


def test_odd_pages(spark):
    rows = [(i, f"u{i}", page) for i, (page, _) in enumerate(ODD_PAGES)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(ODD_PAGES))] == [want for _, want in ODD_PAGES]
