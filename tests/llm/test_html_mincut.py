import html
import itertools
import random
import re
import time

import pytest

from trajspark.llm import html_mincut, registry

WRAP = "<html><head><title>t</title><style>p{{}}</style></head><body>{}</body></html>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  words &amp; so\n on.", "plain words & so on."),
        (WRAP.format("<nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>T&eacute;</h1><p>One<b> two<br>three<p>Of.</article><footer>&copy; x</footer>"), "Té\nOne two three\nOf."),
        (WRAP.format("<header><h1>Site</h1></header><main><header><h2>Title</h2></header><p>Body text.</p><aside>see also</aside><form><label>mail</label><input><p>join</p></form></main>"), "Title\nBody text."),
        (WRAP.format("<div class='cookie-notice'><p>We use cookies.</p></div><div id=content><p>Real text.<div class='ad slot'>Buy!</div><ul><li>a<li>b</ul></div><section id='comments'><article><p>Nice post!</p></article></section>"), "Real text.\na\nb"),
        (WRAP.format("<form action='/all'><article><p>In a form's page.</p></article></form>"), "In a form's page."),
        (WRAP.format("<article><script>var t='</p><p>no</p>';</script><!-- <p>no</p> --><p title='a > b'>a &lt; b &#x263A; &am &amp</p><table><tr><td>x<td>y</table></article>"), "a < b ☺ &am &\nx\ny"),
        (WRAP.format("<p>A first paragraph of a page that has no landmarks at all, long enough to be read.</p><p>Short one.</p><p>And a last one with more words than the others have, so it's content.</p><div><a href=x>Link</a> <a href=y>Other link</a></div>"), "A first paragraph of a page that has no landmarks at all, long enough to be read.\nShort one.\nAnd a last one with more words than the others have, so it's content."),
        (WRAP.format('<div class="layout with-sidebar"><article><p>Whole article.</p></article><div class="sidebar"><p>Aside.</p></div></div>'), "Whole article."),
        (WRAP.format('<div class="page-header-wrapper"><article><p>Whole article.</p></article></div><div class="comments"><article><p>Nice.</p></article></div>'), "Whole article."),
        (WRAP.format("<article><p data-x=it's>Body para one.</p><p class='social-history'>Of a movement.</p><h2 class=\"story-header\">Part two</h2><p class=ad>Buy</p></article>"), "Body para one.\nOf a movement.\nPart two"),
        (WRAP.format("<p>An introduction of this page without any landmark.</p><ul><li>Milk</li><li>Bread</li></ul><table><tr><td>x</td><td>12</td></tr></table><ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul>"), "An introduction of this page without any landmark.\nMilk\nBread\nx\n12"),
        (WRAP.format("<article><p>If a <b and c</p> then <3 </ > <p>More.<button>Click<p>Rest</article>"), "If a then <3\nMore.Click\nRest"),
    ],
)
def test_pages(page, text):
    assert html_mincut.main_text(page) == text


def test_min_cut_is_minimal():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randrange(1, 9)
        source = [rng.choice([0, 1, -1]) * rng.randrange(1, 9) for _ in range(n)]
        edges = [(a, b, rng.randrange(1, 5)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]

        def cost(side):
            return sum(abs(c) for c, s in zip(source, side, strict=True) if (c > 0) != s and c) + sum(w for a, b, w in edges if side[a] != side[b])

        assert cost(html_mincut.min_cut(source, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_long_page():
    page = "<article>" + "".join(f"<p>paragraph {i} <b>bold" for i in range(4000)) + "</article>"
    assert html_mincut.main_text(page).count("\n") == 3999


@pytest.mark.parametrize("unit", ['<a "', "<a b='", "<p x=\"", "<!--", "<b <", "<script ", "<button>", "< ", "</", "<svg><a>"])
def test_broken_markup_in_linear_time(unit):
    began = time.process_time()
    html_mincut.main_text(f"<article><p>text</p>{unit * 60_000}")
    assert time.process_time() - began < 5


def test_query(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = registry.QUERIES["op1_html_mincut"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:h1|p)>", inside)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(1, "<p>Hi there.</p>", "old"), (None, None, None)], "page_id long, html string, text string")
    got = html_mincut.extract(df)
    assert got.columns == ["page_id", "html", "text"] and [r.text for r in got.orderBy("page_id").collect()] == ["", "Hi there."]
    assert html_mincut.extract(df.limit(0)).count() == 0


def test_unmatched_end_tags_take_linear_time():
    import time

    def took(n):
        began = time.process_time()
        assert html_mincut.main_text("<b>" * n + "</i>" * n + "<p>text</p>") == "text"
        return time.process_time() - began

    took(1_000)
    assert took(64_000) < 20 * took(8_000) + 1  # 64 times, if it were quadratic
