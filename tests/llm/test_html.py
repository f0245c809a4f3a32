"""Main text of pages: what is known of made-up pages and of the test tables."""

import html
import re
import time

import numpy as np
import pytest

from tessera.llm import html_extract
from tessera.llm.boosting import grow
from tessera.llm.dom import Features, Page, decide


@pytest.fixture(scope="module")
def forest():
    return html_extract.model()


def text_of(forest, page):
    p = Page(page)
    f = Features(p)
    return html_extract.extract_text(p, f, html_extract.margins_of([f], forest)[0])


def test_pages_of_the_tables(spark, forest):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages, forest).collect()}
    right = 0
    for r in pages.collect():
        body = re.search("<article>(.*)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", body)]
        want = "\n\n".join(b for b in blocks if b)
        right += got[r.page_id].text == want
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert right == len(got)


def test_held_out_made_up_pages(forest):
    right = 0
    for seed in range(10_000, 10_150):
        page = html_extract.Maker(seed).page()
        p = Page(page)
        part = ["drop"] * len(p.tag)
        for i in range(1, len(p.tag)):
            part[i] = p.part[i] or part[p.parent[i]]
        right += text_of(forest, page) == "\n\n".join(" ".join(w) for w, k in zip(p.words, part, strict=True) if w and k == "keep")
    assert right >= 0.85 * 150


def test_edge_pages(spark, forest):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "<script>x</script><!-- a"), (5, "u", "<div>" * 5000), (6, "u", "a < b <"), (7, "u", "<a " * 3000), (None, "u", "<p>x"), (9, "u", "<table><tr><td>a<td>b</table>")]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = html_extract.extract(df, forest).collect()
    assert len(got) == len(rows) + 1 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2, 3, 4)} == {""}
    assert html_extract.extract(df.where("false"), forest).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<p>kept</p><img " + 'a="b" ' * 200_000,
        "<p>kept</p><img " + "a=' b=\" " * 100_000,
        "<p>kept</p>" + "<a " * 300_000,
        "<p>kept</p>" + '<a "' * 300_000,
        "<p>kept</p>" + "<svg>" * 200_000,
        "<p>kept</p>" + "<!--" * 300_000,
        "<p>kept</p>" + "</a " * 300_000 + "'",
        '<p>kept</p><img alt="' + "x" * 500_000,
        "<p>kept</p>" + "<p>" * 50_000 + '<div class="' * 3,
    ],
)
def test_hostile_and_cut_off_pages_take_linear_time(page):
    begin = time.perf_counter()
    read = Page(page)
    assert time.perf_counter() - begin < 5 and read.words[next(i for i, w in enumerate(read.words) if w)] == ["kept"]


def test_quotes_in_tags():
    for page, want in (("""<p title="a>b">x</p>""", "x"), ("""<p title='a"b'>x</p>""", "x"), ("""<p title=it's>x</p>""", "x"), ("""<p a="b>x</p>""", "x"), ("<p>x<b a=1", "x"), ("<P>x</P  >y", "x y"), ("<SCRIPT>a</scRipt>x", "x")):
        assert " ".join(w for words in Page(page).words for w in words) == want, page


def test_matrices_of_large_and_small_pages_are_the_same(forest):
    made = [Features(Page(html_extract.Maker(seed).page())) for seed in range(5)] + [Features(Page("<div><p>some text." * 9000))]
    together = html_extract.margins_of(made, forest)
    assert all(np.allclose(m, forest.margins(f.rows(0, f.n))) for f, m in zip(made, together, strict=True))


#: Pages written by hand: what is kept, by its marks, and the page.
BY_HAND = [
    ("k1 k2 k3", "<body><nav><a href=/>d</a> <a href=/b>d</a></nav><article><h1>k1 A title of a text</h1><p>k2 One sentence that is long enough to be read, and another one behind it.</p><p>k3 More of the same, with a <a href=x>link</a> in it and some words after it.</p></article><footer>d all rights reserved</footer></body>"),
    ("k1 k2 k3 k4", "<main><h1>k1 Things to read</h1><p>k2 Some of the best texts of the year are in this short list, as we think.</p><ul><li><a href=a>k3 The first one</a></li><li><a href=b>k4 The second one</a></li></ul></main><footer><a href=c>d Contact</a></footer>"),
    ("k1 k2", "<div id=header><a href=/>d Home</a></div><div id=content><h2>k1 On the river</h2><p>k2 The river carries stones and light, and the house stands by it, as it did before.</p></div><div id=sidebar><h3>d Popular</h3><ul><li><a href=1>d one</a><li><a href=2>d two</a></ul></div><div id=comments><p>d I liked it.</p></div>"),
    ("k1 k2", "<header><h1>d Site of sites</h1></header><article><p>k1 A text without a title, but with a sentence or two that tell what happened there.</p><div class=ad>d Buy now</div><p>k2 And it goes on behind the advert, with as many words as it had before it.</p></article><section class=comments><h3>d Comments</h3><article><p>d First!</p></article></section>"),
    ("k1 k2 k3", "<body><div class=cookie-notice>d We use cookies <button>d OK</button></div><article><h1>k1 Title</h1><blockquote>k2 What was said there, was said by someone who was there.</blockquote><pre>k3 x = 1; y = 2</pre></article><form><label>d Search</label><input></form></body>"),
]


@pytest.mark.parametrize(("keep", "page"), BY_HAND)
def test_pages_written_by_hand(forest, keep, page):
    text = text_of(forest, page)
    assert re.findall(r"\bk\d\b", text) == keep.split() and not re.search(r"\bd\b", text)


def test_deep_pages_keep_their_tree():
    page = Page("<div>" * 1000 + "<p>x" + "</div>" * 999 + "<p>y</div><p>z")
    up = {w[0]: i for i, w in enumerate(page.words) if w}
    assert page.tag.count("div") == 1000 and [up_depth(page, up[w]) for w in "xyz"] == [1002, 3, 2]


def up_depth(page, i):
    n = 0
    while i:
        i, n = page.parent[i], n + 1
    return n


def test_stored_trees_are_the_fitted_ones():
    assert html_extract.fitted().dump() == html_extract.STORED.read_text()


def test_nothing_below_a_dropped_node_is_kept():
    rng = np.random.default_rng(1)
    for _ in range(50):
        parent = np.array([-1] + [rng.integers(0, i) for i in range(1, 30)])
        margins, chars = rng.normal(size=30), rng.integers(1, 100, 30)
        kept = decide(margins, parent, chars)
        assert all(kept[parent[i]] for i in range(1, 30) if kept[i])


def test_decoding_is_the_best_choice():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(20):
        parent = np.array([-1] + [rng.integers(0, i) for i in range(1, 8)])
        margins, chars = rng.normal(size=8), rng.integers(1, 100, 8)
        value = margins.clip(-4, 4) * np.sqrt(chars.clip(1, 400))
        score = lambda k: sum(v if x else -v for v, x in zip(value, k, strict=True))  # noqa: E731,B023
        valid = [k for k in itertools.product((False, True), repeat=8) if k[0] and all(k[parent[i]] for i in range(1, 8) if k[i])]
        assert np.isclose(score(decide(margins, parent, chars)), max(map(score, valid)))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((grow(x, y).margins(x) > 0) == y).mean() > 0.97
