"""Main text of pages: parsing, training, decoding, held-out pages of other shapes."""

import html as H
import itertools
import re

import numpy as np
import pytest

from ludex.llm import extraction as E
from ludex.llm.boosting import Boosted
from ludex.llm.dom import MARK, Page, blocks
from ludex.llm.training_pages import Grammar


@pytest.fixture(scope="module")
def given(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()
    return [(r.page_id, r.html) for r in rows]


@pytest.fixture(scope="module")
def model(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    return E.fit(pages)


def _plain(html):
    """The article element's blocks, by its own tags."""
    article = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
    parts = (" ".join(H.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n\n".join(p for p in parts if p)


def test_given_pages(spark, given, model):
    """Every page of a table that the model wasn't trained on gives its article, whole."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in E.extract(pages, model).collect()}
    assert got == {i: (_plain(h), len(_plain(h))) for i, h in given}


PAGES = {
    "blog": ("""<html><body class="home"><div id="wrap"><div class="site-header"><a href="/">My Blog</a><p>Just another site</p></div>
<div class="menu-top"><ul class="menu"><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></div>
<div id="content"><div class="post hentry"><h2 class="entry-title">A walk in the woods</h2><div class="entry-content">
<p>Yesterday we went to the woods, and it was a long day. We saw three deer.</p><p>Short one.</p>
<div class="sharedaddy share"><a href="#">Tweet</a><a href="#">Mail</a></div>
<p>The last paragraph follows after the buttons, with a <a href="/x">link</a> in it.</p></div></div>
<div id="comments"><h3>2 comments</h3><ol class="commentlist"><li class="comment"><p>Nice walk, thanks for the report and all the pictures.</p></li></ol>
<form id="respond"><textarea>x</textarea><input type=submit></form></div></div>
<div id="sidebar"><h3>Archives</h3><ul><li><a href="/1">May</a></li></ul><p>About the author, a friendly person who walks.</p></div>
<div id="footer">&copy; 2020 My Blog. All rights reserved.</div></div></body></html>""",
             "A walk in the woods\n\nYesterday we went to the woods, and it was a long day. We saw three deer.\n\nShort one.\n\n"
             "The last paragraph follows after the buttons, with a link in it."),
    "news": ("""<body><header class="masthead"><h1>The Daily</h1><nav><a href=/w>World</a> <a href=/s>Sport</a></nav></header>
<div class="cookie-banner"><p>We use cookies to improve your visit. By going on you agree to that.</p><button>OK</button></div>
<main><article><header><h1>Rain falls on town</h1></header><p>It rained all day on the town, the mayor said on Monday.</p>
<aside class="related"><h4>Read more</h4><ul><li><a href=/1>Snow falls too, and then some more</a></li></ul></aside>
<p>People stayed at home. Some went out.</p><div class="ad-slot">Buy umbrellas now, cheap and good ones!</div><p>The end.</p><footer>By A. Writer</footer></article>
<section class="reader-comments"><p>First!</p><p>It did not rain where I live.</p></section></main><footer>(c) The Daily <a href=/t>Terms</a></footer></body>""",
             "Rain falls on town\n\nIt rained all day on the town, the mayor said on Monday.\n\nPeople stayed at home. Some went out.\n\nThe end."),
    "nameless": ("""<html><body><nav><a href=/>x</a></nav><div><div><div><p>Deeply nested text that should be the article, as there is a lot of it.</p>
<p>More of it here, with commas, and full stops. Again.</p></div></div></div><footer>f</footer></body></html>""",
                 "Deeply nested text that should be the article, as there is a lot of it.\n\nMore of it here, with commas, and full stops. Again."),
    "plain": ("Just plain text without any markup at all. It has two sentences.", "Just plain text without any markup at all. It has two sentences."),
    "blocks": ("<p>One paragraph alone.</p><p>And another one.</p>", "One paragraph alone.\n\nAnd another one."),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_other_shapes(model, name):
    import pickle

    html, want = PAGES[name]
    assert E.main_texts(pickle.loads(model), [html]) == [want]


def test_held_out_drawn_pages(model):
    import pickle

    g, right = Grammar([], 4711), 0
    for _ in range(300):
        html = g.page()
        page = Page(html)
        want = blocks(page.runs, E._drawn_labels(page) == E.ARTICLE)
        right += E.main_texts(pickle.loads(model), [re.sub(rf' {MARK}="\w"', "", html)])[0] == want
    assert right >= 285


def test_nulls_empty_repeats_long_and_clashing_columns(spark, model):
    long = "<article><p>" + "word " * 200_000 + "</p></article><footer>x</footer>"
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>A text of some words.</p>"), (None, None, "<p>A text of some words.</p>"),
            (5, "v", long), (6, "v", "<p>cut <b>of"), (7, "v", "<div" * 500), (8, "v", "<div>" * 3000 + "deep"), (9, "v", "&lt;p&gt; &amp;am &nbsp; x \n\t y")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = E.extract(df, model).collect()
    got = [(r.page_id, r.text) for r in out]
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert [t for i, t in got if i == 1] == ["", ""]
    assert [t for i, t in got if i is None] == ["A text of some words."] * 2
    assert dict(got)[5] == ("word " * 200_000).strip()
    assert dict(got)[9] == "<p> &am x y"
    assert E.extract(df.where("false"), model).count() == 0


def test_training_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "html string")
    import pickle

    small = pickle.loads(E.fit(empty, drawn=60))
    assert E.main_texts(small, []) == [] and isinstance(E.main_texts(small, ["<p>x</p>"])[0], str)


def test_decoding_is_the_best_consistent_labelling():
    r = np.random.default_rng(5)
    for _ in range(40):
        n = int(r.integers(1, 7))
        parent = np.array([-1] + [int(r.integers(0, i)) for i in range(1, n)])
        log_p = np.log(r.dirichlet([1, 1, 1], n))
        fits = lambda ls: all(parent[i] < 0 or ls[i] >= ls[parent[i]] for i in range(n))
        best = max((ls for ls in itertools.product(range(3), repeat=n) if fits(ls)), key=lambda ls: sum(log_p[i, x] for i, x in enumerate(ls)))
        assert tuple(E.decode(log_p, parent)) == best


def test_boosting_separates_and_gives_probabilities():
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    trees = Boosted(rounds=40).fit(x[:1000], y[:1000], 3)
    log_p = trees.log_proba(x[1000:])
    assert np.allclose(np.exp(log_p).sum(axis=1), 1)
    assert (log_p.argmax(axis=1) == y[1000:]).mean() > 0.9


def test_parsing():
    page = Page("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><p>e<div>f</div><p>g<script>var x='<p>no</p>'</script><!-- no --><br>h &copy; i")
    assert blocks(page.runs, [True] * len(page.tag)) == "a\n\nb\n\nc\n\nd\n\ne\n\nf\n\ng h © i"
