"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

A page is parsed into nodes (block elements and inline ones with a class, id or role).  Trees
boosted on node features (tag, attribute tokens, depth, siblings, text and link density of the
subtree, what the ancestors are) give each node log-probabilities of three parts: frame (what is
around the article), article, and boilerplate.  The best labelling of the whole tree is found from
the leaves up: below boilerplate all is boilerplate, below article there is article or
boilerplate, so no node contradicts its ancestors.  Text is that of the article's nodes.

The model is trained here, in one task, on pages drawn from a grammar (their words are those of
the given pages) and on a sample of at most ``SAMPLE`` given pages with exactly one article
element, whose parts are taken from their semantic elements; in half of those these elements
and names are hidden, so that shape and text decide.  Extraction covers every page.

Null, empty and text-only pages: null and empty html give the empty text; text without elements is
judged like a body's.  Truncated and misnested markup is closed as browsers do.  Each row gives
its own row, whatever its keys (nulls, repeats); an empty table gives none; columns other than
key, url and html aren't read.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame, functions as F

from .boosting import Boosted
from .dom import MARK, Page, blocks, kinds
from .training_pages import Grammar

FRAME, ARTICLE, REST = range(3)
#: Given pages in the training sample, their longest html, and pages drawn from the grammar.
SAMPLE, LONGEST, DRAWN = 200, 100_000, 700

#: Elements that features tell apart; one number a group.
_GROUPS = [("#page", "html"), ("body",), ("div", "center"), ("section",), ("article",), ("main",), ("nav",), ("header", "hgroup"), ("footer",),
           ("aside", "dialog"), ("p", "blockquote", "pre", "address"), ("figure", "figcaption"), ("h1",), ("h2", "h3", "h4", "h5", "h6"),
           ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"), ("table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"),
           ("form", "fieldset", "legend", "search")]
_GROUP = {t: i for i, ts in enumerate(_GROUPS) for t in ts}
_NEGATIVE = frozenset(("nav", "footer", "aside", "form", "dialog"))
_ARTICLE, _MAIN, _P, _H1 = _GROUP["article"], _GROUP["main"], _GROUP["p"], _GROUP["h1"]


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """A row a node of all pages, in order, and each node's parent among these rows (-1: none)."""
    base, parent, group, words_of, hidden, own, top = 0, [], [], [], [], [], []
    for p in pages:
        n = len(p.tag)
        parent += [q + base if q >= 0 else -1 for q in p.parent]
        group += [_GROUP.get(t, len(_GROUPS)) for t in p.tag]
        words_of += [kinds(a) for a in p.attrs]
        hidden += p.hidden
        own += p.own
        top += [base] * n
        base += n
    n = base
    parent, group, top = np.array(parent), np.array(group), np.array(top)
    words_of, hidden, own = np.array(words_of, float), np.array(hidden, float), np.array(own, float)
    up = np.maximum(parent, 0)
    rows = np.arange(n)
    is_p, is_head = group == _P, (group == _H1) | (group == _H1 + 1)
    # sums over subtrees: chars, words, chars in links, marks, links, inputs, nodes, paragraphs, headings, h1, article/main
    total = np.column_stack([own, np.ones(n), is_p, is_head, group == _H1, (group == _ARTICLE) | (group == _MAIN)])
    depth = np.zeros(n, np.int64)
    for i in range(1, n):
        if parent[i] >= 0:
            depth[i] = depth[parent[i]] + 1
    bad = (words_of[:, 1:].sum(axis=1) > 0) | np.isin(group, [_GROUP[t] for t in _NEGATIVE]) | (hidden > 0)
    above = np.zeros((n, 3))  # ancestors: negative ones, article or main, good names
    for d in range(1, int(depth.max(initial=0)) + 1):
        at = rows[depth == d]
        q = parent[at]
        above[at] = above[q] + np.column_stack([bad[q], (group[q] == _ARTICLE) | (group[q] == _MAIN), words_of[q, 0] > 0])
    for d in range(int(depth.max(initial=0)), 0, -1):
        at = rows[depth == d]
        np.add.at(total, parent[at], total[at])
    # siblings: in order of (parent, page order)
    key = np.where(parent >= 0, parent, n + rows)
    order = np.argsort(key, kind="stable")
    start = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if n else np.zeros(0, bool)
    run = np.cumsum(start) - 1
    size = np.bincount(run) if n else np.zeros(0, np.int64)
    first = np.flatnonzero(start)
    place, siblings = np.empty(n), np.empty(n)
    place[order], siblings[order] = np.arange(n) - first[run], size[run]
    before, after = np.full(n, -1), np.full(n, -1)
    inner = np.flatnonzero(~start)
    before[order[inner]], after[order[inner - 1]] = order[inner - 1], order[inner]
    same = {}
    for q, g in zip(key.tolist(), group.tolist()):
        same[q, g] = same.get((q, g), 0) + 1
    alike = np.array([same[q, g] for q, g in zip(key.tolist(), group.tolist())], float)
    log = np.log1p
    chars, words, linked = total[:, 0], total[:, 1], total[:, 2]
    density = linked / np.maximum(chars, 1)
    own_density = own[:, 2] / np.maximum(own[:, 0], 1)

    def near(at, column, missing=-1.0):
        return np.where(at >= 0, column[np.maximum(at, 0)], missing)

    x = np.column_stack([
        group[:, None] == np.arange(len(_GROUPS) + 1), words_of, hidden, bad, above, depth, siblings, place / np.maximum(siblings, 1),
        log(place), log(siblings - place - 1), log(alike), alike / siblings, log(chars), log(words), density, own_density, log(own[:, 0]), log(own[:, 1]),
        total[:, 3] / np.maximum(words, 1), words / np.maximum(total[:, 6], 1), words / np.maximum(total[:, 7], 1), own[:, 0] / np.maximum(chars, 1),
        chars / np.maximum(chars[top], 1), chars / np.maximum(chars[up], 1), log(total[:, 4]), log(total[:, 5]), log(total[:, 6]), log(total[:, 7]),
        total[:, 8], total[:, 9], total[:, 10], total[top, 10], total[top, 9], log(chars[top]), log(total[top, 6]),
        near(parent, group, -1), near(parent, density), near(parent, words_of[:, 0]), near(parent, bad), near(parent, log(chars)), near(parent, total[:, 10]),
        near(before, group), near(before, log(chars)), near(before, density), near(before, bad), near(before, is_head),
        near(after, group), near(after, log(chars)), near(after, density), near(after, bad)]).astype(np.float64)
    return x, parent


def decode(log_p: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The labelling of highest total probability in which no node contradicts its parent."""
    best = log_p.copy()
    for i in range(len(parent) - 1, -1, -1):
        q = parent[i]
        if q >= 0:
            f, a, r = best[i]
            below = a if a > r else r
            best[q, FRAME] += f if f > below else below
            best[q, ARTICLE] += below
            best[q, REST] += r
    label = np.zeros(len(parent), np.int64)
    for i in range(len(parent)):
        over = label[parent[i]] if parent[i] >= 0 else FRAME
        label[i] = over + int(np.argmax(best[i, over:]))
    return label


def _given_labels(page: Page) -> np.ndarray:
    """Parts of a given page with one article element, from its semantic elements."""
    label = np.zeros(len(page.tag), np.int64)
    for i, tag in enumerate(page.tag):
        over = label[page.parent[i]] if i else FRAME
        if over == REST or tag in _NEGATIVE or any(kinds(page.attrs[i])[1:]) or (tag == "header" and over == FRAME):
            label[i] = REST
        elif over == ARTICLE or tag == "article":
            label[i] = ARTICLE
    # outside the article a page's own blocks are not its text
    return label


def _drawn_labels(page: Page, root: int = FRAME) -> np.ndarray:
    label = np.zeros(len(page.tag), np.int64)
    for i, given in enumerate(page.given):
        over = label[page.parent[i]] if i else root
        label[i] = {"c": ARTICLE, "b": REST, None: over}[given]
        label[i] = max(label[i], over)
    return label


_SEMANTIC = re.compile(r"<(/?)(article|main|nav|header|footer|aside|section)\b", re.I)
_NAMES = re.compile(r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*')", re.I)


def train(given: list[str], seed: int = 1, drawn: int = DRAWN) -> Boosted:
    """The trees, from given pages (html with one article element each) and drawn ones."""
    words = [w for h in given[:50] for w in re.sub(r"<[^>]*>|&\w*;?", " ", h).split()[:400]]
    grammar = Grammar(words, seed)
    pages, labels = [], []
    for i, html in enumerate(given):
        page = Page(html)
        labels.append(_given_labels(page))
        if i % 2:  # the same page with its elements' names hidden
            plain = Page(_SEMANTIC.sub(r"<\1div", _NAMES.sub("", html)))
            if len(plain.tag) == len(page.tag):
                page = plain
        pages.append(page)
    for i in range(drawn):
        bare = i % 16 == 0  # text or blocks without a body
        page = Page(grammar.bare() if bare else grammar.page())
        pages.append(page)
        labels.append(_drawn_labels(page, ARTICLE if bare else FRAME))
    x, _ = features(pages)
    return Boosted().fit(x, np.concatenate(labels), 3)


def fit(pages: DataFrame, html: str = "html", seed: int = 1, sample: int = SAMPLE, drawn: int = DRAWN) -> bytes:
    """The pickled model, trained in one task on at most ``sample`` given pages of at most ``LONGEST`` characters."""
    one = F.expr(f"length(`{html}`) - length(replace(`{html}`, '<article', '')) = 8")
    some = pages.select(F.col(html).alias("html"), F.xxhash64(html).alias("h")).where((F.length(html) <= LONGEST) & one)
    # the pages of smallest hash, each once; only hashes are ordered
    last = some.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    some = some.where(F.col("h") <= F.lit(last).cast("long")).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").limit(sample).select("html")

    def run(batches):
        given = [h for batch in batches for h in batch.column(0).to_pylist() if h is not None]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(given, seed, drawn))], pa.binary())], names=["model"])

    # a row without html makes sure that there is a task: without given pages it trains on drawn ones alone
    some = some.union(pages.sparkSession.range(1).select(F.lit(None).cast("string")))
    return some.coalesce(1).mapInArrow(run, "model binary").first()["model"]


def main_texts(model: Boosted, html: list[str]) -> list[str]:
    """The main text of each page."""
    pages = [Page(h) for h in html]
    if not pages:
        return []
    x, parent = features(pages)
    label = decode(model.log_proba(x), parent)
    out, at = [], 0
    for page in pages:
        out.append(blocks(page.runs, label[at:at + len(page.tag)] == ARTICLE))
        at += len(page.tag)
    return out


def extract(pages: DataFrame, model: bytes, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Every page's main text: (key, url, text, n_chars)."""
    schema = T.StructType([pages.schema[key], pages.schema[url], T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])
    step = 64  # pages whose nodes are held at once

    def run(batches):
        trees = pickle.loads(model)
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                texts = main_texts(trees, [h or "" for h in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(key, url, html).mapInArrow(run, schema)
