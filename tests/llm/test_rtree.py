"""Hard negatives against a plain search, and what the boxes leave out."""

import random

import numpy as np
from pyspark.sql import functions as F

from ludex.llm import rtree as R
from ludex.llm.registry import op13_hard_negatives


def _plain(rows, positives=5, k=10, low=30, high=90):
    """rows: {id: (label, vector)}; anchors are ids divisible by 100."""
    out = set()
    width = max((len(v) for _, v in rows.values()), default=0)
    pad = {i: np.array(list(v) + [0] * (width - len(v)), np.int64) for i, (_, v) in rows.items()}
    for a, (label, _) in rows.items():
        if a % 100:
            continue
        score = {i: int(pad[a] @ pad[i]) for i in rows if i != a}
        first = sorted((i for i in score if rows[i][0] == label), key=lambda i: (-score[i], i))[:positives]
        for p in first:
            fit = [i for i in score if rows[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            for rank, i in enumerate(sorted(fit, key=lambda i: (-score[i], i))[:k], 1):
                out.add((a, p, rank, i, score[p], score[i]))
    return out


def _data(seed, n, width, labels=4, spread=20):
    r = random.Random(seed)
    centres = [[r.randint(-spread, spread) for _ in range(width)] for _ in range(6)]
    return {i * 10: (r.randrange(labels), [c + r.randint(-6, 6) for c in r.choice(centres)]) for i in range(n)}


def _run(spark, rows, **kw):
    df = spark.createDataFrame([(i, label, v, "x", 1) for i, (label, v) in rows.items()],
                               "vec_id long, label int, embedding array<long>, block string, shard int")
    return {tuple(r) for r in R.hard_negatives(df, F.col("id") % 100 == 0, **kw).collect()}


def test_equals_plain_search(spark):
    rows = _data(1, 900, 8)
    want = _plain(rows)
    assert len(want) > 500
    assert _run(spark, rows) == want
    # several shards, cells and blocks of anchors
    assert _run(spark, rows, shard_rows=97, block_rows=16) == want


def test_ties_copies_and_mixed_lengths(spark):
    r = random.Random(3)
    rows = {i * 20: (r.randrange(2), [3, 1, 2]) for i in range(200)}  # all tied
    rows |= {i * 20 + 5: (r.randrange(2), [r.randint(1, 2), 1]) for i in range(60)}
    rows[100_000] = (1, [])
    assert _run(spark, rows, shard_rows=50) == _plain(rows)


def test_one_label_holds_most_rows_and_single_labels(spark):
    rows = _data(5, 500, 4, labels=1)
    rows |= {1 + 10 * i: (100 + i, [i % 7, 1, 2, 3]) for i in range(300)}
    rows[700_000] = (-5, [1, 1, 1, 1])  # no other row of its label
    assert _run(spark, rows, shard_rows=64) == _plain(rows)


def test_nulls_repeats_and_empty_tables(spark):
    rows = _data(7, 200, 3)
    df = spark.createDataFrame(
        [(i, label, v) for i, (label, v) in rows.items()] * 2 + [(None, 1, [1, 2, 3]), (3, None, [1, 2, 3]), (13, 1, None), (23, 1, [1, None, 3])],
        "vec_id long, label int, embedding array<long>")
    assert {tuple(r) for r in R.hard_negatives(df, F.col("id") % 100 == 0).collect()} == _plain(rows)
    assert R.hard_negatives(df.where("false"), F.col("id") % 100 == 0).count() == 0


def test_query_rules(spark, tmp_path):
    """Labels move where vec_id is divisible by 7, components are floor(256 x), non-finite rows take no part."""
    r = random.Random(11)
    raw = [(i, r.randrange(10), [r.gauss(0, 1) for _ in range(5)]) for i in range(400)]
    raw += [(1000, 1, [float("nan")] + [0.1] * 4), (1100, 1, [float("inf")] + [0.1] * 4), (1200, None, [0.1] * 5), (1300, 1, None)]
    spark.createDataFrame(raw, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {i: ((label + 1) % 10 if i % 7 == 0 else label, np.floor(np.float32(v).astype(float) * 256).astype(int).tolist())
            for i, label, v in raw[:400]}
    assert {tuple(x) for x in op13_hard_negatives(spark, str(tmp_path)).collect()} == _plain(want)


def test_boxes_bound_and_prune():
    r = np.random.default_rng(2)
    centres = r.integers(-100, 100, (40, 6))
    vectors = (centres[r.integers(0, 40, 4000)] + r.integers(-3, 4, (4000, 6))).astype(float)
    labels = r.integers(0, 3, 4000)
    tree = R.Tree(np.arange(4000), labels, vectors)
    anchors = vectors[:20]
    low, high = tree.intervals(anchors)
    for node in range(tree.leaves):
        s = anchors @ tree.vectors[tree.first[node]:tree.last[node]].T
        assert (low[:, node] <= s.min(axis=1)).all() and (s.max(axis=1) <= high[:, node]).all()
    # a parent's box holds its children's
    for node in range(tree.leaves, len(tree.first)):
        for child in range(tree.first[node], tree.last[node]):
            assert (tree.low[node] <= tree.low[child]).all() and (tree.high[node] >= tree.high[child]).all()
    read = []
    for q, lo, hi in zip(anchors, low, high):
        (best,), n = tree.search(q, -1, 1, True, [(-np.inf, np.inf)], 5, lo, hi)
        s = tree.vectors @ q
        want = sorted(((int(s[i]), int(tree.ids[i])) for i in np.flatnonzero(tree.labels == 1)), key=lambda x: (-x[0], x[1]))[:5]
        assert best == want
        read.append(n)
    assert np.mean(read) < tree.leaves / 4  # best first: most leaves are never read
