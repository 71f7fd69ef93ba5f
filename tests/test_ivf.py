"""Inverted-file index: recall with the registered parameters, pruning, exactness of the join."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ludex.operators import ivf
from ludex.operators import vectors as V
from ludex.plans.search import PROBES
from ludex.sources.warehouse import build, materialize


@pytest.fixture(scope="module")
def stored(spark):
    return materialize(build(spark, "/root/testdata/sf0.1"), tempfile.mkdtemp(prefix="ludex-ivf-"), ["review_cells", "review_index"])


def test_recall_with_registered_parameters(stored):
    """Over all ids divisible by 100: at least 0.9 of the exact 12 nearest."""
    idx, cells = stored["review_index"], stored["review_cells"]
    rows = idx.select("id", "unit", "cell").toPandas()
    m, c = np.stack(rows["unit"]), ivf._stored_centroids(cells)
    hit = total = 0
    for i in np.flatnonzero(rows["id"].to_numpy() % 100 == 0):
        s = m @ m[i]
        exact = np.lexsort((rows["id"], -s.round(12)))[:12]
        probed = np.argsort(-(c @ m[i]), kind="stable")[:PROBES]
        hit += np.isin(rows["cell"].to_numpy()[exact], probed).sum()
        total += 12
    assert total >= 12 * 10 and hit / total >= 0.9
    # and the operator gives what these cells hold
    for i in (0, 700, 1900):
        q = rows["unit"][rows["id"] == i].iloc[0]
        got = [r.id for r in ivf.search(idx, cells, q, 12, PROBES).collect()]
        near = np.isin(rows["cell"], np.argsort(-(c @ np.asarray(q)), kind="stable")[:PROBES])
        s = np.where(near, m @ np.asarray(q), -2)
        assert set(got) == set(rows["id"].to_numpy()[np.argsort(-s, kind="stable")[:12]])


def test_search_reads_the_nearest_cells_only(stored):
    idx, cells = stored["review_index"], stored["review_cells"]
    q = idx.where("id = 0").first()["unit"]
    plan = ivf.search(idx, cells, q, 5, 3)._jdf.queryExecution().executedPlan().toString().replace("\n", "")
    assert "PartitionFilters: [cell" in plan
    files = {r[0] for r in idx.where(F.col("cell").isin(1, 2)).select(F.input_file_name()).distinct().collect()}
    assert files and all("cell=1/" in f or "cell=2/" in f for f in files)


def _clustered(spark, n=1200, width=12, groups=20, seed=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, width)) * 5
    m = centres[r.integers(0, groups, n)] + r.normal(size=(n, width)) * 0.4
    rows = [(i, m[i].tolist()) for i in range(n)] + [(n, [0.0] * width), (n + 1, None)]
    return m, spark.createDataFrame(rows, "id long, v array<double>").repartition(4)


def test_pruned_join_is_exact_and_skips_pairs(spark):
    m, df = _clustered(spark)
    vectors = ivf.units(df, "id", "v")
    c = ivf.centroids(vectors, cells=24, sample=600)
    idx, cells = ivf.index(vectors, c).checkpoint(), ivf.cell_table(spark, c)
    got = {}
    for r in ivf.knn_join(idx, cells, F.col("id") % 3 == 0, 4, block_rows=40).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.cid
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    assert {q: [x[i] for i in (1, 2, 3, 4)] for q, x in got.items()} == {
        q: np.argsort(-sims[q], kind="stable")[:4].tolist() for q in range(0, 1200, 3)}
    # pairs of blocks that are left, against all
    q = ivf._blocks(idx.where("id % 3 = 0"), [1] * 24, ("qc", "qp"))
    corpus = ivf._blocks(idx, [2] * 24, ("cc", "cp"))
    reached = q.groupBy("qc", "qp").agg(F.count("id").alias("bounded")).withColumn("least", F.lit(0.9))
    left = ivf.surviving_pairs(q, corpus, cells, reached).count()
    every = q.select("qc", "qp").distinct().count() * corpus.select("cc", "cp").distinct().count()
    assert left < 0.5 * every


def test_join_equals_the_block_join(spark):
    """Without structure nothing can be skipped; results are those of the plain block join."""
    r = np.random.default_rng(8)
    df = spark.createDataFrame([(i, r.normal(size=6).tolist()) for i in range(200)], "id long, v array<double>")
    vectors = ivf.units(df, "id", "v")
    c = ivf.centroids(vectors, cells=5)
    got = ivf.knn_join(ivf.index(vectors, c), ivf.cell_table(spark, c), F.lit(True), 3, block_rows=16).select("qid", "cid", "rank")
    want = V.knn_join(df, df, "id", "id", "v", 3, exclude_self=True, block_rows=64)
    assert sorted(map(tuple, got.collect())) == sorted((x[0], x[1], x["rank"]) for x in want.collect())


def test_empty_and_single_rows(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    vectors = ivf.units(empty, "id", "v")
    c = ivf.centroids(vectors)
    idx, cells = ivf.index(vectors, c), ivf.cell_table(spark, c)
    assert ivf.search(idx, cells, [1.0, 2.0], 3, 2).count() == 0
    one = ivf.units(spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>"), "id", "v")
    c = ivf.centroids(one)
    assert ivf.knn_join(ivf.index(one, c), ivf.cell_table(spark, c), F.lit(True), 3).count() == 0
    assert [r.id for r in ivf.search(ivf.index(one, c), ivf.cell_table(spark, c), [1.0, 2.0], 3, 2).collect()] == [1]
