"""Inverted-file index over vectors: approximate search (V4) and an exact join with pruning (V5).

Vectors are scaled to length 1 and dealt to the cell of their nearest centroid.  Centroids come
from spherical k-means on a bounded sample: the ``sample`` rows of smallest md5 of their id, so
that every engine can draw the same one.  The index is a stored table partitioned by cell:

* a search reads only the ``probes`` cells nearest to its query (partition pruning);
* a join bounds the angle between a block of queries and a block of a cell by the triangle inequality
  -- the angle of the centroids less the two radii -- and leaves out pairs that can't hold a
  neighbour better than those found in the queries' own cell.  Nothing else is left out: it is exact.

NULL vectors, and those of length 0, aren't indexed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ludex.operators import vectors as V
from ludex.operators.vectors import _as_double, knn, norm, vector_literal

CELLS, SAMPLE, ROUNDS = 16, 4096, 3
INDEX_SCHEMA = "id long, unit array<double>, angle double, cell int"
#: What a rounded angle may be off by.
_SLACK = 1e-7


def units(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, unit): vectors of length 1."""
    v = df.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("id"), _as_double(F.col(vec)).alias("v")).withColumn("n", norm(F.col("v")))
    return v.where("n > 0").select("id", F.transform("v", lambda x: x / F.col("n")).alias("unit"))


def centroids(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means on the sample, started from its first rows; at most ``sample`` vectors reach the driver."""
    drawn = vectors.withColumn("h", F.md5(F.col("id").cast("string"))).orderBy("h", "id").limit(sample).select("unit").toPandas()["unit"]
    if not len(drawn):
        return np.zeros((0, 0))
    m = np.stack(drawn.to_list())
    c = m[:cells].copy()
    for _ in range(rounds):
        near = (m @ c.T).argmax(axis=1)
        for j in range(len(c)):
            total = m[near == j].sum(axis=0)
            if np.linalg.norm(total) > 0:  # an empty cell keeps its centroid
                c[j] = total / np.linalg.norm(total)
    return c


def index(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """(id, unit, angle, cell): every vector with its nearest centroid (ties: the first) and the angle to it."""
    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.stack(batch.column("unit").to_numpy(zero_copy_only=False))
            sims = m @ c.T
            cell = sims.argmax(axis=1)
            angle = np.arccos(np.clip(sims[np.arange(len(m)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("unit"), pa.array(angle), pa.array(cell.astype(np.int32))],
                                             names=["id", "unit", "angle", "cell"])

    if not len(c):
        return vectors.sparkSession.createDataFrame([], INDEX_SCHEMA)
    return vectors.select("id", "unit").mapInArrow(assign, INDEX_SCHEMA)


def cell_table(spark, c: np.ndarray) -> DataFrame:
    """(cell, centroid): a row a cell, to be stored beside the index."""
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cell int, centroid array<double>")


def _stored_centroids(cells: DataFrame) -> np.ndarray:
    """Centroids by cell; their number is the parameter the index was built with."""
    rows = cells.orderBy("cell").collect()
    return np.array([r["centroid"] for r in rows]) if rows else np.zeros((0, 0))


def search(idx: DataFrame, cells: DataFrame, query, k: int, probes: int) -> DataFrame:
    """V4: the ``k`` rows nearest to ``query`` among the ``probes`` nearest cells: (id, similarity).

    On an index stored by cell the other cells aren't read."""
    c, q = _stored_centroids(cells), np.asarray(query, float)
    size = np.linalg.norm(q)
    if not len(c) or size == 0:
        return idx.select("id", F.lit(0.0).alias("similarity")).limit(0)
    nearest = np.argsort(-(c @ (q / size)), kind="stable")[:probes].tolist()
    hits = idx.where(F.col("cell").isin([int(x) for x in nearest]))
    return knn(hits, "unit", vector_literal(q), k, tiebreak="id").select("id", "similarity")


def _blocks(rows: DataFrame, parts: list[int], names: tuple[str, str]) -> DataFrame:
    """Rows with their block: a cell, cut by a hash into ``parts[cell]`` parts."""
    cell, part = names
    n = F.element_at(F.lit(parts), F.col("cell") + 1).cast("bigint")
    return rows.select(F.col("cell").alias(cell), F.pmod(F.xxhash64("id"), n).cast("int").alias(part), "id", "unit", "angle")


def surviving_pairs(q: DataFrame, c: DataFrame, cells: DataFrame, reached: DataFrame) -> DataFrame:
    """Blocks of queries and of the corpus that can still hold a neighbour: (qc, qp, cc, cp).

    ``reached``: (qc, qp, bounded, least), how many of a block's queries have k neighbours so far
    and the smallest of their k-th similarities."""
    m = _stored_centroids(cells)

    def angles(batches):
        for pdf in batches:
            a = np.arccos(np.clip(m[pdf["cell"]] @ m.T, -1, 1))
            yield pd.DataFrame({"qc": np.repeat(pdf["cell"], len(m)), "cc": np.tile(np.arange(len(m)), len(pdf)), "apart": a.ravel()})

    between = cells.select("cell").mapInPandas(angles, "qc int, cc int, apart double")
    qs = q.groupBy("qc", "qp").agg(F.max("angle").alias("qr"), F.count(F.lit(1)).alias("queries")).join(reached, ["qc", "qp"], "left")
    # a query without k neighbours so far takes any
    least = F.when(F.col("bounded") == F.col("queries"), F.col("least")).otherwise(-2.0)
    qs = qs.select("qc", "qp", "qr", least.alias("least"))
    cs = c.groupBy("cc", "cp").agg(F.max("angle").alias("cr"))
    pairs = qs.join(between, "qc").join(cs, "cc")
    gap = F.greatest(F.col("apart") - F.col("qr") - F.col("cr"), F.lit(0.0))
    return pairs.where((F.col("qc") != F.col("cc")) & (F.cos(gap) >= F.col("least") - F.lit(_SLACK))).select("qc", "qp", "cc", "cp")


def _best(k: int, exclude_self: bool):
    """The best k of a block of the corpus for each query of a block."""
    def best(left, right):
        if left.empty or right.empty:
            return pd.DataFrame({"qc": [], "qp": [], "qid": [], "cid": [], "similarity": []}).astype({n: "int64" for n in ("qc", "qp", "qid", "cid")})
        right = right.sort_values("cid")
        qids, cids = left["id"].to_numpy(np.int64), right["cid"].to_numpy(np.int64)
        sims = np.stack(left["unit"].to_numpy()) @ np.stack(right["cunit"].to_numpy()).T
        if exclude_self:
            sims[qids[:, None] == cids[None, :]] = -np.inf
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]  # ids ascend, so ties keep the smaller
        value = np.take_along_axis(sims, top, axis=1).ravel()
        keep = np.isfinite(value)
        return pd.DataFrame({"qc": left["qc"].iloc[0], "qp": left["qp"].iloc[0], "qid": np.repeat(qids, top.shape[1])[keep], "cid": cids[top.ravel()][keep], "similarity": value[keep]})
    return best


def knn_join(idx: DataFrame, cells: DataFrame, queries, k: int, exclude_self: bool = True, block_rows: int = 4096) -> DataFrame:
    """V5: the exact ``k`` most similar rows of the index for every query: (qid, cid, similarity, rank).

    ``queries``: a condition on the index's ``id``, a stated set.  Queries meet their own cell first;
    their k-th similarity there bounds the rest, and only blocks that can still beat it are met.
    Ties go to the smaller id."""
    # rows by cell: as many numbers as the index has cells
    sizes = {r["cell"]: r for r in idx.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(queries).alias("q")).collect()}
    if sum(r["n"] for r in sizes.values()) <= block_rows:  # one pair of blocks: nothing to leave out
        one = V.knn_join(idx.where(queries), idx, "id", "id", "unit", k, exclude_self, block_rows)
        return one.toDF("qid", "cid", "similarity", "rank")
    n_cells = max(sizes, default=-1) + 1
    parts = {n: [max(1, -(-(sizes[i][n] if i in sizes else 0) // block_rows)) for i in range(max(1, n_cells))] for n in ("n", "q")}
    q = _blocks(idx.where(queries), parts["q"], ("qc", "qp"))
    c = _blocks(idx, parts["n"], ("cc", "cp"))
    out = "qc int, qp int, qid long, cid long, similarity double"
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "cid")
    pair = ["qc", "qp", "cc", "cp"]

    def top(found):
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def met(left, right):
        left = left.select(*pair, "id", "unit")
        right = right.select(*[F.col(n).alias("of_" + n) for n in pair], F.col("id").alias("cid"), F.col("unit").alias("cunit"))
        return left.groupBy(*pair).cogroup(right.groupBy(*["of_" + n for n in pair])).applyInPandas(_best(k, exclude_self), out)

    def others(n: str, cell: str):
        return F.explode(F.sequence(F.lit(0), F.element_at(F.lit(parts[n]), F.col(cell) + 1) - 1))

    home = met(q.withColumn("cc", F.col("qc")).withColumn("cp", others("n", "qc")), c.withColumn("qc", F.col("cc")).withColumn("qp", others("q", "cc")))
    near = top(home).checkpoint()  # read for the bound and for the result
    kth = near.where(F.col("rank") == k)
    reached = kth.groupBy("qc", "qp").agg(F.count(F.lit(1)).alias("bounded"), F.min("similarity").alias("least"))
    pairs = surviving_pairs(q, c, cells, reached)
    far = met(q.join(pairs, ["qc", "qp"]), c.join(pairs, ["cc", "cp"]))
    return top(near.select("qid", "cid", "similarity").unionByName(far.select("qid", "cid", "similarity")))
