"""Vector operators: cosine KNN (V3), text embedding (V2); ``ivf`` has the index
for approximate search (V4) and the pruned join (V5).

Exact KNN is a map-side cosine per row followed by ``orderBy().limit(k)``,
which Spark plans as TakeOrderedAndProject: every task keeps its own top k and
only k rows per task reach the final merge.  The query vector is a Column
(a literal of the embedding width).

Embedding is the one place Python runs per batch: ``mapInArrow`` hands pieces of
Arrow batches, cut by bytes of text, to a caller-supplied encoder (a sentence
model where installed; the default here is a hashing encoder, since no model is
installed).
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludex.functions.batches import pieces


def _as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_as_double(a), _as_double(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(_as_double(a), lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays (NULL when a norm is 0)."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def knn(df: DataFrame, vec_col: str, query: Column, k: int, out: str = "similarity",
        tiebreak: str | None = None) -> DataFrame:
    """The ``k`` rows most cosine-similar to ``query`` (rows without a vector skipped)."""
    scored = df.filter(F.col(vec_col).isNotNull()).withColumn(out, cosine(F.col(vec_col), query))
    order = [F.desc_nulls_last(out)] + ([F.asc(tiebreak)] if tiebreak else [])
    return scored.orderBy(*order).limit(k)


def knn_join(queries: DataFrame, corpus: DataFrame, q_id: str, c_id: str, vec: str, k: int,
             exclude_self: bool = False, block_rows: int = 4096) -> DataFrame:
    """V5: exact top-``k`` cosine neighbours in ``corpus`` for every query vector.

    Both sides are cut into hash blocks of about ``block_rows`` rows, and every
    block of queries meets every block of the corpus in one task: one matrix
    product of bounded size, of which the best ``k`` a query are kept.  Spark
    then takes the exact top ``k`` per query (``row_number() <= k``).  Ties
    break on the corpus id.  Work is queries x corpus, so ``queries`` should be
    a stated set; no vector passes through the driver and nothing is broadcast.
    Vectors that are NULL or of length 0 have no neighbours.
    Returns (q_id, c_id, similarity, rank).
    """
    def side(df, id_col, name):
        v = df.filter(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias(name), F.col(vec).alias("_v"))
        n = F.greatest(F.ceil(F.count(F.lit(1)) / block_rows).cast("int"), F.lit(1))
        return v, v.agg(n.alias("n")).scalar()

    (q, n_q), (c, n_c) = side(queries, q_id, "_qid"), side(corpus, c_id, "_cid")

    def blocks(v, id_col, own, n_own, other, n_other):
        v = v.withColumn("_n", n_own).withColumn("_m", n_other)
        return (v.withColumn(own, F.pmod(F.xxhash64(id_col), F.col("_n").cast("long")).cast("int"))
                 .withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).drop("_n", "_m"))

    def unit(vectors):
        m = np.stack(vectors.to_numpy()).astype(np.float64)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(size == 0, np.nan, size)

    def best(left, right):
        if left.empty or right.empty:
            return pd.DataFrame({"_qid": [], "_cid": [], "similarity": []}).astype({"_qid": "int64", "_cid": "int64"})
        right = right.sort_values("_cid")
        qids, cids = left["_qid"].to_numpy(np.int64), right["_cid"].to_numpy(np.int64)
        sims = unit(left["_v"]) @ unit(right["_v"]).T
        if exclude_self:
            sims[qids[:, None] == cids[None, :]] = np.nan
        sims = np.where(np.isnan(sims), -np.inf, sims)
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]  # ids ascend, so ties keep the smaller
        value = np.take_along_axis(sims, top, axis=1).ravel()
        keep = np.isfinite(value)
        return pd.DataFrame({"_qid": np.repeat(qids, top.shape[1])[keep], "_cid": cids[top.ravel()][keep], "similarity": value[keep]})

    from pyspark.sql import Window

    cand = (blocks(q, "_qid", "_qb", n_q, "_cb", n_c).groupBy("_qb", "_cb")
            .cogroup(blocks(c, "_cid", "_cb", n_c, "_qb", n_q).groupBy("_qb", "_cb"))
            .applyInPandas(best, "_qid long, _cid long, similarity double"))
    w = Window.partitionBy("_qid").orderBy(F.desc("similarity"), F.asc("_cid"))
    out = cand.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return out.select(F.col("_qid").alias(q_id), F.col("_cid").alias(c_id), "similarity", F.col("_rn").alias("rank"))


def hashing_encoder(dim: int = 64):
    """Deterministic bag-of-words hashing encoder: texts -> unit vectors (float32).

    A token's first eight hex digits of its md5 give its place and sign, so any
    engine can compute the same vector.  Distinct tokens of an Arrow batch are
    hashed once and summed with one ``bincount``."""
    token = r"[a-z0-9]+"

    def encode(texts: pd.Series) -> np.ndarray:
        n = len(texts)
        toks = texts.fillna("").str.lower().str.findall(token)
        lens = toks.str.len().to_numpy(dtype=np.int64)
        out = np.zeros(n * dim, dtype=np.float64)
        if lens.sum():
            flat = np.concatenate([np.asarray(x, dtype=object) for x in toks.to_numpy() if len(x)])
            codes, distinct = pd.factorize(flat)
            h = np.array([int(md5(x.encode()).hexdigest()[:8], 16) for x in distinct], dtype=np.uint64)[codes]
            rows = np.repeat(np.arange(n, dtype=np.int64), lens)
            idx = rows * dim + (h % np.uint64(dim)).astype(np.int64)
            sign = np.where((h >> np.uint64(16)) & np.uint64(1), 1.0, -1.0)
            out += np.bincount(idx, weights=sign, minlength=n * dim)
        out = out.reshape(n, dim)
        norm_ = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm_ == 0, 1, norm_)).astype(np.float32)
    return encode


def embed(df: DataFrame, text_col: str, out: str = "embedding", encoder=None, dim: int = 64,
          batch_size: int | None = None) -> DataFrame:
    """V2: add ``out`` = encoder(text) as array<float>, batch by batch (Arrow).

    A worker holds the tokens of about ``PIECE_BYTES`` of text, whatever rows an
    Arrow batch has and however long they are.  ``batch_size`` (K12) caps rows
    handed to the encoder (the reference encodes 500 texts at a time)."""
    encoder = encoder or hashing_encoder(dim)
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType
    schema = StructType(df.schema.fields + [StructField(out, ArrayType(FloatType()), True)])
    cols = df.columns

    def run(batches):
        for whole in batches:
            for i, j in pieces(whole.column(text_col), batch_size):
                some = whole.select(cols).slice(i, j - i)
                # the encoder's rows as one flat Arrow list, without a Python object a row
                made = np.ascontiguousarray(encoder(some.column(text_col).to_pandas()), dtype=np.float32)
                ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
                vectors = pa.ListArray.from_arrays(ends, pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*some.columns, vectors], names=[*cols, out])
    return df.mapInArrow(run, schema)


def backfill(df: DataFrame, text_col: str, vec_col: str, encoder=None, dim: int = 64, batch_size: int | None = None) -> DataFrame:
    """K8: fill ``vec_col`` where it is NULL; rows that have a vector pass through."""
    have = df.filter(F.col(vec_col).isNotNull())
    need = embed(df.filter(F.col(vec_col).isNull()).drop(vec_col), text_col, vec_col, encoder, dim, batch_size)
    return have.unionByName(need.select(*df.columns))
