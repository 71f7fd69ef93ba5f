"""Embedding near-duplicates by randomly rotated binary codes with correction factors.

A unit vector o is rotated by a random orthonormal matrix P; its code is the signs of P o and
its stored factor f = <sign(P o) / sqrt(D), P o>.  For a unit vector q, <code, P q> / f is an
unbiased estimate of <o, q>, and its error stays below
sqrt(1 / f^2 - 1) * eps / sqrt(D - 1) but for a chance that falls as exp(-c eps^2).  Pairs
whose upper bound misses the threshold go; the others are computed again in double precision.

Sign bits of further rotations cut into bands choose which vectors meet at all: two vectors
at angle a agree on a bit with probability 1 - a / pi, so the number of bands follows from
the wanted recall at the threshold itself; closer pairs are found more surely.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import find, parts, runs, split_hot, stored
from .components import connected_components


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthonormal matrix; the same for the same seed on every machine."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def band_plan(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits a band, bands): about one chance meeting a vector and band, and the recall wanted."""
    bits = max(8, math.ceil(math.log2(max(rows, 2))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _encode(bits: int, bands: int, seed: int):
    """Per vector: its code and factor (rotation 0) and the band keys (rotations 1, 2, ...)."""
    made: dict[int, tuple] = {}
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches):
        for b in batches:
            lists = b.column("embedding").to_pylist()
            codes, factors, keys = [None] * len(lists), [0.0] * len(lists), [None] * len(lists)
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(lists):
                by_dim.setdefault(len(v), []).append(i)
            for dim, at in by_dim.items():
                if dim not in made:
                    turns = -(-bits * bands // dim)
                    made[dim] = rotation(dim, seed), np.hstack([rotation(dim, seed + 1 + t) for t in range(turns)])
                base, more = made[dim]
                o = np.array([lists[i] for i in at], np.float64)
                # dividing by the largest component first: squares of tiny or huge ones stay finite
                o /= np.abs(o).max(axis=1, keepdims=True)
                o /= np.linalg.norm(o, axis=1, keepdims=True)
                turned = o @ base
                packed = np.packbits(turned > 0, axis=1)
                factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
                signs = (o @ more > 0)[:, :bits * bands].reshape(len(at), bands, bits)
                # int(dim) keeps vectors of different lengths apart
                banded = (signs @ weights) | (np.arange(bands, dtype=np.int64) << 48) | (np.int64(dim % 4096) << 36)
                for n, i in enumerate(at):
                    codes[i], factors[i], keys[i] = packed[n].tobytes(), float(factor[n]), banded[n]
            yield pa.RecordBatch.from_arrays(
                [b.column("cls"), b.column("first"), b.column("copies"), b.column("embedding"),
                 pa.array(codes, pa.binary()), pa.array(factors, pa.float64()),
                 pa.array(keys, pa.list_(pa.int64()))],
                names=["cls", "first", "copies", "embedding", "code", "factor", "keys"])
    return run


def code_index(classes: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """The index: one row per class of equal vectors with code, factor and band keys."""
    kind = classes.schema["embedding"].dataType.simpleString()
    first = classes.schema["first"].dataType.simpleString()
    return classes.mapInArrow(_encode(bits, bands, seed), f"cls bigint, first {first}, copies bigint, "
                              f"embedding {kind}, code binary, factor double, keys array<bigint>")


def _pairs(threshold: float, eps: float, seed: int):
    """Linked pairs inside each block: link counts per class and a spanning forest."""
    def run(batches):
        turn: dict[int, np.ndarray] = {}
        for t, bounds in runs(batches, ["key", "bi", "bj"]):
            lists = t.column("embedding").to_pylist()
            codes = t.column("code").to_pylist()
            keys = t.column("keys").to_pylist()
            factor, copies, cls, key, u, bi, bj = (
                t.column(c).to_numpy() for c in ("factor", "copies", "cls", "key", "u", "bi", "bj"))
            out_c, out_n, out_r, tested = [], [], [], 0
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                dim = len(lists[s])
                if any(len(x) != dim for x in lists[s:e]):
                    raise ValueError("vectors of different lengths in one block")
                if dim not in turn:
                    turn[dim] = rotation(dim, seed)
                v = np.array(lists[s:e], np.float64)
                v /= np.abs(v).max(axis=1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                f = factor[s:e]
                bits = np.unpackbits(np.frombuffer(b"".join(codes[s:e]), np.uint8).reshape(e - s, -1), axis=1)[:, :dim]
                code = (bits.astype(np.float64) * 2 - 1) / math.sqrt(dim)
                bound = np.sqrt(np.maximum(1 / f ** 2 - 1, 0)) * eps / math.sqrt(max(dim - 1, 1))
                left = np.arange(e - s) if bi[s] == bj[s] else np.flatnonzero(u[s:e] == bi[s])
                right = left if bi[s] == bj[s] else np.flatnonzero(u[s:e] == bj[s])
                estimate = (code[left] @ (v[right] @ turn[dim]).T) / f[left, None]
                maybe = estimate + bound[left, None] >= threshold
                if bi[s] == bj[s]:
                    maybe = np.triu(maybe | maybe.T, 1)
                i, j = np.nonzero(maybe)
                i, j = left[i], right[j]
                linked = np.zeros(len(i), bool)
                band = np.array(keys[s:e])
                for at in range(0, len(i), 65536):
                    a, b = i[at:at + 65536], j[at:at + 65536]
                    ok = np.einsum("ij,ij->i", v[a], v[b]) >= threshold
                    same = band[a] == band[b]
                    # a pair that meets in several bands counts in the first of them
                    ok &= band[a, same.argmax(axis=1)] == key[s]
                    linked[at:at + 65536] = ok
                i, j = i[linked], j[linked]
                if not len(i):
                    continue
                c = copies[s:e]
                n = np.zeros(e - s, np.int64)
                np.add.at(n, i, c[j])
                np.add.at(n, j, c[i])
                parent = list(range(e - s))
                for a, b in zip(i.tolist(), j.tolist()):
                    a, b = find(parent, a), find(parent, b)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                own = cls[s:e]
                for a in np.flatnonzero(n).tolist():
                    out_c.append(own[a])
                    out_n.append(n[a])
                    out_r.append(own[find(parent, a)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_c, pa.int64()), pa.array(out_n, pa.int64()), pa.array(out_r, pa.int64())],
                names=["cls", "links", "root"])
    return run


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95,
                 recall: float = 0.999, eps: float = 6.0, seed: int = 7, cap: int = 1024) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``vectors``.

    ``n_links``: other rows whose cosine with this one is >= ``threshold`` in double precision;
    ``component_id``: the smallest key reachable over such links, itself included.  No link
    below the threshold is counted; one at the threshold is missed with probability at most
    1 - ``recall``, a closer one more rarely.

    Null, empty and zero vectors, and those with null or non-finite components, link with
    nothing: n_links 0, their own key.  Vectors of different lengths never link.  Equal
    vectors (repeated rows too) form one class and are searched once, whatever their number.
    Null keys take part but name a component only where all its keys are null.  Other columns
    of ``vectors`` aren't read.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(key).alias("id"), F.col(vector).alias("embedding"))
    usable = (F.col("embedding").isNotNull()
              & F.coalesce(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
              & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)))
    good = given.where(usable)
    classes = stored(good.groupBy("embedding").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
                     .withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    bits, bands = band_plan(classes.count(), threshold, recall)
    index = stored(code_index(classes.select("cls", "first", "copies", "embedding"), bits, bands, seed), "vector-codes")
    keyed = index.select("cls", F.explode("keys").alias("key"))
    blocks = split_hot(keyed, "key", "cls", cap).join(index.drop("first"), "cls")
    n = parts(spark)
    found = stored(blocks.repartition(n, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
                   .select("key", "bi", "bj", "u", "cls", "copies", "embedding", "code", "factor", "keys")
                   .mapInArrow(_pairs(threshold, eps, seed), "cls bigint, links bigint, root bigint"), "vector-links")
    root = connected_components(found.select(F.col("cls").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = (index.select("cls", "first", "copies", "embedding").join(links, "cls", "left")
             .join(root.withColumnRenamed("node", "cls"), "cls", "left")
             .withColumn("root", F.coalesce("root", "cls")))
    lowest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(lowest, "root").select(
        "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "component_id")
    done = good.join(named, "embedding").select("id", "n_links", "component_id")
    rest = given.where(~F.coalesce(usable, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return done.unionByName(rest).select(
        F.col("id").alias(key), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
