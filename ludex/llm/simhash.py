"""SimHash near-duplicates: 64-bit fingerprints, linked within a Hamming radius by BK-trees.

Two fingerprints within ``max_bits`` differing bits agree on at least two of ``max_bits + 2``
bit blocks.  Every pair of blocks therefore names a shard: fingerprints that share both
blocks meet there, and a BK-tree over the shard answers the radius query.  The trees travel
to their probes by a shuffle on the shard key, not by broadcast: the set of all fingerprints
grows with the corpus, and no bound on it can be proven.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import find, parts, runs, split_hot, stored, texts
from .components import connected_components

SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles (A-Z lower-cased, repeats counted).

    Fewer words than a shingle: the whole sequence is the one shingle; no words: 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends[shingle - 1:].tolist()
    h, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(ends), 16384):
        hashed = np.array([h(joined[a:b], SEED) for a, b in zip(starts[i:i + 16384], ends[i:i + 16384])], "<u8")
        bits = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * total > len(ends))
    return sum(1 << int(b) for b in set_bits)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed 64-bit long; one row per input row."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts(b, "t")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(fp)], names=["k", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
            .mapInArrow(run, f"k {kind}, fp bigint").withColumnRenamed("k", key))


class BKTree:
    """Integers under Hamming distance; children keyed by their distance to the parent."""

    def __init__(self):
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> int:
        """Insert x and return its node (an equal item's node, if there is one)."""
        if not self.items:
            self.items.append(x)
            self.children.append({})
            return 0
        at = 0
        while True:
            d = (x ^ self.items[at]).bit_count()
            if d == 0:
                return at
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = len(self.items)
                self.items.append(x)
                self.children.append({})
                return len(self.items) - 1
            at = nxt

    def within(self, x: int, radius: int):
        """Nodes at most ``radius`` from x: only edges within d - radius .. d + radius are followed."""
        if not self.items:
            return
        todo = [0]
        while todo:
            at = todo.pop()
            d = (x ^ self.items[at]).bit_count()
            if d <= radius:
                yield at
            kids = self.children[at]
            if kids:
                todo.extend(c for e, c in kids.items() if d - radius <= e <= d + radius)


def shard_keys(fp: str, max_bits: int) -> list:
    """One key for each pair of the max_bits + 2 bit blocks: (pair number, both blocks' bits)."""
    n = max_bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(F.col(fp), a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
             for a, b in zip(edges, edges[1:])]
    width = [b - a for a, b in zip(edges, edges[1:])]
    return [F.shiftleft(F.lit(i).cast("long"), 46).bitwiseOR(F.shiftleft(block[p], width[q]).bitwiseOR(block[q]))
            for i, (p, q) in enumerate(combinations(range(n), 2))]


def _links(radius: int):
    def run(batches):
        for t, bounds in runs(batches, ["key", "bi", "bj"]):
            fps = t.column("fp").to_numpy()
            plain = fps.view(np.uint64).tolist()
            u, bi, bj = (t.column(c).to_numpy() for c in ("u", "bi", "bj"))
            src, dst = [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                tree, at, parent = BKTree(), {}, list(range(e - s))
                whole = bi[s] == bj[s]
                for i in range(s, e):  # the tree's own chunk first
                    if whole or u[i] == bi[s]:
                        at[tree.add(plain[i])] = i
                        if whole:
                            for node in tree.within(plain[i], radius):
                                parent[find(parent, at[node] - s)] = find(parent, i - s)
                if not whole:
                    for i in range(s, e):
                        if u[i] == bj[s]:
                            for node in tree.within(plain[i], radius):
                                parent[find(parent, at[node] - s)] = find(parent, i - s)
                for i in range(e - s):
                    r = find(parent, i)
                    if r != i:
                        src.append(fps[s + i])
                        dst.append(fps[s + r])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
    return run


def link(distinct: DataFrame, max_bits: int = 3, cap: int = 4096) -> DataFrame:
    """Edges (src, dst) that span the groups of fingerprints (column fp, distinct) linked
    within ``max_bits`` bits.  A shard gives a spanning forest, at most one edge a member."""
    keyed = distinct.select("fp", F.explode(F.array(*shard_keys("fp", max_bits))).alias("key"))
    blocks = split_hot(keyed, "key", "fp", cap)
    n = parts(distinct.sparkSession)
    return (blocks.repartition(n, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "fp")
            .mapInArrow(_links(max_bits), "src bigint, dst bigint"))


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                   max_bits: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest key among the
    rows reachable over links of at most ``max_bits`` differing bits, itself included.

    Null or blank texts have fingerprint 0 and are linked like any other.  Null keys take part
    but never name a group, unless all keys of the group are null.  Repeated rows stay.
    Other columns of ``docs`` aren't read.  An empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, key, text, shingle), "simhash")
    named = _named(fps, key, max_bits).select("fp", "component_id")
    return fps.join(named, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(fps: DataFrame, key: str, max_bits: int) -> DataFrame:
    """(fp, root, component_id) of every different fingerprint; ``root`` names its group."""
    first = fps.groupBy("fp").agg(F.min(key).alias("first"))
    root = connected_components(link(first.select("fp"), max_bits))
    linked = first.join(root, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    return linked.join(lowest, "root").select("fp", "root", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
             max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each SimHash group: the one with the group's smallest key.

    Rows that repeat that key count as copies; the first by text stays.  Rows with a null key
    are copies where a row of their group has one; else the group's first by text stays.
    """
    fps = stored(fingerprints(docs, key, text, shingle), "simhash")
    named_fps = stored(_named(fps, key, max_bits), "simhash-groups")
    keep = fps.join(named_fps, "fp").where(F.col(key) == F.col("component_id")).select(F.col(key).alias("key")).distinct()
    order = Window.partitionBy("key").orderBy(F.col("row")[text].asc_nulls_first())
    # a row travels as one struct, so no column of docs can clash with the operator's own
    named = (docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.struct(*docs.columns).alias("row"))
             .join(keep, "key", "left_semi")
             .withColumn("copy", F.row_number().over(order)).where("copy = 1")
             .select(*[F.col("row")[c].alias(c) for c in docs.columns]))
    nulls = docs.where(F.col(key).isNull())
    # groups of null keys alone: the first of their different texts, then one row of it
    spelled = fingerprints(nulls.select(F.col(text).alias("text")).distinct(), "text", "text", shingle)
    first = (spelled.join(named_fps.where("component_id IS NULL"), "fp").groupBy("root")
             .agg(F.min(F.struct(F.col("text").isNotNull().alias("given"), F.col("text").alias("text"))).alias("one"))
             .select(F.col("one.text").alias("first")))
    unnamed = (nulls.select(F.col(text).alias("text"), F.struct(*docs.columns).alias("row"))
               .join(first, F.col("text").eqNullSafe(F.col("first")), "left_semi")
               .withColumn("copy", F.row_number().over(Window.partitionBy("text").orderBy(F.xxhash64("row")))).where("copy = 1")
               .select(*[F.col("row")[c].alias(c) for c in docs.columns]))
    return named.unionByName(unnamed)
