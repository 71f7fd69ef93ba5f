"""Hard-negative mining by inner product over STR-packed R-trees.

Rows are sorted by label and the coordinate of widest spread (a range partitioning) and cut into
shards of bounded size.  In a shard, sort-tile-recursive packing slices the rows by the next
coordinates in turn down to leaves of ``LEAF`` rows; ``FAN`` nodes are joined to a parent.  A
node keeps the minimum bounding box of its vectors, per coordinate, and its range of labels.

A box bounds the inner product with an anchor q from both sides: each coordinate adds q * low or
q * high.  An anchor's search goes best first: a queue holds the nodes by their upper bound; a node
is left out if its labels can't take part, if its interval lies outside every score window, or if
its upper bound is strictly below the k-th score found so far in every window it could serve
(equal bounds are followed, as ties go to the smaller id).  Nothing else is left out, so results are exact.

Anchors are a stated set of rows.  Shards are dealt to cells of about ``SHARD_ROWS`` rows (small
shards share one), and a block of anchors meets a cell in one task, which packs the cell's tree:
for positives the cells that hold their label, for negatives all.  At most k rows an anchor
(and positive) leave it, of which Spark takes the first k.

Defined cases: rows with a null id, label or vector, or a null component, take no part.  An id
counts once: of rows that share one, the smallest (label, vector).  Vectors of different lengths
are compared over the longer, the shorter one padded with zeros.  An anchor without another row of its
label, and a positive without a row in its window, give no rows.  An empty table gives none.
Components are integers of magnitude below 2^24 (else an error), so all sums are exact in doubles
up to 2^53 / 2^48 = 32 such coordinates, and for the usual small ones at any width.
Columns other than id, label and vector aren't read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

LEAF, FAN = 32, 16
#: Rows of a shard and of a block of anchors: what one task holds.
SHARD_ROWS, BLOCK_ROWS = 8192, 4096


def _str_order(vectors: np.ndarray, labels: np.ndarray, axes: np.ndarray, size: int) -> np.ndarray:
    """Sort-tile-recursive order: each slice along one axis is tiled along the next ones, down to leaves."""
    out: list[np.ndarray] = []

    def tile(rows, at):
        leaves = -(-len(rows) // size)
        if leaves <= 1 or at >= len(axes):
            out.append(rows)
            return
        # as many slices on this axis as on each of those left, two at least
        slices = max(2, round(leaves ** (1 / (len(axes) - at))))
        step = -(-leaves // slices) * size
        rows = rows[np.argsort(vectors[rows, axes[at]], kind="stable")]
        for i in range(0, len(rows), step):
            tile(rows[i:i + step], at + 1)

    # label first: a leaf holds few labels, so their ranges prune too
    by_label = np.argsort(labels, kind="stable")
    bounds = np.flatnonzero(np.diff(labels[by_label])) + 1
    runs, held = [], []
    for run in np.split(by_label, bounds):
        if len(run) >= size:
            runs.append(run)
        else:
            held.append(run)
    for run in runs:
        tile(run, 0)
    if held:  # labels of less than a leaf share theirs
        out.append(np.concatenate(held))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Tree:
    """An STR-packed R-tree over one shard.

    Nodes are numbered level by level, leaves first; ``first[i]:last[i]`` are a leaf's rows or a
    node's children.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        axes = np.argsort(-vectors.var(axis=0), kind="stable") if len(ids) else np.zeros(0, np.int64)
        order = _str_order(vectors, labels, axes, LEAF)
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        starts = np.arange(0, len(ids), LEAF)
        ends = np.minimum(starts + LEAF, len(ids))
        low, high = np.minimum.reduceat(self.vectors, starts), np.maximum.reduceat(self.vectors, starts)
        small, large = np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts)
        levels = [(starts, ends, low, high, small, large)]
        self.leaves, at = len(starts), 0
        while len(starts) > 1:
            cut = np.arange(0, len(starts), FAN)
            ends = np.minimum(cut + FAN, len(starts)) + at
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            small, large = np.minimum.reduceat(small, cut), np.maximum.reduceat(large, cut)
            at, starts = at + len(starts), cut
            levels.append((cut + at - (len(levels[-1][0])), ends, low, high, small, large))
        self.first, self.last, self.low, self.high, self.small, self.large = (
            np.concatenate([lv[i] for lv in levels]) for i in range(6))

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the inner product of every anchor with every node's rows."""
        up, down = np.maximum(anchors, 0.0), np.minimum(anchors, 0.0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def search(self, anchor, own_id, label, same: bool, windows, k: int, low, high):
        """The first k rows of every window [least, most], best first.

        ``low`` and ``high`` are the nodes' bounds.  Returns, a window, [(score, id)] in order,
        and the number of leaves that were read.
        """
        found: list[list] = [[] for _ in windows]  # heaps of (score, -id): the worst on top
        root = len(self.first) - 1
        queue, read = [(-high[root], root)], 0
        while queue:
            bound, node = heapq.heappop(queue)
            bound = -bound
            open_ = [j for j, (least, most) in enumerate(windows)
                     if bound >= (found[j][0][0] if len(found[j]) == k else least) and bound >= least and low[node] <= most]
            if not open_:
                if all(bound < least or (len(f) == k and bound < f[0][0]) for (least, _), f in zip(windows, found)):
                    break  # every node left has a lower bound still
                continue
            if same and not self.small[node] <= label <= self.large[node] or (
                    not same and self.small[node] == label == self.large[node]):
                continue
            first, last = self.first[node], self.last[node]
            if node >= self.leaves:
                for child in range(first, last):
                    heapq.heappush(queue, (-high[child], child))
                continue
            read += 1
            scores = self.vectors[first:last] @ anchor
            fits = (self.labels[first:last] == label) == same
            if same:
                fits &= self.ids[first:last] != own_id
            for j in open_:
                least, most = windows[j]
                heap = found[j]
                floor = max(least, heap[0][0]) if len(heap) == k else least
                for i in np.flatnonzero(fits & (scores >= floor) & (scores <= most)):
                    row = (scores[i], -int(self.ids[first + i]))
                    if len(heap) < k:
                        heapq.heappush(heap, row)
                    elif row > heap[0]:
                        heapq.heapreplace(heap, row)
        return [[(int(s), -i) for s, i in sorted(heap, reverse=True)] for heap in found], read


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as doubles, padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and max(abs(int(flat.min())), abs(int(flat.max()))) >= 1 << 24:
        raise ValueError("vector components must be integers below 2^24")
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _prepared(rows: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """One row an id: (id, label, vec), without nulls."""
    vec = F.col(vec_col).cast("array<bigint>")
    return (rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), vec.alias("vec"))
            .where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL)")
            .groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.label", "r.vec"))


def _widest(rows: DataFrame, width: int) -> int:
    """The coordinate of largest variance: a row a task and coordinate is all that is shuffled."""
    def sums(batches):
        n, total, square = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            v = _matrix(batch.column("vec"), width)
            n, total, square = n + len(v), total + v.sum(axis=0), square + (v * v).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width)), pa.array([n] * width, pa.int64()), pa.array(total), pa.array(square)], names=["axis", "n", "s", "q"])

    each = rows.select("vec").mapInArrow(sums, "axis long, n long, s double, q double").groupBy("axis").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    top = each.where("n > 0").orderBy(F.desc(F.expr("q / n - (s / n) * (s / n)")), "axis").first()
    return top["axis"] if top else 0


def packed(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Shards of (id, label, vec) rows: (shard, width, labels, ids, row_labels, vectors).

    Rows are range-partitioned by label and the coordinate of widest spread, then id, so that
    equal vectors spread too; a partition is cut into shards of at most ``shard_rows`` rows.
    ``labels`` are the distinct labels of the shard.
    """
    n, width = rows.agg(F.count(F.lit(1)), F.greatest(F.max(F.size("vec")), F.lit(1))).first()
    axis = _widest(rows, width or 1)
    order = ["label", F.coalesce(F.get("vec", F.lit(axis)), F.lit(0)), "id"]
    parts = max(1, -(-n // shard_rows))

    def cut(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def shard(table):
            labels = table.column("label").to_numpy()
            lists = lambda v: pa.array([v], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([width], pa.int32()), lists(np.unique(labels)), lists(table.column("id").to_numpy()), lists(labels),
                 pa.array([_matrix(table.column("vec"), width).astype("<i4").tobytes()], pa.binary())],
                names=["shard", "width", "labels", "ids", "row_labels", "vectors"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            while size >= shard_rows:
                whole = pa.concat_tables(held)
                yield shard(whole.slice(0, shard_rows))
                held, size, number = [whole.slice(shard_rows)], size - shard_rows, number + 1
        if size:
            yield shard(pa.concat_tables(held))

    return (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .mapInArrow(cut, "shard long, width int, labels array<bigint>, ids array<bigint>, row_labels array<bigint>, vectors binary"))


def _searched(anchors: DataFrame, shards: DataFrame, same: bool, k: int, low_pct: int, high_pct: int) -> DataFrame:
    """The first k rows of every pair of a block of anchors and a cell, for each anchor (and positive).

    ``anchors`` are (of_block, to_cell, id, label, vec, positives), a row for each cell that an
    anchor meets; ``shards`` have a row for each ``block`` that their ``cell`` meets.
    """
    out = "anchor_id long, label long, positive_id long, positive_score long, id long, score long"

    def meet(left, right):
        width = right.column("width")[0].as_py()
        ids, labels = (np.concatenate([x.values.to_numpy() for x in right.column(c)]) for c in ("ids", "row_labels"))
        whole = b"".join(x.as_py() for x in right.column("vectors"))
        tree = Tree(ids, labels, np.frombuffer(whole, "<i4").reshape(len(ids), width).astype(np.float64))
        vectors = _matrix(left.column("vec"), width)
        rows = []
        for at in range(0, len(vectors), 256):  # bounds of a few anchors at a time
            some = vectors[at:at + 256]
            low, high = tree.intervals(some)
            part = left.slice(at, 256)
            for q, own, label, positives, lo, hi in zip(
                    some, part.column("id").to_pylist(), part.column("label").to_pylist(), part.column("positives").to_pylist(), low, high):
                if same:
                    (best,), _ = tree.search(q, own, label, True, [(-np.inf, np.inf)], k, lo, hi)
                    rows += [(own, label, None, None, i, s) for s, i in best]
                else:
                    windows = [(-(-low_pct * p["score"] // 100), high_pct * p["score"] // 100) for p in positives]
                    for p, best in zip(positives, tree.search(q, own, label, False, windows, k, lo, hi)[0]):
                        rows += [(own, label, p["id"], p["score"], i, s) for s, i in best]
        names = ["anchor_id", "label", "positive_id", "positive_score", "id", "score"]
        cols = list(zip(*rows)) or [()] * 6
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=names)

    def met(key, left, right):
        # a pair whose other side is empty has nothing to give
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 6, names=["anchor_id", "label", "positive_id", "positive_score", "id", "score"])
        return meet(left, right)

    return anchors.groupBy("of_block", "to_cell").cogroup(shards.groupBy("block", "cell")).applyInArrow(met, out)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, k: int = 10, low_pct: int = 30, high_pct: int = 90,
                   id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
                   shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The first ``k`` rows of other labels in the score window of each anchor's positives.

    ``rows`` hold integer vectors; ``anchors`` is a condition on the column ``id``.  An anchor's
    positives are its first ``positives`` other rows of its label by inner product.  A negative n
    of a positive p has low_pct * p <= 100 * n <= high_pct * p.  Higher scores come first, ties by
    smaller id.  Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).
    """
    data = stored(_prepared(rows, id_col, label_col, vec_col), "rtree-rows")
    shards = stored(packed(data, shard_rows), "rtree-shards")
    n_cells = shards.agg(F.greatest(F.ceil(F.sum(F.size("ids")) / shard_rows), F.lit(1)).cast("bigint").alias("n")).scalar()
    shards = shards.withColumn("_n", n_cells).withColumn("cell", F.pmod(F.xxhash64("shard"), F.col("_n"))).drop("_n", "shard")
    chosen = data.where(anchors)
    n_blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block_rows).cast("int"), F.lit(1))
    n_blocks = chosen.agg(n_blocks.alias("n")).scalar()
    chosen = chosen.withColumn("_n", n_blocks).withColumn("of_block", F.pmod(F.xxhash64("id"), F.col("_n").cast("bigint"))).drop("_n")
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))

    # positives: anchors meet the cells that hold their label
    holders = shards.select(F.col("cell").alias("to_cell"), F.explode("labels").alias("label")).distinct()
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>")
    met = chosen.join(holders, "label").withColumn("positives", none)
    wanted = met.select(F.col("of_block").alias("block"), F.col("to_cell").alias("cell")).distinct()
    best = _first(_searched(met, shards.join(wanted, "cell"), True, positives, low_pct, high_pct), ["anchor_id"], positives)
    held = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p")).select(
        F.col("anchor_id").alias("id"), F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("positives"))

    # negatives: the stated anchors against all rows, block by block
    asked = stored(chosen.join(held, "id"), "rtree-anchors")
    spots = (shards.select(F.col("cell").alias("to_cell")).distinct().withColumn("_n", n_blocks)
             .select("to_cell", numbers.alias("of_block")))
    all_shards = shards.withColumn("_n", n_blocks).withColumn("block", numbers).drop("_n")
    found = _first(_searched(asked.join(spots, "of_block"), all_shards, False, k, low_pct, high_pct), ["anchor_id", "positive_id"], k)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                        "positive_score", F.col("score").alias("negative_score"))


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key, of at most k a shard."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
