"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces are dealt to demes of bounded size.  Each deme is evolved on several islands (separate
tasks): a crossover injects whole well-filled bins of one parent into the other, removes the
bins that hold the same pieces, and best-fits the displaced pieces, largest first.  Between
epochs each island's elite moves on to the next island of its deme.  Bins that the best
solution leaves badly filled are dissolved and their pieces packed again among those of other
demes, so the loss at the edge of a deme is paid once, not once for each deme.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, stored
from .encoding import encoder


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
           capacity: int = 2048, end: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32): each document's ids, closed by ``end``, cut
    into runs of ``capacity`` where it is longer.  Null texts are empty."""
    def run(batches):
        enc = encoder(tokenizer)
        tail = np.array([end], np.uint32)
        for b in batches:
            keys = b.column("k").to_pylist()
            out = [[], [], [], [], []]
            for d, t in zip(keys, b.column("t")):
                ids = np.concatenate([enc(t.as_py()), tail]).astype("<u4")
                for p, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s:s + capacity]
                    for col, v in zip(out, (d, p, s, len(part), zlib.crc32(part.tobytes()))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], b.schema.field("k").type), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])],
                names=[key, "piece", "start", "length", "ids_crc32"])
        enc.forget()

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), run,
                     f"{key} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(items, sizes, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Put items, in the given order, into the fullest bin with room; open bins as needed."""
    room = sorted((capacity - sum(sizes[i] for i in b), n) for n, b in enumerate(bins))
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            left, n = capacity - sizes[i], len(bins) - 1
        else:
            left, n = room.pop(at)
            bins[n].append(i)
            left -= sizes[i]
        if left:
            insort(room, (left, n))
    return bins


def fitness(bins, sizes, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean of the squared fills (uneven fills leave useful room)."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(len(bins), 1)


def cross(a, b, sizes, capacity: int, rng: random.Random) -> list[list[int]]:
    """Child of a and b: a random half of b's best-filled bins goes whole into a."""
    full = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    injected = [x for x in full[:max(1, len(full) // 2)] if rng.random() < 0.5]
    taken = {i for x in injected for i in x}
    kept = [x for x in a if taken.isdisjoint(x)]
    # the emptiest bins are dissolved too, so the displaced pieces can meet theirs
    kept.sort(key=lambda x: -sum(sizes[i] for i in x))
    kept = kept[:len(kept) - len(kept) // 20]
    have = taken.union(*kept) if kept else taken
    rest = sorted((i for i in range(len(sizes)) if i not in have), key=lambda i: -sizes[i])
    return best_fit(rest, sizes, [list(x) for x in injected + kept], capacity)


def evolve(sizes: list[int], capacity: int, seed: int, size: int, generations: int, immigrants=()) -> list[list[int]]:
    """The elite after some generations; immigrants join the first population."""
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    people = [list(map(list, x)) for x in immigrants] or [best_fit(order, sizes, [], capacity)]
    while len(people) < size:
        noisy = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + 0.1 * rng.random()))
        people.append(best_fit(noisy, sizes, [], capacity))
    ranked = sorted(((fitness(p, sizes, capacity), n, p) for n, p in enumerate(people)), reverse=True)
    least = -(-sum(sizes) // capacity)
    for g in range(generations):
        if -ranked[0][0][0] <= least:
            break
        a, b = rng.sample(ranked[:max(2, size // 2)], 2) if len(ranked) > 1 else (ranked[0], ranked[0])
        child = cross(a[2], b[2], sizes, capacity, rng)
        ranked = sorted([*ranked[:size - 1], (fitness(child, sizes, capacity), size + g, child)], reverse=True)
    return ranked[0][2]


def _bins(assignment: bytes) -> list[list[int]]:
    of = np.frombuffer(assignment, np.int32)
    bins: list[list[int]] = [[] for _ in range(int(of.max()) + 1)] if len(of) else []
    for i, b in enumerate(of.tolist()):
        bins[b].append(i)
    return bins


def _assignment(bins, n: int) -> bytes:
    of = np.zeros(n, np.int32)
    for b, items in enumerate(bins):
        of[items] = b
    return of.tobytes()


_PIECE = ["key", "piece", "start", "length", "ids_crc32"]


def _pack(items: DataFrame, level: int, capacity: int, islands: int, epochs: int, population: int,
          generations: int, seed: int) -> DataFrame:
    """items (deme, rid, length, ...; rid numbers the rows) -> the same with bin, offset, fill."""
    state = "deme bigint, island int, sizes binary, elite binary, bins int, fit double"

    def row(deme, island, sizes, bins):
        count, fit = fitness(bins, sizes, capacity)
        return pd.DataFrame({"deme": [deme], "island": [island], "sizes": [np.array(sizes, np.int64).tobytes()],
                             "elite": [_assignment(bins, len(sizes))], "bins": [-count], "fit": [fit]})

    def first(key, pdf):
        sizes = pdf.sort_values("rid")["length"].tolist()
        deme, island = int(key[0]), int(key[1])
        return row(deme, island, sizes, evolve(sizes, capacity, hash((seed, level, deme, island, 0)), population, generations))

    def further(epoch):
        def run(frames):
            for pdf in frames:
                for r in pdf.itertuples():  # one row is a whole deme on an island
                    sizes = np.frombuffer(r.sizes, np.int64).tolist()
                    guests = [_bins(x) for x in dict.fromkeys((r.elite, r.guest))]
                    yield row(r.deme, r.island, sizes, evolve(
                        sizes, capacity, hash((seed, level, r.deme, r.island, epoch)), population, generations, guests))
        return run

    dealt = items.select("deme", "rid", "length").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    now = stored(dealt.groupBy("deme", "island").applyInPandas(first, state), "packing-elites")
    for epoch in range(1, epochs):
        guest = now.select("deme", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("elite").alias("guest"))
        now = stored(now.join(guest, ["deme", "island"]).select("deme", "island", "sizes", "elite", "guest")
                     .mapInPandas(further(epoch), state), "packing-elites")
    best = now.groupBy("deme").agg(F.max_by("elite", F.struct(-F.col("bins"), "fit", -F.col("island"))).alias("elite"))

    def place(mine: pa.Table, elite: pa.Table) -> pa.Table:
        mine = mine.sort_by("rid")
        of = np.frombuffer(elite.column("elite")[0].as_py(), np.int32)
        size = mine.column("length").to_numpy()
        order = np.argsort(of, kind="stable")
        run = np.cumsum(size[order]) - size[order]
        starts = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
        offset = np.empty(len(of), np.int64)
        offset[order] = run - np.repeat(run[starts], np.diff(np.r_[starts, len(of)]))
        fill = np.bincount(of, weights=size).astype(np.int64)[of]
        for name, col in (("bin", pa.array(of, pa.int32())), ("offset", pa.array(offset)), ("fill", pa.array(fill))):
            mine = mine.append_column(name, col)
        return mine

    kinds = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in items.columns)
    return (items.groupBy("deme").cogroup(best.groupBy("deme"))
            .applyInArrow(place, f"{kinds}, bin int, offset bigint, fill bigint"))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0,
         deme: int = 4096, islands: int = 2, epochs: int = 2, population: int = 5, generations: int = 6,
         well_filled: float = 0.98, levels: int = 3, seed: int = 11) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for every piece.

    Documents of at most ``capacity`` ids stay whole; longer ones are cut into full pieces and
    a rest.  A full piece is a sequence of its own; the others are packed by the genetic
    algorithm in up to ``levels`` rounds, each over the pieces of bins filled below
    ``well_filled`` in the round before.

    Null and empty texts are the end id alone; repeated rows and null keys are pieces like any
    other; other columns aren't read.  An empty table gives an empty result.
    """
    cut = stored(pieces(docs, tokenizer, key, text, capacity, end).withColumnRenamed(key, "key"), "packing-pieces")
    full = cut.where(F.col("length") == capacity)
    # one number a full piece: its place in the stored table, in a range of its own
    done = [full.withColumn("sequence_id", F.monotonically_increasing_id().bitwiseOR(F.lit(1 << 62))).withColumn("offset", F.lit(0).cast("long"))]
    left = cut.where(F.col("length") < capacity)
    for level in range(levels):
        n = left.count()
        if not n:
            break
        demes = -(-n // deme)
        dealt = stored(left.select(*_PIECE).withColumn("rid", F.monotonically_increasing_id())
                       .withColumn("deme", F.pmod(F.xxhash64("rid"), F.lit(demes)).cast("long")), "packing-demes")
        packed = stored(_pack(dealt, level, capacity, islands, epochs, population, generations, seed), "packing-placed")
        last = level == levels - 1 or demes == 1
        good = packed if last else packed.where(F.col("fill") >= well_filled * capacity)
        number = F.shiftleft(F.lit(level).cast("long"), 58).bitwiseOR(F.shiftleft("deme", 24)).bitwiseOR(F.col("bin").cast("long"))
        done.append(good.withColumn("sequence_id", number))
        if last:
            break
        left = packed.where(F.col("fill") < well_filled * capacity)
    out = done[0]
    cols = [*_PIECE, "sequence_id", "offset"]
    out = out.select(*cols)
    for d in done[1:]:
        out = out.unionByName(d.select(*cols))
    return out.withColumnRenamed("key", key)
