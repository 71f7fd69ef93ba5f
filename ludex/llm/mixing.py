"""Mixing sources to target weights: blocks of words drawn shard by shard.

Each source's words, in key order, are cut into blocks of ``block_words``.  Every output
shard draws the source of each of its slots, so its source counts are multinomial; a source's
slots are then numbered across the shards and slot t takes the block that the source's
pseudorandom permutation of its blocks gives for t (once through all blocks, then again).
Draws beyond a source's target are void and what is missing comes in a last shard, so every
source meets its target whatever the draw.

All of it is DataFrame expressions; every random choice is a hash of (seed, indices), so
reruns and recomputed partitions agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, parts, stored


def sizes(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, size, mark): size is the number of words (null texts: 0); mark tells rows
    of one key but different texts apart."""
    count = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), count.alias("size"),
                       F.xxhash64(F.col(key), F.col(text)).alias("mark"))


def targets(sized: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, sid, source_size, target): ``share`` of all sizes, by weight, none above
    ``most`` times its source's size.

    Weights repeat over the sources by code point, null last.  With the excess reshared until
    none is above, target = min(most * size, level * weight) for one level; sources sorted by
    size / weight reach their limit in turn, so the level follows from running sums.  The
    windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    limit = F.lit(most) * F.col("source_size")
    ranked = named.withColumn("w", weight).withColumn("limit", limit).withColumn("r", limit / F.col("w"))
    everything = Window.partitionBy(F.lit(0))
    upto = Window.partitionBy(F.lit(0)).orderBy("r", "sid").rowsBetween(Window.unboundedPreceding, -1)
    open_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))
    spent = F.coalesce(F.sum("limit").over(upto), F.lit(0.0))
    level = (F.lit(share) * F.sum("source_size").over(everything) - spent) / open_weight
    # the level is that of the first source, in this order, whose limit isn't below it
    first = F.min(F.when(F.col("r") >= F.col("level"), F.struct("r", "sid", "level"))).over(everything)
    free = ranked.withColumn("level", level).withColumn("level", first["level"])
    return free.select("source", F.col("sid").cast("long").alias("sid"), "source_size",
                       F.least("limit", F.coalesce(F.col("level") * F.col("w"), F.col("limit"))).alias("target"))


def permuted(x: Column, n: Column, *seed) -> Column:
    """Pseudorandom permutation of 0 .. n-1 at x: four rounds of an unbalanced Feistel network
    over a * b >= n cells with a * b - n < a, walked on while the result is n or more.

    A walk leaves [0, n) for at most a * b - n < a steps; where a exceeds the 40 steps tried,
    each step fails with probability below 1 / a, so a walk of 40 doesn't occur in practice;
    the result would still be a block of the source (by pmod), not an error.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def rounds(v):
        left, right = v % a, F.floor(v / a).cast("long")
        for r in (0, 2):
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(r), *seed), a), a)
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(r + 1), *seed), b), b)
        return right * a + left

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(40)), rounds(x),
                         lambda v, _: F.when(v < n, v).otherwise(rounds(v)))
    return F.pmod(walked, n)


def _streams(sized: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """Each row's place in its source's stream of words (rows by key, null keys first).

    A source's rows are dealt to ranges of keys, so no task holds a whole source: places are
    running sums inside a range, plus the sum of the ranges before.
    """
    with_sid = sized.join(target, sized["source"].eqNullSafe(target["source"])).select("key", "mark", "sid", "source_size", "target", "size")
    order = [F.col("key").asc_nulls_first(), F.col("mark")]
    ranged = stored(with_sid.repartitionByRange(buckets, "sid", *order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    inside = Window.partitionBy("sid", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = (ranged.groupBy("sid", "range").agg(F.sum("size").alias("n"))
            .select("sid", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    return (ranged.withColumn("run", F.sum("size").over(inside) - F.col("size"))
            .join(base, ["sid", "range"])
            .select("key", "mark", "sid", "source_size", "target", "size", (F.col("base") + F.col("run")).alias("place")))


def slots(target: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, sid, slot, pass, block, words): the blocks each output shard takes.

    ``words`` bounds what the slot may take: the last one of a source gives only what its
    target still lacks.
    """
    spark = target.sparkSession
    src = (target.where("source_size > 0 and target >= 1")
           .withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
           .withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
           # whole passes take source_size words, the rest comes block by block
           .withColumn("passes", F.floor(F.col("goal") / F.col("source_size")).cast("long"))
           .withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
           .withColumn("need", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block_words).cast("long")))
    # each source owns a stretch of [0, 1) in proportion to its slots; a grid finds it by an equi-join
    everything = Window.partitionBy(F.lit(0))
    upto = Window.partitionBy(F.lit(0)).orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = 16 * (F.count(F.lit(1)).over(everything) + 16)
    src = stored(src.withColumn("total", F.sum("need").over(everything))
                 .withColumn("hi", F.sum("need").over(upto)).withColumn("lo", F.col("hi") - F.col("need"))
                 .withColumn("cells", cells), "mix-sources")
    grid = src.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") / F.col("total") * F.col("cells")), F.floor(F.col("hi") / F.col("total") * F.col("cells")))))
    head = src.agg(F.max("total").alias("total"), F.max("cells").alias("cells")).first()
    total, n_cells = head["total"] or 1, head["cells"] or 1
    shards = -(-(head["total"] or 0) // shard_slots)
    drawn = (spark.range(shards, numPartitions=parts(spark)).withColumnRenamed("id", "shard")
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.least(F.lit(shard_slots), F.lit(total) - F.col("shard") * shard_slots).cast("int") - 1)))
             .withColumn("u", F.pmod(F.xxhash64(F.lit(seed), "shard", "i"), F.lit(total)))
             .withColumn("cell", F.floor(F.col("u") / F.lit(total) * n_cells))
             .join(grid.select("cell", "sid", "lo", "hi"), "cell").where("u >= lo and u < hi")
             .groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n")))
    run = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = drawn.withColumn("end", F.sum("n").over(run)).withColumn("begin", F.col("end") - F.col("n")).drop("n")
    got = drawn.groupBy("sid").agg(F.sum("n").alias("begin"))
    # what the draws leave open is dealt to closing shards of the usual size
    lacking = (src.join(got, "sid", "left").withColumn("begin", F.coalesce("begin", F.lit(0)))
               .where("begin < need").select("sid", "begin", "need")
               .withColumn("begin", F.explode(F.expr(f"sequence(begin, need - 1, {shard_slots}L)")))
               .select((F.lit(shards) + F.floor(F.col("begin") / shard_slots)).alias("shard"), "sid",
                       F.least("need", F.col("begin") + shard_slots).alias("end"), "begin"))
    counts = numbered.unionByName(lacking)
    each = (counts.join(src, "sid").withColumn("end", F.least("end", "need")).where("begin < end")
            .withColumn("slot", F.explode(F.sequence(F.col("begin"), F.col("end") - 1))))
    epoch = F.floor(F.col("slot") / F.col("blocks")).cast("long")
    bound = F.when((F.col("slot") == F.col("need") - 1) & (F.col("rest") > 0),
                   F.col("rest") - (F.col("need") - 1 - F.col("passes") * F.col("blocks")) * block_words).otherwise(F.lit(block_words))
    return each.select("shard", "sid", "slot", epoch.alias("pass"),
                       permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("sid"), epoch).alias("block"),
                       bound.cast("long").alias("words"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, block_words: int = 128,
        shard_slots: int = 4096, seed: int = 23) -> tuple[DataFrame, DataFrame]:
    """(placed, spans).  ``placed``: every row as (key, mark, sid, source_size, target, size,
    place).  ``spans``: the mix, as (shard, sid, slot, pass, place, key, mark, size, from_word,
    n_words): the words each slot takes from each row of ``size``; ``from_word`` counts from 0.

    Every word is in one block of its source; a pass takes every block once, so no row gives
    more than ceil(target / source_size) <= 2 times its words.  Taken words differ from the
    target by less than a block (only where the source's short last block is in the last pass).

    Null and blank texts have size 0 and give nothing, as do sources of size 0 (target 0).
    Null sources are one source, sorted last.  Repeated rows are rows of their own; null keys
    come first.  Other columns aren't read.  An empty table gives empty results.
    """
    sized = stored(sizes(docs, key, text, source), "mix-sizes")
    target = stored(targets(sized, weights, share, most), "mix-targets")
    placed = stored(_streams(sized, target, 4 * parts(docs.sparkSession)), "mix-places")
    chosen = slots(target, block_words, shard_slots, seed)
    first = F.floor(F.col("place") / block_words)
    last = F.floor((F.col("place") + F.col("size") - 1) / block_words)
    blocks = (placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
              .withColumn("lo", F.greatest(F.col("place"), F.col("block") * block_words))
              .withColumn("hi", F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * block_words)))
    spans = (chosen.join(blocks, ["sid", "block"])
             .withColumn("hi", F.least(F.col("hi"), F.col("block") * block_words + F.col("words")))
             .where("hi > lo")
             .select("shard", "sid", "slot", "pass", "place", "key", "mark", "size", (F.col("lo") - F.col("place")).alias("from_word"),
                     (F.col("hi") - F.col("lo")).alias("n_words")))
    return placed, spans


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """(key, size, source_size, target, taken) for every row; ``taken``: words the mix takes
    from it, repeats counted."""
    placed, spans = mix(docs, key, text, source, **options)
    # a row with words is known by its place in its source
    counted = spans.groupBy("sid", "place").agg(F.sum("n_words").alias("taken"))
    full = placed.where("size > 0").join(counted, ["sid", "place"], "left")
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = [F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return full.select(*cols).unionByName(none.select(*cols))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as documents: one row per row of ``docs`` and pass that takes words from it.

    The text is what the pass takes of the document's words, in their order and with the
    white space that follows them; of a row taken whole only leading white space goes.  The
    other columns stay; ``n_chars``, where there is one, is counted anew.  Rows of one key and
    one text share the first one's other columns.
    """
    _, spans = mix(docs, key, text, source, **options)
    cut = (spans.groupBy("mark", "place", "sid", "pass")
           .agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("_cuts"),
                (F.sum("n_words") == F.max("size")).alias("_whole"))
           .select("mark", "_cuts", "_whole"))
    # a row travels as one struct, so no column of docs can clash with the operator's own
    marked = (docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col(key), F.col(text)).alias("mark"))
              .dropDuplicates(["mark"]))
    clean = F.regexp_replace(F.col("row")[text], r"^[\x20\x09-\x0D]+", "")
    words = F.split(clean, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    # the outer transform binds the words to a variable: the text is split once, not once a cut
    pieces = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("_cuts", lambda c: F.slice(
        w, (c["from_word"] + 1).cast("int"), c["n_words"].cast("int")))), ""))[0]
    # a row taken whole needs no split
    out = marked.join(cut, "mark").withColumn("kept", F.when(F.col("_whole"), clean).otherwise(pieces))
    changed = {text: F.col("kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
