"""Connected components of a link graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ludex.session import checkpoint_dir


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("m", "src"))
    return (both.join(low, "src").where("dst > src")
            .select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src != dst").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("src").agg(F.min("dst").alias("m"))
    moved = e.join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src != dst")
    return moved.union(low.select("src", F.col("m").alias("dst"))).distinct()


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first()
    return r.n, r.x


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (src long, dst long; any order, repeats and loops allowed) ->
    (node, root) for every node that isn't the smallest of its component.

    Each round shortens every path to the smallest node, so about log(n) rounds do; each
    round's edges go to the shared checkpoint folder.  Only a count and a checksum of the
    edges reach the driver.  No edges: an empty result.
    """
    checkpoint_dir(edges.sparkSession)
    e = (edges.where("src != dst")
         .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct().checkpoint())
    mark = _mark(e)
    while mark[0]:
        e = _small_star(_large_star(e)).checkpoint()
        before, mark = mark, _mark(e)
        if mark == before:
            break
    return e.select(F.col("src").alias("node"), F.col("dst").alias("root"))
