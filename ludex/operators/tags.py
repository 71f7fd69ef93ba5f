"""Tag operators: co-occurrence pairs (J5), lift (A16), demand per supply.

Pairs come from an equi self-join of the bridge on app_id with
``tag_a < tag_b``.  The output is pair *counts*, aggregated with partial
aggregation right after the join.  Work per game is quadratic in that game's
tag count, which the store bounds (a few dozen user tags per game).  The join
key is app_id, so one game with very many rows would land in one task;
AQE's skew-join handling splits such a partition (the other side of the
partition is replicated).  ``min_count`` pre-filters tags that cannot reach
the threshold (a pair is never more frequent than its rarer tag) before the
join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_counts(game_tags: DataFrame, min_count: int = 0, tag_filter: DataFrame | None = None) -> DataFrame:
    """(tag_a_id, tag_b_id, together) over unordered pairs with tag_a_id < tag_b_id."""
    gt = game_tags.select("app_id", "tag_id")
    if tag_filter is not None:
        gt = gt.join(tag_filter.select("tag_id"), "tag_id", "left_semi")
    if min_count > 0:
        freq = gt.groupBy("tag_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_count)
        gt = gt.join(freq.select("tag_id"), "tag_id", "left_semi")
    a = gt.select("app_id", F.col("tag_id").alias("tag_a_id"))
    b = gt.select("app_id", F.col("tag_id").alias("tag_b_id"))
    pairs = a.join(b, "app_id").filter(F.col("tag_a_id") < F.col("tag_b_id"))
    out = pairs.groupBy("tag_a_id", "tag_b_id").agg(F.count(F.lit(1)).alias("together"))
    return out.filter(F.col("together") >= min_count) if min_count > 0 else out


def named_pairs(pairs: DataFrame, tags: DataFrame) -> DataFrame:
    ta = tags.select(F.col("tag_id").alias("tag_a_id"), F.col("tag_name").alias("tag_a"))
    tb = tags.select(F.col("tag_id").alias("tag_b_id"), F.col("tag_name").alias("tag_b"))
    return pairs.join(ta, "tag_a_id").join(tb, "tag_b_id")


def lift(game_tags: DataFrame, min_together: int) -> DataFrame:
    """(tag_a_id, tag_b_id, together, lift) with lift = together * N / (nA * nB)
    (whole numbers up to one division, so equal lifts are equal doubles).

    N (games with any tag) is a scalar sub-query: distinct app ids are found
    with a shuffle on app_id, then counted -- never a single-task distinct."""
    freq = game_tags.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))
    n_games = game_tags.select("app_id").distinct().agg(F.count(F.lit(1))).scalar()
    p = pair_counts(game_tags, min_together)
    fa = freq.select(F.col("tag_id").alias("tag_a_id"), F.col("n").alias("na"))
    fb = freq.select(F.col("tag_id").alias("tag_b_id"), F.col("n").alias("nb"))
    p = p.join(fa, "tag_a_id").join(fb, "tag_b_id")
    return p.withColumn("lift", (F.col("together") * n_games).cast("double") / (F.col("na") * F.col("nb")).cast("double"))


def demand_supply(game_tags: DataFrame, games: DataFrame, latest: DataFrame, value: str = "concurrent_players") -> DataFrame:
    """Per tag over ``games`` (already filtered): num_games (supply) and avg latest value (demand)."""
    gt = game_tags.join(games.select("app_id"), "app_id", "left_semi")
    supply = gt.groupBy("tag_id").agg(F.count(F.lit(1)).alias("num_games"))
    demand = gt.join(latest.select("app_id", value), "app_id").groupBy("tag_id") \
               .agg(F.avg(value).alias("avg_players"))
    return supply.join(demand, "tag_id")
