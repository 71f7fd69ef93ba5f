"""Tag views: co-occurrence, busy niches (demand per supply), frequency, lift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ludex.config import DEFAULT_FILTERS, MAJOR_NICHE_GENRES, MAJOR_OFFICIAL_GENRES, TEST_FILTERS
from ludex.functions import predicates as P
from ludex.functions.numeric import rnd
from ludex.operators import tags as TG
from ludex.plans.common import LATEST_CCU_SQL, latest_ccu, real_games_sql
from ludex.plans.prelude import rnd as srnd
from ludex.plans.prelude import sql, sql_list
from ludex.plans.registry import register

# Tag names of the synthetic tables standing in for the 15 major genre names.
TEST_MAJOR_TAGS = ["small", "red", "blue", "hot", "ring", "widget", "bolt", "gear", "gizmo"]


def _pairs_sql(limit: int, names: str = "") -> str:
    """Each game's tags as one list; a pair is one of its tags with a later one of the same list."""
    only = f"WHERE tag_id IN (SELECT tag_id FROM tags WHERE lower(tag_name) IN {names})" if names else ""
    return sql(f"""
SELECT named[lower_id] AS tag_a, named[higher_id] AS tag_b, n AS co_occurrences
FROM duos, (SELECT map(list(tag_id), list(tag_name)) AS named FROM tags)
ORDER BY n DESC, tag_a, tag_b LIMIT {limit}""", [
        ("bags", f"SELECT list(tag_id ORDER BY tag_id) AS bag FROM game_tags {only} GROUP BY app_id"),
        ("heads", "SELECT bag[i] AS lower_id, bag[i + 1:] AS rest FROM (SELECT bag, unnest(range(1, len(bag))) AS i FROM bags)"),
        ("duos", "SELECT lower_id, higher_id, count(*) AS n FROM (SELECT lower_id, unnest(rest) AS higher_id FROM heads) GROUP BY ALL")])


def _top_pairs(t, k: int, names=None):
    tag_filter = None
    if names is not None:
        tag_filter = t["tags"].filter(F.lower("tag_name").isin([n.lower() for n in names]))
    p = TG.named_pairs(TG.pair_counts(t["game_tags"], tag_filter=tag_filter), t["tags"])
    return (p.orderBy(F.desc("together"), "tag_a", "tag_b").limit(k)
             .select("tag_a", "tag_b", F.col("together").alias("co_occurrences")))


# Q09 -----------------------------------------------------------------------
@register("tag_pairs", _pairs_sql(20))
def tag_pairs(t, k: int = 20):
    """Tag pairs that occur on the same games most often."""
    return _top_pairs(t, k)


# Q36 -----------------------------------------------------------------------
@register("major_tag_pairs", _pairs_sql(10, sql_list(TEST_MAJOR_TAGS)),
          names=TEST_MAJOR_TAGS)
def major_tag_pairs(t, names=(*MAJOR_OFFICIAL_GENRES, *MAJOR_NICHE_GENRES), k: int = 10):
    """Co-occurrence restricted to a list of names (case-insensitive)."""
    return _top_pairs(t, k, names)


# Q10 / Q11 -------------------------------------------------------------------
def _niches(t, filters, lo, hi, k, nulls_first: bool = False):
    games = t["games"].select("app_id", "name")
    if filters is not None:
        games = P.real_games(games, t, filters)
    ds = TG.demand_supply(t["game_tags"], games, latest_ccu(t))
    df = ds.join(t["tags"], "tag_id").filter(F.col("num_games").between(lo, hi))
    if filters is not None:
        df = df.filter(P.relevant_tag(F.col("tag_name"), filters))
    ratio = F.col("avg_players") / F.nullif(F.col("num_games"), F.lit(0))
    return (df.withColumn("_ratio", ratio)
              .orderBy(F.desc_nulls_first("_ratio") if nulls_first else F.desc_nulls_last("_ratio"), "tag_name")
              .limit(k)
              .select("tag_name", "num_games", rnd(F.col("avg_players"), 1).alias("avg_players"),
                      rnd(F.col("_ratio"), 1).alias("demand_per_supply_ratio")))


def _niches_sql(filtered: bool, k: int, lo: int = 5, hi: int = 100) -> str:
    real = "SEMI JOIN real_games USING (app_id)" if filtered else ""
    relevant = f"WHERE lower(tag_name) NOT IN {sql_list(TEST_FILTERS.non_game_tags)}" if filtered else ""
    # one grouping: games of the tag, those ever counted, their mean
    ctes = [LATEST_CCU_SQL] + ([real_games_sql(TEST_FILTERS)] if filtered else []) + [("niche", f"""
    SELECT tag_id, count(*) AS size, count(snapshot_time) AS counted, avg(concurrent_players) AS mean
    FROM game_tags LEFT JOIN latest_ccu USING (app_id) {real}
    GROUP BY tag_id HAVING size BETWEEN {lo} AND {hi} AND counted > 0""")]
    return sql(f"""
SELECT tag_name, size AS num_games, {srnd('mean', 1)} AS avg_players, {srnd('mean / size', 1)} AS demand_per_supply_ratio
FROM niche JOIN tags USING (tag_id) {relevant}
ORDER BY mean / size DESC NULLS LAST, tag_name LIMIT {k}""", ctes)


@register("busy_niches", _niches_sql(True, 20), filters=TEST_FILTERS)
def busy_niches(t, filters=DEFAULT_FILTERS, lo: int = 5, hi: int = 100, k: int = 20, nulls_first: bool = False):
    """Relevant tags of real games with 5..100 games, by average latest CCU per game.

    Ties and NULL ratios: NULLs last by default (a NULL ratio is not a niche);
    ``nulls_first=True`` gives the reference's Postgres DESC order.  Then tag name."""
    return _niches(t, filters, lo, hi, k, nulls_first)


@register("busy_niches_unfiltered", _niches_sql(False, 12))
def busy_niches_unfiltered(t, lo: int = 5, hi: int = 100, k: int = 12):
    """The same ratio over all games and tags (the tags page)."""
    return _niches(t, None, lo, hi, k)


# Q12 -----------------------------------------------------------------------
@register("tag_frequency", sql("""
SELECT t.tag_name, count(*) AS game_count FROM game_tags gt JOIN tags t ON t.tag_id = gt.tag_id
GROUP BY t.tag_name ORDER BY game_count DESC, t.tag_name LIMIT 20"""))
def tag_frequency(t, k: int = 20):
    """Games per tag."""
    g = t["game_tags"].groupBy("tag_id").agg(F.count(F.lit(1)).alias("game_count"))
    return (g.join(t["tags"], "tag_id").orderBy(F.desc("game_count"), "tag_name").limit(k)
             .select("tag_name", "game_count"))


# Q13 -----------------------------------------------------------------------
@register("tag_lift", sql(f"""
SELECT x.tag_name AS tag_a, y.tag_name AS tag_b, n AS co_occurrences, {srnd('ratio', 2)} AS lift
FROM (SELECT a, b, n, (n * games)::DOUBLE / (ga.size * gb.size) AS ratio
      FROM duos JOIN sizes ga ON ga.tag_id = a JOIN sizes gb ON gb.tag_id = b,
           (SELECT count(*) AS games FROM bags))
JOIN tags x ON x.tag_id = a JOIN tags y ON y.tag_id = b
ORDER BY ratio DESC, n DESC, tag_a, tag_b LIMIT 20""", [
    # every game's tags as one list, its pairs by unnesting the list twice
    ("bags", "SELECT app_id, list(tag_id) AS bag FROM game_tags GROUP BY app_id"),
    ("sizes", "SELECT unnest(bag) AS tag_id, count(*) AS size FROM bags GROUP BY 1"),
    ("duos", """SELECT a, b, count(*) AS n FROM (SELECT a, unnest(bag) AS b FROM (SELECT unnest(bag) AS a, bag FROM bags))
                WHERE a < b GROUP BY a, b HAVING n >= 30""")]))
def tag_lift(t, min_together: int = 30, k: int = 20):
    """Pairs seen together >= ``min_together`` times, by lift over independence."""
    p = TG.named_pairs(TG.lift(t["game_tags"], min_together), t["tags"])
    return (p.orderBy(F.desc("lift"), F.desc("together"), "tag_a", "tag_b").limit(k)
             .select("tag_a", "tag_b", F.col("together").alias("co_occurrences"),
                     rnd(F.col("lift"), 2).alias("lift")))
