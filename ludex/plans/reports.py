"""Report pages: dicts of lazy DataFrames per dashboard page, long (chart)
forms, nested per-category lists, and a JSON writer (K13, C22, C23, A14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludex.functions.numeric import rnd
from ludex.plans import categories as C
from ludex.plans import market as M
from ludex.plans import reviews as R
from ludex.plans import series as S
from ludex.plans import tags as TG
from ludex.plans.prelude import rnd as srnd
from ludex.plans.prelude import sql
from ludex.plans.registry import register


# C23 / C22 -----------------------------------------------------------------
def _tier_sql(tier: str, games: str, other: str, ccu: str, other_ccu: str, with_ccu: str) -> str:
    share = f"CASE WHEN ({games} + {other}) <> 0 THEN {srnd(f'100.0 * {games} / ({games} + {other})', 2)} ELSE 0.0 END"
    ccu_share = (f"CASE WHEN ({ccu} + {other_ccu}) <> 0 THEN {srnd(f'100.0 * {ccu} / ({ccu} + {other_ccu})', 2)} "
                 f"ELSE 0.0 END")
    return (f"SELECT '{tier}' AS tier, {games} AS games, {ccu} AS ccu, {with_ccu} AS games_with_ccu, "
            f"{share} AS game_share_pct, 100.0 - {share} AS other_share_pct, {ccu_share} AS ccu_share_pct FROM totals")


@register("free_paid_long", sql(
    _tier_sql("free", "free_games", "paid_games", "free_ccu", "paid_ccu", "free_with_ccu") + "\nUNION ALL\n"
    + _tier_sql("paid", "paid_games", "free_games", "paid_ccu", "free_ccu", "paid_with_ccu"),
    M.TOTALS_SQL))
def free_paid_long(t):
    """Free/paid totals as one row per tier (chart form): games, CCU, shares and
    the complement share (100 - pct)."""
    w = M.free_paid_totals(t)

    def tier(name, g, o, c, oc, wc):
        share = F.when(F.col(g) + F.col(o) != 0,
                       rnd(F.lit(100.0) * F.col(g) / (F.col(g) + F.col(o)), 2)).otherwise(F.lit(0.0))
        cshare = F.when(F.col(c) + F.col(oc) != 0,
                        rnd(F.lit(100.0) * F.col(c) / (F.col(c) + F.col(oc)), 2)).otherwise(F.lit(0.0))
        return F.struct(F.col(g).alias("games"), F.col(c).alias("ccu"), F.col(wc).alias("games_with_ccu"),
                        share.alias("game_share_pct"), (F.lit(100.0) - share).alias("other_share_pct"),
                        cshare.alias("ccu_share_pct")).alias(name)
    wide = w.select(tier("free", "free_games", "paid_games", "free_ccu", "paid_ccu", "free_with_ccu"),
                    tier("paid", "paid_games", "free_games", "paid_ccu", "free_ccu", "paid_with_ccu"))
    long = wide.unpivot([], ["free", "paid"], "tier", "v")
    return long.select("tier", "v.*")


# A14 -----------------------------------------------------------------------
@register("top_by_genre_nested", f"""
SELECT tag_name, string_agg(rn || ':' || app_id || ':' || name || ':' || concurrent_players || ':' || owners_estimate
                            || ':' || COALESCE(CAST(is_free AS VARCHAR), '?'), '; ' ORDER BY rn) AS games
FROM ({C._ranked_sql("genre", False)}) GROUP BY tag_name""", **C._GENRES)
def top_by_genre_line(t, k: int = 10, **args):
    """The nested lists as one line per genre, in rank order."""
    parts = F.transform("games", lambda g: F.concat_ws(":", g["rn"], g["app_id"], g["name"], g["concurrent_players"],
                                                       g["owners_estimate"], F.coalesce(g["is_free"].cast("string"), F.lit("?"))))
    return top_by_genre_nested(t, k, **args).select("tag_name", F.array_join(parts, "; ").alias("games"))


def top_by_genre_nested(t, k: int = 10, **args):
    """Per genre one row with its top ``k`` games as an ordered list of structs
    (the keyed object of the category page).  Lists hold at most ``k`` rows."""
    r = C.top_by_genre(t, k=k, **args)
    return r.groupBy("tag_name").agg(F.sort_array(F.collect_list(
        F.struct("rn", "app_id", "name", "concurrent_players", "owners_estimate", "is_free"))).alias("games"))


# K13 -----------------------------------------------------------------------
def analysis_page(t) -> dict[str, DataFrame]:
    """The analysis page as lazy frames (share intermediates with ``cache`` if needed)."""
    return {
        "totals": M.free_paid_totals(t), "top_free": M.top_free(t), "top_paid": M.top_paid(t),
        "genres": C.genre_mix(t), "sentiment": R.sentiment_by_tier(t), "top_recommended": R.top_recommended(t),
        "price_buckets": M.price_buckets(t), "owners_bands": M.owners_bands(t),
        "playtime": R.playtime_by_tier(t), "reviews_over_time": R.reviews_by_month(t),
        "top_developers": M.top_studios(t), "tag_gaps": TG.busy_niches(t, k=10),
        "price_vs_ccu": M.price_vs_ccu(t), "tag_cooccurrence": TG.major_tag_pairs(t),
    }


def stats_page(t) -> dict[str, DataFrame]:
    return {"stats": M.catalog_counts(t), "top_games": M.top_games(t), "tag_gaps": TG.busy_niches(t, k=8)}


def trends_page(t) -> dict[str, DataFrame]:
    return {"moving_avg": S.ccu_moving_avg(t), "spikes": S.ccu_spikes(t), "change": S.ccu_change(t)}


def write(frames: dict[str, DataFrame], root: str, fmt: str = "json") -> dict[str, str]:
    """Write every frame of a page under ``root/<name>`` (JSON lines by default)."""
    out = {}
    for name, df in frames.items():
        path = f"{root.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(path)
        out[name] = path
    return out
