"""Shared predicates: free classification, real games, relevant tags, bands.

Each returns Columns or small per-app frames; callers join them once per
query (the reference re-evaluates correlated EXISTS clauses per use).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludex import config
from ludex.config import DEFAULT_FILTERS, Filters

PUNCT = r"[\s\p{Punct}\p{P}]"


def usd_flags(price_history: DataFrame, currency: str = "USD") -> DataFrame:
    """Per app: any current row, any current price > 0, any current price = 0."""
    cur = price_history.filter(F.col("is_current") & (F.col("currency_code") == currency))
    return cur.groupBy("app_id").agg(
        F.bool_or(F.coalesce(F.col("price"), F.lit(0)) > 0).alias("_cur_paid"),
        F.bool_or(F.col("price").isNotNull() & (F.col("price") == 0)).alias("_cur_zero"),
        F.lit(True).alias("_cur_any"),
    )


def f2p_apps(game_tags: DataFrame, tags: DataFrame, tag_name: str = config.F2P_TAG) -> DataFrame:
    """Apps carrying the exact free-to-play tag (one row per app)."""
    t = tags.filter(F.col("tag_name") == tag_name).select("tag_id")
    return game_tags.join(t, "tag_id", "left_semi").select("app_id").distinct() \
                    .withColumn("_f2p", F.lit(True))


def with_is_free(games: DataFrame, t, out: str = "is_free", base_col: str = "base_price_usd") -> DataFrame:
    """three-valued price-first free flag.

    Not free when the base price or any current USD price is > 0; free when the
    base price or a current USD price is 0; only when the base price is NULL
    and there is no current USD row, the 'Free to Play' tag decides.  NULL
    when the price is unknown and the tag is absent.
    """
    flags = usd_flags(t["price_history"])
    f2p = f2p_apps(t["game_tags"], t["tags"])
    g = games.join(flags, "app_id", "left").join(f2p, "app_id", "left")
    base = F.col(base_col)
    paid = (F.coalesce(base, F.lit(0)) > 0) | F.coalesce(F.col("_cur_paid"), F.lit(False))
    fallback = base.isNull() & F.col("_cur_any").isNull() & F.coalesce(F.col("_f2p"), F.lit(False))
    free = (base == 0) | F.coalesce(F.col("_cur_zero"), F.lit(False)) | fallback
    return g.withColumn(out, ~paid & free).drop("_cur_paid", "_cur_zero", "_cur_any", "_f2p")


def is_free_frame(t) -> DataFrame:
    """(app_id, is_free) for every game."""
    return with_is_free(t["games"].select("app_id", "base_price_usd"), t).select("app_id", "is_free")


def name_is_game(name: Column) -> Column:
    words = rf"(?i)(^|{PUNCT}){config.NON_GAME_NAME_WORDS}({PUNCT}|$)"
    wallpaper = rf"(?i){config.WALLPAPER_NAME}"
    return ~name.rlike(words) & ~name.rlike(wallpaper)


def tool_tagged_apps(game_tags: DataFrame, tags: DataFrame, filters: Filters = DEFAULT_FILTERS) -> DataFrame:
    bad = tags.filter(F.lower(F.col("tag_name")).isin(list(filters.tool_tags))).select("tag_id")
    return game_tags.join(bad, "tag_id", "left_semi").select("app_id")


def real_games(games: DataFrame, t, filters: Filters = DEFAULT_FILTERS) -> DataFrame:
    """drop known non-game ids, tool-like names, and apps with a tool tag."""
    g = games.filter(~F.col("app_id").isin(list(filters.app_ids)) & name_is_game(F.col("name")))
    return g.join(tool_tagged_apps(t["game_tags"], t["tags"], filters), "app_id", "left_anti")


def relevant_tag(tag_name: Column, filters: Filters = DEFAULT_FILTERS) -> Column:
    """tag is not a tool / adult / non-game tag."""
    return ~F.lower(tag_name).isin(list(filters.non_game_tags))


def price_band(list_price: Column, band: str) -> Column:
    """leaderboard price filter on coalesce(current USD, base)."""
    p = list_price
    bands = {
        "all": F.lit(True),
        "free": p == 0,
        "paid": p > 0,
        "under5": (p > 0) & (p < 5),
        "5to15": (p >= 5) & (p < 15),
        "15to30": (p >= 15) & (p < 30),
        "over30": p >= 30,
    }
    if band not in bands:
        raise ValueError(f"unknown price band {band!r}")
    return bands[band]
