"""Shared intermediate frames of the queries (Spark side) and their SQL twins.

The reference re-derives the latest CCU per game in 22 statements and the
free flag up to four times per statement; here each is one function whose
result is joined once (and cached by the caller when several queries share
one session, see ``reports``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludex.config import F2P_TAG, NON_GAME_NAME_WORDS, WALLPAPER_NAME, Filters
from ludex.functions import predicates as P
from ludex.operators.latest import latest_by
from ludex.plans.prelude import sql_list


def latest_ccu(t) -> DataFrame:
    """(app_id, concurrent_players, owners_estimate, snapshot_time) of each game's latest snapshot."""
    return latest_by(t["player_counts"], "app_id", "snapshot_time",
                     ["concurrent_players", "owners_estimate", "snapshot_time"])


def current_price(t, currency: str) -> DataFrame:
    """(app_id, price, discount_pct) of the current version in ``currency``."""
    ph = t["price_history"]
    return ph.filter(F.col("is_current") & (F.col("currency_code") == currency)) \
             .select("app_id", "price", "discount_pct")


def real_game_ids(t, filters: Filters) -> DataFrame:
    return P.real_games(t["games"].select("app_id", "name"), t, filters).select("app_id")


def one_row(*frames: DataFrame) -> DataFrame:
    """Combine one-row aggregates into one row without a cross join:
    union them (each fills its own columns) and take max per column."""
    cols = [c for f in frames for c in f.columns]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return u.agg(*[F.max(c).alias(c) for c in cols])


# --------------------------------------------------------------------------
# SQL twins (CTE bodies for the DuckDB oracle)
# --------------------------------------------------------------------------

LATEST_CCU_SQL = ("latest_ccu", """
    SELECT DISTINCT ON (app_id) app_id, concurrent_players, owners_estimate, snapshot_time
    FROM player_counts ORDER BY app_id, snapshot_time DESC""")

CURRENT_USD_SQL = ("current_usd", """
    SELECT app_id, price, discount_pct FROM price_history WHERE is_current AND currency_code = 'USD'""")

CURRENT_INR_SQL = ("current_inr", """
    SELECT app_id, price, discount_pct FROM price_history WHERE is_current AND currency_code = 'INR'""")

# The price ladder: any positive price, then any zero price, then (no price at all) the tag.
FREE_FLAGS_SQL = ("free_flags", f"""
    SELECT app_id,
           CASE WHEN greatest(base_price_usd, highest) > 0 THEN FALSE
                WHEN least(base_price_usd, lowest) = 0 THEN TRUE
                WHEN tagged AND priced IS NULL THEN TRUE END AS is_free
    FROM games
    LEFT JOIN (SELECT app_id, TRUE AS priced, max(price) AS highest, min(price) AS lowest
               FROM price_history WHERE is_current AND currency_code = 'USD' GROUP BY app_id) USING (app_id)
    LEFT JOIN (SELECT app_id, bool_or(tag_name = '{F2P_TAG}') AS tagged
               FROM game_tags JOIN tags USING (tag_id) GROUP BY app_id) USING (app_id)""")


def real_games_sql(filters: Filters, name: str = "real_games"):
    """All games less the listed ids, the tool-like names and the games of tool tags."""
    edge = "[[:space:][:punct:]]"
    patterns = [f"(^|{edge}){NON_GAME_NAME_WORDS}({edge}|$)", WALLPAPER_NAME]
    return (name, f"""
    SELECT app_id FROM games WHERE NOT regexp_matches(name, '{"|".join(patterns)}', 'i')
    EXCEPT SELECT unnest([{", ".join(map(str, filters.app_ids))}])
    EXCEPT SELECT app_id FROM game_tags SEMI JOIN (
        SELECT tag_id FROM tags WHERE lower(tag_name) IN {sql_list(filters.tool_tags)}) USING (tag_id)""")
