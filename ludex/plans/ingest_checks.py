"""Ingest and load checks: genre backfill views, constraint audit, key
assignment, upserts, insert-or-ignore, resume ledger, SCD2 apply, feed
parsing round trips, review quota and the loader report.

Feed parsers are exercised on payloads that Spark builds from the test tables
(so their work grows with the data), then compared with the tables they came
from.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ludex import config
from ludex.functions import labels as L
from ludex.operators import ingest as IG
from ludex.operators import quality as Q
from ludex.operators import scd2
from ludex.plans.common import LATEST_CCU_SQL, latest_ccu
from ludex.plans.prelude import sql
from ludex.plans.registry import register
from ludex.sources import files as FS

# stand-ins for 'action' (a genre) and 'horror' (a tag) on the synthetic tables
TEST_GENRE, TEST_TAG = "standard", "red"
SPLIT_TS = "2000-01-01 00:00:00"   # second load batch starts here (scd2_apply)
PAYLOAD_BATCH = 20                 # apps per regional price request


# Q21 -----------------------------------------------------------------------
@register("games_missing_genres", sql("SELECT app_id FROM games EXCEPT SELECT app_id FROM game_genres"))
def games_missing_genres(t):
    """Games without any genre link (the backfill worklist), by id."""
    return IG.missing(t["games"].select("app_id"), t["game_genres"], "app_id").orderBy("app_id")


# Q22 -----------------------------------------------------------------------
@register("genre_stats", sql(f"""
SELECT count(*) FILTER (WHERE kind = 'genre') AS genres, count(*) FILTER (WHERE kind = 'genre link') AS game_genres,
       count(DISTINCT app) FILTER (WHERE kind = 'genre link') AS apps_with_genre,
       count(*) FILTER (WHERE kind = 'genre link' AND id IN (SELECT genre_id FROM genres WHERE lower(genre_name) = '{TEST_GENRE}')) AS genre_links,
       count(*) FILTER (WHERE kind = 'tag link' AND id IN (SELECT tag_id FROM tags WHERE lower(tag_name) = '{TEST_TAG}')) AS tag_links
FROM loaded""", [("loaded", """SELECT 'genre' AS kind, genre_id AS id, NULL AS app FROM genres
    UNION ALL SELECT 'genre link', genre_id, app_id FROM game_genres UNION ALL SELECT 'tag link', tag_id, app_id FROM game_tags""")]))
def genre_stats(t, genre: str = TEST_GENRE, tag: str = TEST_TAG):
    """Load verification: genre and link totals, links of one genre and of one tag."""
    gg = t["game_genres"]
    parts = [
        t["genres"].agg(F.count(F.lit(1)).alias("genres")),
        gg.agg(F.count(F.lit(1)).alias("game_genres")),
        gg.select("app_id").distinct().agg(F.count(F.lit(1)).alias("apps_with_genre")),
        gg.join(t["genres"].filter(F.lower("genre_name") == genre), "genre_id")
          .agg(F.count(F.lit(1)).alias("genre_links")),
        t["game_tags"].join(t["tags"].filter(F.lower("tag_name") == tag), "tag_id")
          .agg(F.count(F.lit(1)).alias("tag_links")),
    ]
    from ludex.plans.common import one_row
    return one_row(*parts)


@register("genre_counts", sql("""
SELECT named[genre_id] AS genre_name, len(apps) AS n
FROM (SELECT genre_id, list(app_id) AS apps FROM game_genres GROUP BY genre_id),
     (SELECT map(list(genre_id), list(genre_name)) AS named FROM genres)
ORDER BY n DESC, genre_name"""))
def genre_counts(t):
    """Games per genre."""
    n = t["game_genres"].groupBy("genre_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(t["genres"], "genre_id").select("genre_name", "n").orderBy(F.desc("n"), "genre_name")


@register("game_genre_list", sql("""
SELECT unnest(apps) AS app_id, genre_name
FROM (SELECT genre_id, list(app_id) AS apps FROM game_genres GROUP BY genre_id) JOIN genres USING (genre_id)"""))
def game_genre_list(t, app_id=None):
    """Genres of every game (of one game when given), by name."""
    gg = t["game_genres"] if app_id is None else t["game_genres"].filter(F.col("app_id") == app_id)
    return gg.join(t["genres"], "genre_id").select("app_id", "genre_name").orderBy("app_id", "genre_name")


# K11 -----------------------------------------------------------------------
def _audit_sql():
    def dup(table, keys, where=""):
        return f"(SELECT count(*) FROM (SELECT 1 FROM {table} {where} GROUP BY {keys} HAVING count(*) > 1))"

    def orphan(table, fk, parent, pk):
        return (f"(SELECT count(*) FROM {table} c WHERE c.{fk} IS NOT NULL AND NOT EXISTS "
                f"(SELECT 1 FROM {parent} p WHERE p.{pk} = c.{fk}))")
    rows = [
        ("pk", "developers", dup("developers", "dev_id")),
        ("unique_name", "developers", dup("developers", "name")),
        ("fk_parent", "developers", orphan("developers", "parent_dev_id", "developers", "dev_id")),
        ("pk", "games", dup("games", "app_id")),
        ("not_null_name", "games", "(SELECT count(*) FROM games WHERE name IS NULL)"),
        ("fk_dev", "games", orphan("games", "dev_id", "developers", "dev_id")),
        ("pk", "tags", dup("tags", "tag_id")),
        ("unique_name", "tags", dup("tags", "tag_name")),
        ("pk", "game_tags", dup("game_tags", "app_id, tag_id")),
        ("fk_app", "game_tags", orphan("game_tags", "app_id", "games", "app_id")),
        ("fk_tag", "game_tags", orphan("game_tags", "tag_id", "tags", "tag_id")),
        ("pk", "genres", dup("genres", "genre_id")),
        ("unique_name", "genres", dup("genres", "genre_name")),
        ("not_null_name", "developers", "(SELECT count(*) FROM developers WHERE name IS NULL)"),
        ("not_null_name", "tags", "(SELECT count(*) FROM tags WHERE tag_name IS NULL)"),
        ("not_null_name", "genres", "(SELECT count(*) FROM genres WHERE genre_name IS NULL)"),
        ("pk", "game_genres", dup("game_genres", "app_id, genre_id")),
        ("fk_app", "game_genres", orphan("game_genres", "app_id", "games", "app_id")),
        ("fk_genre", "game_genres", orphan("game_genres", "genre_id", "genres", "genre_id")),
        ("fk_app", "price_history", orphan("price_history", "app_id", "games", "app_id")),
        ("pk", "player_counts", dup("player_counts", "app_id, snapshot_time")),
        ("fk_app", "player_counts", orphan("player_counts", "app_id", "games", "app_id")),
        ("one_current", "price_history", dup("price_history", "app_id, currency_code", "WHERE is_current")),
        ("pk", "reviews", dup("reviews", "review_id")),
        ("fk_app", "reviews", orphan("reviews", "app_id", "games", "app_id")),
    ]
    return sql("\nUNION ALL\n".join(f"SELECT '{r}' AS rule, '{tb}' AS \"table\", {q} AS violations"
                                    for r, tb, q in rows))


@register("constraint_audit", _audit_sql())
def constraint_audit(t):
    """One row per constraint rule with its number of violations (0 = holds)."""
    return Q.audit(t)


# K1 ------------------------------------------------------------------------
@register("assign_tag_keys", sql("""
SELECT e.tag_name, e.tag_id FROM existing e WHERE e.tag_name IN (SELECT tag_name FROM game_tag_names)
UNION ALL
SELECT tag_name, CAST((SELECT max(tag_id) FROM existing) + row_number() OVER (ORDER BY tag_name) AS BIGINT)
FROM (SELECT DISTINCT tag_name FROM game_tag_names WHERE tag_name NOT IN (SELECT tag_name FROM existing))""", [
    ("existing", """SELECT CAST(row_number() OVER (ORDER BY tag_name) AS BIGINT) AS tag_id, tag_name
                    FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag_name FROM part)""")]))
def assign_tag_keys(t):
    """Ids for every tag name: names already in a dimension (the name words)
    keep their ids, new names (brands, sizes, ...) get ids after the max."""
    part = t.raw["part"]
    words = part.select(F.explode(F.split("p_name", " ")).alias("tag_name")).distinct()
    existing = IG.sequential_ids(words, "tag_name", "tag_id").select("tag_id", "tag_name")
    from ludex.sources.warehouse import game_tag_names
    return IG.assign_keys(existing, game_tag_names(t.raw).select("tag_name"), "tag_id", "tag_name")


# K2 ------------------------------------------------------------------------
@register("upsert_games", sql("""
SELECT g.app_id, g.name, g.dev_id,
       CASE WHEN cu.app_id IS NOT NULL THEN cu.price ELSE g.base_price_usd END AS base_price_usd
FROM games g LEFT JOIN (SELECT app_id, price FROM price_history
                        WHERE is_current AND currency_code = 'USD') cu ON cu.app_id = g.app_id"""))
def upsert_games(t):
    """Upsert of the current USD prices into games: only base_price_usd changes."""
    target = t["games"].select("app_id", "name", "dev_id", "base_price_usd")
    upd = scd2.current(t["price_history"], "USD").select("app_id", F.lit(None).cast("string").alias("name"),
                                                          F.lit(None).cast("bigint").alias("dev_id"),
                                                          F.col("price").alias("base_price_usd"))
    return IG.upsert(target, upd, "app_id", ["base_price_usd"])


# K5 ------------------------------------------------------------------------
@register("snapshot_insert", sql("""
SELECT count(*) AS inserted FROM (
  SELECT DISTINCT app_id, snapshot_time + INTERVAL 1 DAY AS snapshot_time FROM player_counts) n
WHERE NOT EXISTS (SELECT 1 FROM player_counts p WHERE p.app_id = n.app_id AND p.snapshot_time = n.snapshot_time)"""))
def snapshot_insert(t):
    """Insert-or-ignore of a next-day snapshot for every row; count of rows really inserted."""
    pc = t["player_counts"]
    new = pc.withColumn("snapshot_time", F.col("snapshot_time") + F.expr("INTERVAL 1 DAY"))
    _, inserted = IG.insert_missing(pc, new, ["app_id", "snapshot_time"])
    return inserted.agg(F.count(F.lit(1)).alias("inserted"))


# K3 / K4 / K6 ----------------------------------------------------------------
@register("stub_insert", sql("""
SELECT app_id, name FROM games
UNION ALL SELECT DISTINCT app_id + 7, 'App ' || (app_id + 7) FROM player_counts
WHERE app_id + 7 NOT IN (SELECT app_id FROM games)"""))
def stub_insert(t, shift: int = 7):
    """Games after a load of snapshots (of ids moved by ``shift``): ids not known get a stub row."""
    new = t["player_counts"].select((F.col("app_id") + shift).alias("app_id"))
    new = new.withColumn("name", F.concat(F.lit("App "), F.col("app_id")))
    return IG.insert_missing(t["games"].select("app_id", "name"), new, "app_id")[0]


@register("bridge_insert", sql("""
SELECT app_id, tag_id FROM game_tags UNION SELECT app_id, tag_id + 1 FROM game_tags"""))
def bridge_insert(t):
    """The tag bridge after a second load that repeats some links and brings new ones."""
    links = t["game_tags"].select("app_id", "tag_id")
    return IG.insert_missing(links, links.withColumn("tag_id", F.col("tag_id") + 1), ["app_id", "tag_id"])[0]


@register("review_insert", sql("""
SELECT review_id, min(playtime_at_review) AS playtime_at_review FROM (
    SELECT review_id, playtime_at_review FROM reviews WHERE is_positive
    UNION ALL SELECT review_id, playtime_at_review + 1 FROM reviews WHERE NOT is_positive
    UNION ALL SELECT review_id, playtime_at_review + 2 FROM reviews WHERE NOT is_positive)
GROUP BY review_id"""))
def review_insert(t):
    """Reviews after a load that brings every review twice, with other playtimes: stored ones
    stay, of the others the row with the smaller playtime is kept."""
    r = t["reviews"].select("review_id", "playtime_at_review", "is_positive")
    stored = r.filter("is_positive").drop("is_positive")
    new = [r.drop("is_positive").withColumn("playtime_at_review", F.col("playtime_at_review") + i) for i in (2, 1)]
    return IG.insert_missing(stored, new[0].unionByName(new[1]), "review_id", order=["playtime_at_review"])[0]


# S7 ------------------------------------------------------------------------
@register("pending_games", sql("""
SELECT g.app_id FROM games g WHERE g.app_id NOT IN (SELECT app_id FROM reviews)"""))
def pending_games(t):
    """Resume ledger: games not yet done (done = has reviews)."""
    return IG.pending(t["games"].select("app_id"), t["reviews"].select("app_id"), "app_id")


# K7 ------------------------------------------------------------------------
@register("scd2_apply", sql("""
SELECT app_id, currency_code, price, discount_pct, valid_from, valid_to, is_current FROM price_history"""))
def scd2_apply(t, split: str = SPLIT_TS):
    """Load the price feed in two batches (before / from ``split``): collapse the
    first, apply the second.  Equals one collapse of the whole feed."""
    from ludex.sources.warehouse import FEED_ORDER as tb
    feed = t["price_feed"]
    at = F.lit(split).cast("timestamp_ntz")
    first = scd2.collapse(feed.filter(F.col("ts") < at), ["app_id", "currency_code"], ["price", "discount_pct"],
                          "ts", tiebreak=tb)
    # the first load is stored before the second one reads it (as a loader
    # would): cut lineage into the session's shared checkpoint folder
    from ludex.session import checkpoint_dir
    checkpoint_dir(first.sparkSession)
    first = first.checkpoint(eager=True)
    second = feed.filter(F.col("ts") >= at)
    hist, _late = scd2.apply(first, second, ["app_id", "currency_code"], ["price", "discount_pct"], "ts", tiebreak=tb)
    return hist


# S5 / K10 / K12 --------------------------------------------------------------
def _payloads(t):
    """One regional-price payload per batch of apps, built from the current INR
    rows: app_id % 7 == 0 answers success=false, free titles answer data: []."""
    cur = scd2.current(t["price_history"], "INR")
    entry = (F.when(F.col("app_id") % 7 == 0, F.to_json(F.struct(F.lit(False).alias("success"))))
              .when(F.col("price") == 0, F.lit('{"success": true, "data": []}'))
              .otherwise(F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.struct(
                  F.lit("INR").alias("currency"), (F.col("price") * 100).cast("bigint").alias("final"),
                  F.col("discount_pct").alias("discount_percent")).alias("price_overview")).alias("data")))))
    e = cur.select((F.col("app_id") / PAYLOAD_BATCH).cast("bigint").alias("batch"),
                   F.col("app_id").cast("string").alias("k"), entry.alias("v"))
    # <= PAYLOAD_BATCH entries per batch: the grouped list is bounded
    grouped = e.groupBy("batch").agg(F.collect_list(F.concat(F.lit('"'), F.col("k"), F.lit('":'), F.col("v"))).alias("kv"))
    return grouped.select("batch", F.concat(F.lit("{"), F.array_join("kv", ","), F.lit("}")).alias("payload"))


@register("price_payload_roundtrip", sql("""
SELECT app_id, CASE WHEN price = 0 THEN CAST(0 AS DECIMAL(10,2)) ELSE price END AS price,
       CASE WHEN price = 0 THEN 0 ELSE discount_pct END AS discount_pct
FROM price_history WHERE is_current AND currency_code = 'INR' AND app_id % 7 <> 0"""))
def price_payload_roundtrip(t):
    """Regional price payloads (built from the INR history) parsed back to rows."""
    return FS.parse_price_payload(_payloads(t), "payload", "INR")


@register("price_load_report", sql("""
SELECT CAST(0 AS BIGINT) AS linked, count(*) FILTER (WHERE app_id % 7 <> 0 AND price <> 0) AS ok,
       count(*) FILTER (WHERE app_id % 7 <> 0 AND price = 0) AS empty, CAST(0 AS BIGINT) AS error,
       count(*) FILTER (WHERE app_id % 7 = 0) AS skipped, count(*) AS total
FROM price_history WHERE is_current AND currency_code = 'INR'"""))
def price_load_report(t):
    """Loader counters for the payload round trip: ok / empty / skipped."""
    apps = scd2.current(t["price_history"], "INR").select("app_id")
    parsed = price_payload_roundtrip(t)
    j = apps.join(parsed.withColumn("_p", F.lit(True)), "app_id", "left")
    status = (F.when(F.col("_p").isNull(), "skipped").when(F.col("price") == 0, "empty").otherwise("ok"))
    return Q.load_report(j.withColumn("status", status))


# S3 / C16 / C17 ---------------------------------------------------------------
@register("app_details_roundtrip", sql("""
SELECT g.app_id, g.name, COALESCE(d.name, 'Unknown') AS developer,
       CAST(COALESCE(g.base_price_usd, 0) AS DECIMAL(10,2)) AS base_price_usd,
       (SELECT count(*) FROM game_tag_names n WHERE n.app_id = g.app_id) AS n_tags,
       (SELECT count(*) FROM game_genre_names n WHERE n.app_id = g.app_id) AS n_genres
FROM games g LEFT JOIN developers d ON d.dev_id = g.dev_id"""))
def app_details_roundtrip(t):
    """App-details JSON documents built from the warehouse (tags as an object of
    votes, genres as a comma string) parsed back; tag and genre counts per game."""
    tags = (t["game_tags"].join(t["tags"], "tag_id").groupBy("app_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("tag_name", F.lit(1)))).alias("tags")))
    genres = (t["game_genres"].join(t["genres"], "genre_id").groupBy("app_id")
              .agg(F.array_join(F.collect_list("genre_name"), ", ").alias("genre")))
    dev = t["developers"].select("dev_id", F.col("name").alias("developer"))
    g = t["games"].join(dev, "dev_id", "left").join(tags, "app_id", "left").join(genres, "app_id", "left")
    doc = F.to_json(F.struct(F.col("app_id").alias("appid"), "name", "developer",
                             (F.col("base_price_usd") * 100).cast("bigint").alias("initialprice"),
                             F.coalesce(F.col("tags"), F.create_map()).alias("tags"), "genre"))
    raw = g.select(F.from_json(doc, FS.APP_DETAILS_SCHEMA).alias("j")).select("j.*")
    p = FS.parse_app_details(raw)
    return p.select("app_id", "name", "developer", "base_price_usd",
                    F.size("tags").cast("bigint").alias("n_tags"), F.size("genres").cast("bigint").alias("n_genres"))


# C15 -----------------------------------------------------------------------
@register("review_quota", sql(f"""
SELECT app_id, CASE WHEN rk < 10 THEN 5 WHEN rk < 50 THEN 2 ELSE 1 END AS pages,
       CASE WHEN rk < 200 THEN 100 WHEN rk < 1000 THEN 50 ELSE 8 END AS per_page
FROM (SELECT g.app_id, row_number() OVER (ORDER BY COALESCE(lc.concurrent_players, 0) DESC, g.app_id) - 1 AS rk
      FROM games g LEFT JOIN latest_ccu lc ON lc.app_id = g.app_id)""", [LATEST_CCU_SQL]))
def review_quota(t):
    """Review pages and page size to fetch per game, by CCU rank.

    Only the first 1,000 ranks have their own quota; they are cut with a
    top-k (a bounded sort) and numbered, every other game gets the last tier
    -- no global window over all games."""
    last_tier = config.REVIEW_QUOTA[-2][0]
    lc = latest_ccu(t).select("app_id", "concurrent_players")
    g = t["games"].select("app_id").join(lc, "app_id", "left") \
                  .withColumn("_c", F.coalesce(F.col("concurrent_players"), F.lit(0)))
    order = [F.desc("_c"), F.asc("app_id")]
    top = g.orderBy(*order).limit(last_tier)
    top = top.withColumn("_rank", F.row_number().over(Window.orderBy(*order)) - 1)
    rest = g.join(top.select("app_id"), "app_id", "left_anti").withColumn("_rank", F.lit(last_tier))
    q = top.unionByName(rest).withColumn("_q", L.review_quota(F.col("_rank")))
    return q.select("app_id", F.col("_q.pages").alias("pages"), F.col("_q.per_page").alias("per_page"))


@register("reviews_within_quota", sql(f"""
SELECT review_id, app_id FROM reviews JOIN ({{quota}}) USING (app_id)
QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY review_time DESC NULLS LAST, review_id) <= most""".format(quota=f"""
    SELECT app_id, CASE WHEN rk < 10 THEN 5 WHEN rk < 50 THEN 2 ELSE 1 END
                   * CASE WHEN rk < 200 THEN 100 WHEN rk < 1000 THEN 50 ELSE 8 END AS most
    FROM (SELECT app_id, row_number() OVER (ORDER BY COALESCE(concurrent_players, 0) DESC, app_id) - 1 AS rk
          FROM games LEFT JOIN latest_ccu USING (app_id))"""), [LATEST_CCU_SQL]))
def reviews_within_quota(t):
    """Each game's newest reviews, as many as its quota allows."""
    return IG.within_quota(t["reviews"], review_quota(t)).select("review_id", "app_id")
