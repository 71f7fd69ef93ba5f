"""Feeds end to end: rows derived from the tables are landed as files, then loaded or streamed
by the ingest operators, and what they leave is the query's result.

Landed files lie in the session's shared folder; their size grows with the tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludex.functions import labels as L
from ludex.operators import vectors as V
from ludex.operators.store import Store
from ludex.plans import reports, tags
from ludex.plans.common import LATEST_CCU_SQL, latest_ccu
from ludex.plans.prelude import sql
from ludex.plans.registry import REGISTRY, register
from ludex.plans.search import CELLS_SQL, e6
from ludex.session import checkpoint_dir
from ludex.sources import files as FS
from ludex.sources import warehouse as W
from ludex.streaming import ingest as ST

#: Reviews of one landed JSON file.
FILE_REVIEWS = 10_000


def _folder(df: DataFrame, label: str) -> str:
    return f"{checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"


def _run(query) -> None:
    """Wait for a stream that ends with what is there; its error is this query's."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


# S1 ------------------------------------------------------------------------
@register("snapshot_csv_load", sql("""
SELECT pc.app_id, g.name, pc.snapshot_time, pc.owners_estimate,
       CAST(COALESCE(g.base_price_usd, 0) AS DECIMAL(10,2)) AS price, CAST(0 AS INTEGER) AS discount_pct
FROM player_counts pc JOIN games g USING (app_id)"""))
def snapshot_csv_load(t):
    """Every snapshot landed as CSV (price in cents) and loaded: typed rows, missing prices and discounts 0."""
    rows = t["player_counts"].join(t["games"].select("app_id", "name", "base_price_usd"), "app_id")
    rows = rows.select("app_id", "name", F.date_format("snapshot_time", "yyyy-MM-dd'T'HH:mm:ss").alias("snapshot_time"), F.col("owners_estimate").alias("owners"),
                       (F.col("base_price_usd") * 100).cast("double").alias("price"), F.lit(None).cast("double").alias("discount"))
    path = _folder(rows, "snapshots")
    rows.write.option("header", True).csv(path)
    out = FS.read_snapshot(rows.sparkSession, path, latest_only=False)
    return out.withColumn("snapshot_time", F.col("snapshot_time").cast("timestamp_ntz"))


# S4 ------------------------------------------------------------------------
@register("review_json_load", sql("""
SELECT review_id, app_id, epoch_us(review_time) // 1000000 AS review_second, is_positive, playtime_at_review FROM reviews"""))
def review_json_load(t):
    """Every review landed in JSON arrays of some thousand reviews and loaded."""
    r = t["reviews"].select("review_id", "app_id", F.lit("text").alias("review_text"),
                            F.unix_seconds(F.col("review_time").cast("timestamp")).alias("review_time"), "is_positive", "playtime_at_review")
    file = F.floor(F.col("review_id") / FILE_REVIEWS)
    arrays = r.groupBy(file.alias("file")).agg(F.to_json(F.collect_list(F.struct(*r.columns))).alias("value"))
    path = _folder(r, "reviews")
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    out = FS.read_reviews(r.sparkSession, path)
    return out.select("review_id", "app_id", F.unix_seconds("review_time").alias("review_second"), "is_positive", "playtime_at_review")


# S6 ------------------------------------------------------------------------
@register("games_over_price", sql("""
SELECT g.app_id, g.name, g.base_price_usd, d.name AS developer
FROM games g JOIN developers d USING (dev_id) WHERE g.base_price_usd >= 40"""))
def games_over_price(t, least: float = 40):
    """Parameterised SQL over warehouse tables: games from a list price on, with their developer."""
    return W.query(t, """SELECT g.app_id, g.name, g.base_price_usd, d.name AS developer
                         FROM {games} g JOIN {developers} d ON d.dev_id = g.dev_id WHERE g.base_price_usd >= :least""", least=least)


# K8 / K12 ------------------------------------------------------------------
@register("embedding_backfill", sql("""
SELECT review_id, CASE WHEN review_embedding IS NOT NULL
       THEN list_aggregate(list_transform(review_embedding, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), 'string_agg', ',')
       ELSE computed END AS embedding_e6, review_embedding IS NULL AS filled
FROM reviews_full LEFT JOIN (
    SELECT review_id, string_agg(CAST(CAST(round(CAST(CAST(COALESCE(s / size, 0) AS FLOAT) AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS computed
    FROM (SELECT review_id FROM reviews_full WHERE review_text IS NOT NULL) CROSS JOIN (SELECT unnest(range(64)) AS i)
    LEFT JOIN cells USING (review_id, i)
    LEFT JOIN (SELECT review_id, NULLIF(sqrt(sum(s * s)), 0) AS size FROM cells GROUP BY review_id) USING (review_id)
    GROUP BY review_id) USING (review_id)
WHERE review_text IS NOT NULL""", [CELLS_SQL]))
def embedding_backfill(t, batch_size: int = 500):
    """Reviews with a text: stored embeddings pass through, missing ones are computed in batches."""
    r = t["reviews_full"].where(F.col("review_text").isNotNull()).select("review_id", "review_text", F.col("review_embedding").cast("array<float>"))
    lacked = r.select("review_id", F.col("review_embedding").isNull().alias("filled"))
    out = V.backfill(r, "review_text", "review_embedding", batch_size=batch_size)
    return out.join(lacked, "review_id").select("review_id", e6("review_embedding").alias("embedding_e6"), "filled")


# C6 ------------------------------------------------------------------------
@register("display_labels", sql("""
SELECT g.app_id, CASE WHEN length(g.name) <= 18 THEN g.name ELSE left(g.name, 17) || '…' END AS name_label,
       COALESCE(format('{:,}', CAST(lc.concurrent_players AS BIGINT)), '—') AS players_label,
       CASE WHEN length(band) <= 16 THEN band ELSE left(band, 15) || '…' END AS band_label,
       CASE WHEN m IS NULL THEN '—' WHEN m >= 600 THEN CAST(CAST(floor(m / 60.0 + 0.5) AS BIGINT) AS VARCHAR) || 'h'
            WHEN m >= 60 THEN printf('%.1f', floor(m / 60.0 * 10 + 0.5) / 10) || 'h' ELSE CAST(m AS VARCHAR) || 'm' END AS hours_label
FROM games g LEFT JOIN latest_ccu lc USING (app_id)
LEFT JOIN (SELECT app_id, replace(regexp_replace(owners_estimate, '\\s*\\.\\.\\s*', '–'), ',', '') AS band FROM latest_ccu) USING (app_id)
LEFT JOIN (SELECT app_id, max(playtime_at_review) AS m FROM reviews GROUP BY app_id) USING (app_id)""", [LATEST_CCU_SQL]))
def display_labels(t):
    """Short names, full player counts, owner bands and longest playtimes as they are displayed."""
    played = t["reviews"].groupBy("app_id").agg(F.max("playtime_at_review").alias("m"))
    g = t["games"].select("app_id", "name").join(latest_ccu(t), "app_id", "left").join(played, "app_id", "left")
    return g.select("app_id", L.short_label(F.col("name")).alias("name_label"), L.full_count(F.col("concurrent_players")).alias("players_label"),
                    L.short_band(F.col("owners_estimate")).alias("band_label"), L.hours_label(F.col("m")).alias("hours_label"))


# K13 -----------------------------------------------------------------------
@register("report_files", REGISTRY["tag_frequency"][1])
def report_files(t):
    """A page's frames written as JSON files and read back."""
    frame = tags.tag_frequency(t)
    path = reports.write({"tags": frame}, _folder(frame, "report"))["tags"]
    return frame.sparkSession.read.schema("tag_name string, game_count bigint").json(path)


# T1 ------------------------------------------------------------------------
@register("snapshot_stream_prices", sql("""
SELECT app_id, 'USD' AS currency_code, price, discount_pct, ts AS valid_from,
       lead(ts) OVER later AS valid_to, lead(ts) OVER later IS NULL AS is_current
FROM changes WINDOW later AS (PARTITION BY app_id ORDER BY ts, price, discount_pct)""", [("changes", """
    SELECT app_id, ts, price, discount_pct FROM (
        SELECT *, lag({'p': price, 'd': discount_pct}) OVER (PARTITION BY app_id ORDER BY ts, price, discount_pct) AS was
        FROM price_feed WHERE currency_code = 'USD')
    WHERE was IS NULL OR was.p IS DISTINCT FROM price OR was.d IS DISTINCT FROM discount_pct""")]))
def snapshot_stream_prices(t, split: str = "2000-01-01 00:00:00"):
    """The dollar prices landed as CSV in two parts, streamed in; the price history that the loads leave."""
    feed = t["price_feed"].where(F.col("currency_code") == "USD")
    rows = feed.select("app_id", F.lit(None).cast("string").alias("name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("snapshot_time"),
                       F.lit("0").alias("owners"), (F.col("price") * 100).cast("double").alias("price"), F.col("discount_pct").cast("double").alias("discount"),
                       (F.col("ts") < F.lit(split).cast("timestamp_ntz")).alias("early"))
    root, spark = _folder(rows, "snapshot-stream"), rows.sparkSession
    for early in (True, False):
        rows.where(F.col("early") == early).drop("early").write.mode("append").option("header", True).csv(f"{root}/src")
        _run(ST.snapshot_stream(spark, f"{root}/src", f"{root}/out", f"{root}/progress"))
    history = ST.price_history(Store(spark, f"{root}/out"))
    return reduce(lambda df, c: df.withColumn(c, F.col(c).cast("timestamp_ntz")), ("valid_from", "valid_to"), history)


def _landed(df: DataFrame, label: str) -> tuple[str, DataFrame]:
    """The frame landed as Parquet, and a stream over it."""
    root = _folder(df, label)
    df.write.parquet(f"{root}/src")
    return root, df.sparkSession.readStream.schema(df.schema).parquet(f"{root}/src")


# T2 ------------------------------------------------------------------------
@register("review_stream_counts", sql("""
SELECT app_id, CAST(review_time AS DATE) AS review_day, count(*) FILTER (WHERE NOT is_positive) AS negative_count,
       count(*) FILTER (WHERE is_positive) AS positive_count, count(*) AS total_count
FROM reviews GROUP BY ALL"""))
def review_stream_counts(t):
    """Daily review counts from the stream, reviews that come late included."""
    root, stream = _landed(t["reviews"].select("app_id", F.col("review_time").cast("timestamp"), "is_positive"), "review-counts")
    _run(ST.daily_counts_stream(stream, f"{root}/out", f"{root}/progress"))
    return ST.daily_counts(Store(stream.sparkSession, f"{root}/out")).drop("amended")


# T4 ------------------------------------------------------------------------
@register("review_stream_dedup", sql("SELECT app_id, count(*) AS reviews FROM reviews GROUP BY app_id"))
def review_stream_dedup(t):
    """Reviews per game from a stream that brings each one twice."""
    r = t["reviews"].select("review_id", "app_id", F.col("review_time").cast("timestamp"))
    root, stream = _landed(r.unionByName(r), "review-dedup")
    _run(ST.dedup_reviews(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress")
         .trigger(availableNow=True).start())
    return stream.sparkSession.read.parquet(f"{root}/out").groupBy("app_id").agg(F.count(F.lit(1)).alias("reviews"))


# T5 ------------------------------------------------------------------------
@register("ccu_stream_latest", sql("SELECT app_id, concurrent_players, owners_estimate, snapshot_time FROM latest_ccu", [LATEST_CCU_SQL]))
def ccu_stream_latest(t):
    """Each game's latest snapshot from the stream."""
    pc = t["player_counts"].select("app_id", F.col("snapshot_time").cast("timestamp"), "concurrent_players", "owners_estimate")
    root, stream = _landed(pc, "latest-ccu")

    def keep(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{root}/out")  # complete mode: a batch has every game

    _run(ST.latest_ccu_stream(stream).writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{root}/progress")
         .trigger(availableNow=True).start())
    out = stream.sparkSession.read.parquet(f"{root}/out")
    return out.withColumn("snapshot_time", F.col("snapshot_time").cast("timestamp_ntz"))
