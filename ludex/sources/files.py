"""Landed feed files (S1-S5): snapshot CSV, app-details JSON, review JSON,
regional price payloads.  Explicit schemas, no inference.

Fields whose JSON type varies (``tags`` is an object or ``[]``; ``genre`` is a
string or a list; price ``data`` is an object or ``[]``) are read as raw JSON
text and parsed with ``from_json`` / ``get_json_object``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludex.functions import labels as L

SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("app_id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("snapshot_time", T.StringType()),
    T.StructField("owners", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("discount", T.DoubleType()),
])

APP_DETAILS_SCHEMA = T.StructType([
    T.StructField("appid", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("developer", T.StringType()),
    T.StructField("initialprice", T.StringType()),
    T.StructField("price", T.StringType()),
    T.StructField("discount", T.StringType()),
    T.StructField("ccu", T.LongType()),
    T.StructField("owners", T.StringType()),
    T.StructField("tags", T.StringType()),    # object name->votes, or [] when empty
    T.StructField("genre", T.StringType()),   # comma string or list
])

FLAT_REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("app_id", T.LongType()),
    T.StructField("review_text", T.StringType()),
    T.StructField("review_time", T.LongType()),
    T.StructField("is_positive", T.BooleanType()),
    T.StructField("playtime_at_review", T.IntegerType()),
])

STORE_REVIEW_SCHEMA = T.StructType([
    T.StructField("recommendationid", T.StringType()),
    T.StructField("review", T.StringType()),
    T.StructField("timestamp_created", T.LongType()),
    T.StructField("voted_up", T.BooleanType()),
    T.StructField("author", T.StructType([T.StructField("playtime_forever", T.IntegerType())])),
])


def _blank_to(c: Column, default: Column) -> Column:
    """Python's ``row.get(x) or default``: NULL and '' both fall back."""
    return F.when(c.isNull() | (c.cast("string") == ""), default).otherwise(c)


def latest_path(spark: SparkSession, path: str, by: str = "name") -> str | None:
    """The newest file under ``path`` -- of the largest name (``by='name'``) or modification time
    (``by='time'``; ties: the larger name, then path).  None where there is no file.

    A ``binaryFile`` listing pruned to path and time: no file's content is read."""
    listed = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    name = F.substring_index("path", "/", -1)
    order = [F.desc(name), F.desc("path")]
    newest = listed.orderBy(*([F.desc("modificationTime")] if by == "time" else []), *order).select("path").first()
    return newest["path"] if newest else None


def read_snapshot(spark: SparkSession, path: str, latest_only: bool = True,
                  missing_price: str = "zero") -> DataFrame:
    """Snapshot CSV -> (app_id, name, snapshot_time, owners_estimate, price, discount_pct).

    A missing price becomes 0 like the reference's loader (and so counts as
    free); ``missing_price='null'`` keeps it unknown instead."""
    if latest_only:
        path = latest_path(spark, path) or path
    raw = spark.read.csv(path, header=True, schema=SNAPSHOT_SCHEMA)
    ts = _blank_to(F.col("snapshot_time"), F.lit(None))
    return raw.select(
        F.col("app_id").cast("bigint").alias("app_id"),
        _blank_to(F.col("name"), F.concat(F.lit("app_"), F.col("app_id").cast("string"))).alias("name"),
        F.coalesce(F.to_timestamp(ts), F.current_timestamp()).alias("snapshot_time"),
        _blank_to(F.col("owners"), F.lit("0")).alias("owners_estimate"),
        ((F.col("price") if missing_price == "null" else F.coalesce(F.col("price"), F.lit(0.0))) / 100)
        .cast("decimal(10,2)").alias("price"),
        F.coalesce(F.col("discount"), F.lit(0.0)).cast("int").alias("discount_pct"),
    )


def read_app_details(spark: SparkSession, path: str) -> DataFrame:
    """S3: app-details JSON array -> typed rows with ``tags`` and ``genres`` arrays."""
    raw = spark.read.json(path, schema=APP_DETAILS_SCHEMA, multiLine=True)
    return parse_app_details(raw)


def parse_app_details(raw: DataFrame) -> DataFrame:
    cents = lambda c: (F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) / 100).cast("decimal(10,2)")
    return raw.select(
        F.col("appid").alias("app_id"), "name",
        F.coalesce(F.col("developer"), F.lit("Unknown")).alias("developer"),
        cents("initialprice").alias("base_price_usd"),
        cents("price").alias("price"),
        F.coalesce(F.col("discount").try_cast("double"), F.lit(0.0)).cast("int").alias("discount_pct"),
        F.coalesce(F.col("ccu"), F.lit(0)).cast("int").alias("ccu"),
        F.coalesce(F.col("owners"), F.lit("0")).alias("owners"),
        L.tag_names(F.col("tags")).alias("tags"),
        L.parse_genre_field(F.col("genre")).alias("genres"),
    )


def read_reviews(spark: SparkSession, path: str, store_payload: bool = False, app_id=None) -> DataFrame:
    """Flat reviews JSON, or store review payload (nested author, epoch seconds)."""
    if not store_payload:
        raw = spark.read.json(path, schema=FLAT_REVIEW_SCHEMA, multiLine=True)
        return raw.withColumn("review_time", F.timestamp_seconds("review_time"))
    raw = spark.read.json(path, schema=STORE_REVIEW_SCHEMA, multiLine=True)
    return raw.select(
        F.col("recommendationid").cast("bigint").alias("review_id"),
        F.lit(app_id).cast("bigint").alias("app_id"),
        F.col("review").alias("review_text"),
        F.timestamp_seconds("timestamp_created").alias("review_time"),
        F.col("voted_up").alias("is_positive"),
        F.coalesce(F.col("author.playtime_forever"), F.lit(0)).alias("playtime_at_review"),
    )


PAYLOAD_SCHEMA = "map<string, struct<success: boolean, data: string>>"


def parse_price_payload(df: DataFrame, payload_col: str = "payload", currency: str = "INR") -> DataFrame:
    """Regional price payloads -> (app_id, price, discount_pct).

    success=false -> no row; ``data`` not an object -> (0, 0); no
    price_overview -> (0, 0); another currency -> no row; ``final`` NULL -> no
    row; amounts are minor units (/100)."""
    m = df.select(F.explode(F.from_json(F.col(payload_col), PAYLOAD_SCHEMA)).alias("app", "entry"))
    m = m.filter(F.coalesce(F.col("entry.success"), F.lit(False)))
    data = F.col("entry.data")
    is_obj = F.trim(F.coalesce(data, F.lit(""))).startswith("{")
    overview = F.get_json_object(data, "$.price_overview")
    cur = F.upper(F.coalesce(F.get_json_object(data, "$.price_overview.currency"), F.lit("")))
    final = F.get_json_object(data, "$.price_overview.final")
    disc = F.get_json_object(data, "$.price_overview.discount_percent")
    has_ov = is_obj & overview.isNotNull() & (overview != "{}") & (overview != "null")
    keep = ~has_ov | (((cur == "") | (cur == currency.upper())) & final.try_cast("double").isNotNull())
    price = F.when(has_ov, (final.try_cast("double") / 100)).otherwise(F.lit(0.0))
    discount = F.when(has_ov, F.coalesce(disc.try_cast("double"), F.lit(0.0)).cast("int")).otherwise(F.lit(0))
    return m.filter(keep).select(F.col("app").cast("bigint").alias("app_id"),
                                 price.cast("decimal(10,2)").alias("price"), discount.alias("discount_pct"))
