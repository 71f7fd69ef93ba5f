"""Structured Streaming forms of the ingest feeds.

The reference loads once a day in batch; a Spark user would stream the landed
files.  Every stream here is a file source with an explicit schema and a
checkpoint location (exactly-once file tracking and state survive restarts
and lost executors).  Sinks are ``store.Store`` tables: a micro-batch's rows
become visible with its commit record, and a batch that runs again replaces
its own partitions.

* T1 ``snapshot_stream``: new snapshot CSV files -> games, snapshots, SCD2
  prices and late prices, visible together per batch.
* T2 ``daily_counts_stream``: daily review counts in which late reviews count,
  as amendment rows; ``daily_review_counts`` is the windowed form that closes
  days with a watermark.
* T3 ``scd2_stream``: the open version of each (app, currency) in a typed value
  state (``transformWithStateInPandas``); closed and open versions and late
  rows go to their own tables.
* T4 ``dedup_reviews``: ``dropDuplicatesWithinWatermark`` on review_id.
* T5 ``latest_ccu_stream``: latest snapshot per game, update mode.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ludex.operators import ingest as IG
from ludex.operators import scd2
from ludex.operators.store import Store, bucket_of, path_exists
from ludex.sources import files as FS


# T1 ------------------------------------------------------------------------
GAME_TABLE_SCHEMA = "app_id bigint, name string"
SNAP_TABLE_SCHEMA = "app_id bigint, snapshot_time timestamp, concurrent_players int, owners_estimate string"
PRICE_TABLE_SCHEMA = ("app_id bigint, currency_code string, price decimal(10,2), discount_pct int, "
                      "valid_from timestamp, valid_to timestamp, is_current boolean")
LATE_TABLE_SCHEMA = "app_id bigint, currency_code string, price decimal(10,2), discount_pct int, ts timestamp"


def load_snapshot(store: Store, rows: DataFrame, batch_id: int) -> dict[str, int]:
    """One load of snapshot rows (app_id, snapshot_time, name, owners_estimate, price, discount_pct).

    Unknown ids get a stub game, snapshots are inserted or ignored, prices advance their
    SCD2 versions, prices older than the current version go to ``late_prices``.  Games,
    snapshots, closed versions and late prices are appended; of the current versions only the
    buckets of the batch's games are written anew.  Returns the rows written by table, counted
    by the writes; all become visible with the commit record.
    """
    sess = rows.sparkSession
    at = _batch_time(sess, f"{store.root}/batch_times/batch={batch_id}")
    rows = rows.withColumn("snapshot_time", F.coalesce("snapshot_time", F.lit(at)))
    new_snaps = rows.select("app_id", "snapshot_time", F.lit(None).cast("int").alias("concurrent_players"), "owners_estimate")
    _, snaps = IG.insert_missing(store.appended("player_counts", SNAP_TABLE_SCHEMA, batch_id), new_snaps, ["app_id", "snapshot_time"])
    stubs = rows.select("app_id", F.coalesce("name", F.concat(F.lit("app_"), F.col("app_id"))).alias("name"))
    _, games = IG.insert_missing(store.appended("games", GAME_TABLE_SCHEMA, batch_id), stubs, "app_id")
    feed = rows.select("app_id", F.lit("USD").alias("currency_code"), "price", "discount_pct", F.col("snapshot_time").alias("ts"))
    # at most as many numbers as there are buckets
    touched = [r[0] for r in rows.select(bucket_of("app_id", store.buckets)).distinct().collect()]
    cur = store.replaced("current_prices", PRICE_TABLE_SCHEMA, batch_id, only=set(touched))
    versions, late = scd2.advance(cur, feed, ["app_id", "currency_code"], ["price", "discount_pct"], "ts", tiebreak=["price", "discount_pct"])
    versions = versions.persist()  # read by two writes
    written = {
        "games": store.write("games", games, batch_id),
        "player_counts": store.write("player_counts", snaps, batch_id),
        "closed_prices": store.write("closed_prices", versions.where("NOT is_current"), batch_id),
        "current_prices": store.write("current_prices", versions.where("is_current"), batch_id, bucket="app_id"),
        "late_prices": store.write("late_prices", late.select("app_id", "currency_code", "price", "discount_pct", "ts"), batch_id),
    }
    versions.unpersist()
    store.commit(batch_id, at, {"current_prices": touched}, written)
    return written


def price_history(store: Store) -> DataFrame:
    """All visible price versions."""
    return (store.appended("closed_prices", PRICE_TABLE_SCHEMA)
            .unionByName(store.replaced("current_prices", PRICE_TABLE_SCHEMA)))


def snapshot_stream(spark: SparkSession, src_dir: str, out_dir: str, checkpoint: str, buckets: int = 64):
    """Start the snapshot ingest stream (``availableNow``: process what is there, then stop)."""
    raw = spark.readStream.schema(FS.SNAPSHOT_SCHEMA).option("header", True).csv(src_dir)

    def process(batch: DataFrame, batch_id: int):
        ts = F.when(F.col("snapshot_time") != "", F.col("snapshot_time"))
        rows = batch.select(
            F.col("app_id").cast("bigint").alias("app_id"), F.to_timestamp(ts).alias("snapshot_time"), "name",
            F.coalesce(F.nullif(F.col("owners"), F.lit("")), F.lit("0")).alias("owners_estimate"),
            (F.coalesce(F.col("price"), F.lit(0.0)) / 100).cast("decimal(10,2)").alias("price"),
            F.coalesce(F.col("discount"), F.lit(0.0)).cast("int").alias("discount_pct"))
        load_snapshot(Store(batch.sparkSession, out_dir, buckets), rows, batch_id)

    return (raw.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())


def _batch_time(spark: SparkSession, path: str):
    """One time per batch id, stored: a batch that runs again has the same one."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first()["at"]


# T2 / T4 -------------------------------------------------------------------
def review_stream(spark: SparkSession, src_dir: str) -> DataFrame:
    """Flat review JSON files as a stream (review_time as timestamp)."""
    raw = spark.readStream.schema(FS.FLAT_REVIEW_SCHEMA).option("multiLine", True).json(src_dir)
    return raw.withColumn("review_time", F.timestamp_seconds("review_time"))


def dedup_reviews(reviews: DataFrame, delay: str = "2 days") -> DataFrame:
    """T4: drop repeated review ids arriving within the watermark delay."""
    return reviews.withWatermark("review_time", delay).dropDuplicatesWithinWatermark(["review_id"])


def daily_review_counts(reviews: DataFrame, delay: str = "2 days") -> DataFrame:
    """T2, windowed: per game and UTC day, negative / positive / total review counts.

    Append mode emits a day once the watermark passes its end; rows later
    than ``delay`` are dropped by the watermark (``daily_counts_stream`` counts them)."""
    w = reviews.withWatermark("review_time", delay)
    g = w.groupBy("app_id", F.window("review_time", "1 day").alias("day")).agg(*_counts())
    return g.select("app_id", F.to_date(F.col("day.start")).alias("review_day"), *_COUNTS)


_COUNTS = ["negative_count", "positive_count", "total_count"]
DAILY_SCHEMA = "app_id bigint, review_day date, negative_count bigint, positive_count bigint, total_count bigint, amendment boolean"


def _counts():
    return [F.count_if(~F.col("is_positive")).alias("negative_count"), F.count_if(F.col("is_positive")).alias("positive_count"),
            F.count(F.lit(1)).alias("total_count")]


def daily_counts_stream(reviews: DataFrame, out_dir: str, checkpoint: str, delay_days: int = 2):
    """Daily counts that late reviews amend.

    Each micro-batch adds its own counts per (game, day): nothing is held in state, however late
    reviews may come.  Rows of a day that had ended ``delay_days`` before the newest review of
    the earlier batches are marked ``amendment``: the day had been reported as closed.  ``daily_counts``
    adds a day's rows up."""
    def process(batch: DataFrame, batch_id: int):
        store = Store(batch.sparkSession, out_dir)
        before = store.newest(batch_id)
        closed = F.lit(before["at"] if before else None).cast("timestamp") - F.make_dt_interval(F.lit(delay_days))
        day = F.to_date("review_time").alias("review_day")
        rows = batch.groupBy("app_id", day).agg(*_counts())
        ended = (F.col("review_day") + F.expr("INTERVAL 1 DAY")).cast("timestamp") <= closed
        written = store.write("daily_counts", rows.withColumn("amendment", F.coalesce(ended, F.lit(False))), batch_id)
        newest = batch.agg(F.max("review_time")).first()[0]
        at = max((t for t in (newest, before["at"] if before else None) if t), default=None)
        store.commit(batch_id, at, counts={"daily_counts": written})

    return (reviews.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
                   .trigger(availableNow=True).start())


def daily_counts(store: Store) -> DataFrame:
    """Visible counts per (game, day), amendments included; ``amended``: reviews that came after the day was closed."""
    rows = store.appended("daily_counts", DAILY_SCHEMA)
    return rows.groupBy("app_id", "review_day").agg(
        *[F.sum(c).alias(c) for c in _COUNTS], F.sum(F.when(F.col("amendment"), F.col("total_count")).otherwise(0)).alias("amended"))


# T5 ------------------------------------------------------------------------
def latest_ccu_stream(snapshots: DataFrame) -> DataFrame:
    """T5: latest snapshot per game (update / complete output mode).  Of snapshots of one time
    the larger (players, then owners; nulls first) counts."""
    row = F.struct("snapshot_time", "concurrent_players", "owners_estimate")
    return snapshots.groupBy("app_id").agg(F.max(row).alias("l")).select("app_id", "l.concurrent_players", "l.owners_estimate", "l.snapshot_time")


# T3 ------------------------------------------------------------------------
VERSION_SCHEMA = "app_id bigint, currency_code string, price decimal(10,2), discount_pct int, valid_from timestamp, valid_to timestamp"


class OpenVersion(StatefulProcessor):
    """The open version of one (app, currency), advanced by the rows of a micro-batch.

    Emits a row a closed version (``closed``), the new open version where it changed (``open``)
    and the rows older than the open version (``late``).  Prices are decimals throughout.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "price decimal(10,2), discount_pct int, valid_from timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        feed = pd.concat([r[["price", "discount_pct", "ts"]] for r in rows]).reset_index(drop=True)
        feed["discount_pct"] = feed["discount_pct"].astype("Int64")
        feed = feed.sort_values(["ts", "price", "discount_pct"], na_position="first", kind="stable").reset_index(drop=True)
        out = []
        if self.version.exists():
            price, discount, since = self.version.get()
            late = feed["ts"] < pd.Timestamp(since)
            out.append(self._rows(feed[late], feed["ts"][late], pd.NaT, "late"))
            stored = pd.DataFrame({"price": pd.Series([price], dtype=object), "discount_pct": pd.array([discount], "Int64"), "ts": [pd.Timestamp(since)]})
            feed = pd.concat([stored, feed[~late]], ignore_index=True)
        # a row opens a version where it differs null-safely from the one before; the first is open already or opens one
        text = feed["price"].map(lambda p: None if p is None or p != p else p.normalize())
        before = text.shift(1)
        same = ((text == before) | (text.isna() & before.isna())) & (
            (feed["discount_pct"] == feed["discount_pct"].shift(1)).fillna(False) | (feed["discount_pct"].isna() & feed["discount_pct"].shift(1).isna()))
        same.iloc[0] = False
        opens = feed[~same.astype(bool)].reset_index(drop=True)
        out.append(self._rows(opens.iloc[:-1], opens["ts"].iloc[:-1], opens["ts"].iloc[1:].reset_index(drop=True), "closed"))
        last = opens.iloc[-1:]
        if not self.version.exists() or len(opens) > 1:
            price, discount, since = (last[c].iloc[0] for c in ("price", "discount_pct", "ts"))
            self.version.update((None if price is None or price != price else price, None if pd.isna(discount) else int(discount), since.to_pydatetime()))
            out.append(self._rows(last, last["ts"], pd.NaT, "open"))
        found = pd.concat([o for o in out if len(o)]) if any(len(o) for o in out) else None
        if found is not None:
            found.insert(0, "currency_code", key[1])
            found.insert(0, "app_id", key[0])
            yield found

    @staticmethod
    def _rows(versions, since, until, kind):
        out = versions[["price", "discount_pct"]].reset_index(drop=True)
        out["valid_from"] = since.reset_index(drop=True)
        out["valid_to"] = pd.Series(until, index=out.index, dtype="datetime64[ns]") if until is pd.NaT else until
        out["kind"] = kind
        return out

    def close(self) -> None:
        pass


def scd2_versions(feed: DataFrame) -> DataFrame:
    """Closed, open and late rows as the feed (app_id, currency_code, price, discount_pct, ts) arrives.

    Needs the RocksDB state store: state is bounded by disk, not by memory.  One key's rows of one
    micro-batch are sorted together: bound the micro-batch (``maxFilesPerTrigger`` /
    ``maxBytesPerTrigger`` on the source)."""
    feed = feed.select(F.col("app_id").cast("bigint"), "currency_code", F.col("price").cast("decimal(10,2)"), F.col("discount_pct").cast("int"), "ts")
    return feed.groupBy("app_id", "currency_code").transformWithStateInPandas(
        OpenVersion(), VERSION_SCHEMA + ", kind string", outputMode="append", timeMode="none")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scd2_stream(feed: DataFrame, out_dir: str, checkpoint: str):
    """Start the stream of versions; closed and late rows are appended, open ones replace those of their key."""
    feed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def process(batch: DataFrame, batch_id: int):
        store, batch = Store(batch.sparkSession, out_dir), batch.persist()
        written = {kind: store.write(kind, batch.where(F.col("kind") == kind).drop("kind"), batch_id) for kind in ("closed", "open", "late")}
        batch.unpersist()
        store.commit(batch_id, None, counts=written)

    return (scd2_versions(feed).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
                               .outputMode("append").trigger(availableNow=True).start())


def scd2_tables(store: Store) -> tuple[DataFrame, DataFrame]:
    """The visible versions (closed and open, with ``is_current``) and the late rows of ``scd2_stream``."""
    keys = ["app_id", "currency_code"]
    closed, late = (store.appended(kind, VERSION_SCHEMA) for kind in ("closed", "late"))
    # of a key's open versions the newest batch's is open still
    every = store.appended("open", VERSION_SCHEMA, keep_batch=True)
    last = every.groupBy(*keys).agg(F.max(F.struct("batch", "valid_from", "price", "discount_pct", "valid_to")).alias("v"))
    last = last.select(*keys, "v.price", "v.discount_pct", "v.valid_from", "v.valid_to")
    return (closed.withColumn("is_current", F.lit(False)).unionByName(last.withColumn("is_current", F.lit(True))),
            late.select(*keys, "price", "discount_pct", F.col("valid_from").alias("ts")))
