"""Streams over file sources with availableNow equal the batch results."""

import datetime as dt
import json
import os
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from ludex.operators import scd2
from ludex.operators import timeseries as TS
from ludex.operators.store import Store
from ludex.streaming import ingest as ST


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _reviews(n=60):
    base = 1_704_067_200  # 2024-01-01
    return [{"review_id": i, "app_id": i % 3, "review_text": "t", "review_time": base + i * 3600 * 5,
             "is_positive": i % 4 != 0, "playtime_at_review": i} for i in range(n)]


def test_daily_counts_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="ludex-stream-")
    rows = _reviews()
    _write(f"{d}/src/a.json", json.dumps(rows[:30]))
    _write(f"{d}/src/b.json", json.dumps(rows[30:]))
    q = (ST.daily_review_counts(ST.review_stream(spark, f"{d}/src"), delay="0 seconds").writeStream
         .format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/ck")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.read.parquet(f"{d}/out")
    batch = spark.createDataFrame(rows, "review_id long, app_id long, review_text string, review_time long, "
                                  "is_positive boolean, playtime_at_review int") \
                 .withColumn("review_time", F.timestamp_seconds("review_time"))
    want = TS.daily_counts(batch)
    # the watermark is global: the day holding the newest event is still open
    newest = batch.agg(F.to_date(F.max("review_time"))).first()[0]
    want = want.filter(F.col("review_day") < F.lit(newest))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 0


def test_dedup_within_watermark(spark):
    d = tempfile.mkdtemp(prefix="ludex-stream-")
    rows = _reviews(20)
    _write(f"{d}/src/a.json", json.dumps(rows))
    _write(f"{d}/src/b.json", json.dumps(rows[:5]))   # replayed ids
    q = (ST.dedup_reviews(ST.review_stream(spark, f"{d}/src")).writeStream.format("parquet")
         .option("path", f"{d}/out").option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert spark.read.parquet(f"{d}/out").select("review_id").distinct().count() == 20
    assert spark.read.parquet(f"{d}/out").count() == 20


HEAD = "app_id,name,snapshot_time,owners,price,discount\n"


def _snapshots(spark, d):
    q = ST.snapshot_stream(spark, f"{d}/src", f"{d}/out", f"{d}/ck", buckets=8)
    q.awaitTermination(120)
    return Store(spark, f"{d}/out", 8)


def test_snapshot_stream_t1(spark):
    d = tempfile.mkdtemp(prefix="ludex-stream-")
    _write(f"{d}/src/s1.csv", HEAD + "1,A,2024-01-01T00:00:00,0 .. 20000,999,0\n2,B,2024-01-01T00:00:00,,0,0\n")
    store = _snapshots(spark, d)
    assert store.newest()["counts"] == {"games": 2, "player_counts": 2, "closed_prices": 0, "current_prices": 2, "late_prices": 0}
    # a price change, an unchanged one, a new game, and a price older than the current version
    _write(f"{d}/src/s2.csv", HEAD + "1,A,2024-01-02T00:00:00,0 .. 20000,499,50\n2,B,2024-01-02T00:00:00,,0,0\n"
                                     "3,,2024-01-02T00:00:00,,100,0\n2,B,2023-12-01T00:00:00,,700,0\n")
    store = _snapshots(spark, d)
    assert store.newest()["counts"] == {"games": 1, "player_counts": 4, "closed_prices": 1, "current_prices": 3, "late_prices": 1}
    h = sorted(ST.price_history(store).collect(), key=lambda r: (r.app_id, r.valid_from))
    assert [(r.app_id, float(r.price), r.is_current) for r in h] == [(1, 9.99, False), (1, 4.99, True), (2, 0.0, True), (3, 1.0, True)]
    assert [(r.app_id, float(r.price)) for r in store.appended("late_prices", ST.LATE_TABLE_SCHEMA).collect()] == [(2, 7.0)]
    assert sorted(r.name for r in store.appended("games", ST.GAME_TABLE_SCHEMA).collect()) == ["A", "B", "app_3"]
    assert store.appended("player_counts", ST.SNAP_TABLE_SCHEMA).count() == 6


def test_snapshot_batch_that_failed_between_two_writes(spark, monkeypatch):
    """Nothing of a failed batch is visible; run again it gives what one run gives."""
    d = tempfile.mkdtemp(prefix="ludex-stream-")
    _write(f"{d}/src/s1.csv", HEAD + "".join(f"{i},G{i},2024-01-01T00:00:00,,999,0\n" for i in range(20)))
    store = _snapshots(spark, d)
    before = sorted(map(tuple, ST.price_history(store).collect()))
    _write(f"{d}/src/s2.csv", HEAD + "".join(f"{i},G{i},2024-01-02T00:00:00,,500,0\n" for i in range(5, 25)))
    write = Store.write

    def fail(self, name, *a, **k):
        n = write(self, name, *a, **k)
        if name == "closed_prices":
            raise RuntimeError("lost")
        return n

    monkeypatch.setattr(Store, "write", fail)
    try:
        _snapshots(spark, d)
    except Exception:
        pass
    monkeypatch.undo()
    assert sorted(map(tuple, ST.price_history(store).collect())) == before
    assert store.appended("games", ST.GAME_TABLE_SCHEMA).count() == 20
    store = _snapshots(spark, d)
    h = ST.price_history(store)
    assert (h.count(), h.where("is_current").count()) == (40, 25)
    assert h.groupBy("app_id", "valid_from").count().where("count > 1").count() == 0
    assert store.appended("player_counts", ST.SNAP_TABLE_SCHEMA).count() == 40


def test_snapshot_bytes_follow_the_batch(spark):
    """A batch of one game writes one bucket of current prices, whatever the history holds."""
    d = tempfile.mkdtemp(prefix="ludex-stream-")
    for day in range(1, 4):
        _write(f"{d}/src/s{day}.csv", HEAD + "".join(f"{i},G{i},2024-01-0{day}T00:00:00,,{i + day},0\n" for i in range(200)))
        store = _snapshots(spark, d)
    _write(f"{d}/src/s9.csv", HEAD + "7,G7,2024-01-09T00:00:00,,1,0\n")
    store = _snapshots(spark, d)
    newest = store.newest()
    mine = [x["bucket"] for x in newest["live"]["current_prices"] if x["batch"] == newest["batch"]]
    assert len(mine) == 1 and newest["counts"]["closed_prices"] == 1 and newest["counts"]["current_prices"] < 60
    assert newest["counts"]["player_counts"] == 1 and newest["counts"]["games"] == 0
    h = ST.price_history(store)
    assert (h.where("is_current").count(), h.count()) == (200, 601)
    plan = store.replaced("current_prices", ST.PRICE_TABLE_SCHEMA)._jdf.queryExecution().toString()
    assert "PartitionFilters: [concat_ws" in plan.replace("\n", "")
    rows = sorted(map(tuple, h.collect()), key=str)
    assert store.expire("current_prices") > 0
    assert sorted(map(tuple, ST.price_history(store).collect()), key=str) == rows


def test_daily_counts_with_reviews_three_days_late(spark):
    d = tempfile.mkdtemp(prefix="ludex-stream-")
    rows = _reviews()
    late = [r for r in rows if r["review_id"] % 7 == 3][:4]  # come after all others
    for name, part in (("a", [r for r in rows[:40] if r not in late]), ("b", [r for r in rows[40:] if r not in late]), ("c", late)):
        _write(f"{d}/src/{name}.json", json.dumps(part))
        ST.daily_counts_stream(ST.review_stream(spark, f"{d}/src"), f"{d}/out", f"{d}/ck").awaitTermination(120)
    batch = spark.createDataFrame(rows, "review_id long, app_id long, review_text string, review_time long, "
                                  "is_positive boolean, playtime_at_review int").withColumn("review_time", F.timestamp_seconds("review_time"))
    want = TS.daily_counts(batch)
    got = ST.daily_counts(Store(spark, f"{d}/out"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert got.agg(F.sum("amended")).first()[0] == len(late)


def test_latest_ccu_stream(spark):
    d = tempfile.mkdtemp(prefix="ludex-stream-")
    rows = [(1, dt.datetime(2024, 1, 1), 5, "0"), (1, dt.datetime(2024, 1, 3), None, "0"),
            (2, dt.datetime(2024, 1, 2), 7, "0")]
    spark.createDataFrame(rows, "app_id long, snapshot_time timestamp, concurrent_players int, owners_estimate string") \
         .write.parquet(f"{d}/src")
    src = spark.readStream.schema("app_id long, snapshot_time timestamp, concurrent_players int, "
                                  "owners_estimate string").parquet(f"{d}/src")
    q = (ST.latest_ccu_stream(src).writeStream.format("memory").queryName("latest_ccu_t5")
         .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.app_id: r.concurrent_players for r in spark.table("latest_ccu_t5").collect()}
    assert got == {1: None, 2: 7}


def test_latest_ccu_of_one_time_is_the_larger(spark):
    rows = [(1, dt.datetime(2024, 1, 1), 5, "0"), (1, dt.datetime(2024, 1, 1), 9, "0"), (1, dt.datetime(2024, 1, 1), None, "9")]
    df = spark.createDataFrame(rows, "app_id long, snapshot_time timestamp, concurrent_players int, owners_estimate string")
    assert [r.concurrent_players for r in ST.latest_ccu_stream(df).collect()] == [9]


def test_scd2_stream_t3(spark):
    """Stream output plus open versions equal one collapse of the feed; late rows have their table; decimals throughout."""
    d = tempfile.mkdtemp(prefix="ludex-stream-")
    T = lambda day: dt.datetime(2024, 1, day)
    D = Decimal
    feed = [[(1, "USD", D("1.10"), 0, T(1)), (1, "USD", D("2.00"), 0, T(3)), (2, "USD", D("5.00"), None, T(1)), (3, "INR", None, 10, T(2))],
            [(1, "USD", D("2.00"), 0, T(4)), (1, "USD", D("1.10"), 0, T(6)), (1, "USD", D("9.00"), 0, T(2)), (2, "USD", D("5.00"), None, T(5))],
            [(2, "USD", D("5.00"), 20, T(7)), (3, "INR", None, 10, T(8)), (3, "INR", D("80.33"), 10, T(9)), (4, "USD", D("0.30"), 0, T(9))]]
    schema = "app_id long, currency_code string, price decimal(10,2), discount_pct int, ts timestamp"
    for i, part in enumerate(feed):
        spark.createDataFrame(part, schema).write.parquet(f"{d}/src/p{i}")
        ST.scd2_stream(spark.readStream.schema(schema).parquet(f"{d}/src/*"), f"{d}/out", f"{d}/ck").awaitTermination(180)
    versions, late = ST.scd2_tables(Store(spark, f"{d}/out"))
    assert [tuple(r) for r in late.collect()] == [(1, "USD", D("9.00"), 0, T(2))]
    rows = [r for part in feed for r in part if r[2] != D("9.00")]
    want = scd2.collapse(spark.createDataFrame(rows, schema), ["app_id", "currency_code"], ["price", "discount_pct"], "ts")
    assert versions.schema["price"].dataType.simpleString() == "decimal(10,2)"
    assert sorted(map(str, versions.select(*want.columns).collect())) == sorted(map(str, want.collect()))
