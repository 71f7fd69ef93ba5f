"""Sequence operators over runs of hot keys equal the plain single-window form."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ludex.operators import sequence as S

#: No cut at all, runs of a few rows, of some dozens.
CUTS = [{}, {"one_in": 1, "per_run": 2}, {"one_in": 2, "per_run": 10}]


def _data(spark, seed=1, n=600):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = rnd.choice([0, 0, 0, 1, 2])   # key 0 is hot
        t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(24 * 120))
        v = rnd.choice([None, rnd.randrange(100)])
        rows.append((k, t, i, v))
    return spark.createDataFrame(rows, "k int, ts timestamp_ntz, seq int, v int")


def test_lag_lead_match_window(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("ts", "seq")
    ref = df.select("seq", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n")).collect()
    for cut in CUTS:
        lag = S.lag_within(df, "k", ["ts", "seq"], ["v"], **cut, marker="has") \
            .select("seq", "prev_v", "has")
        lead = S.lead_within(df, "k", ["ts", "seq"], ["v"], **cut).select("seq", "next_v")
        got_l = {r.seq: r.prev_v for r in lag.collect()}
        got_n = {r.seq: r.next_v for r in lead.collect()}
        assert {r.seq: r.p for r in ref} == got_l
        assert {r.seq: r.n for r in ref} == got_n


def test_rolling_avg_matches_window(spark):
    df = _data(spark, seed=4)
    w = Window.partitionBy("k").orderBy("ts", "seq").rowsBetween(-6, 0)
    ref = {r.seq: r.a for r in df.select("seq", F.avg("v").over(w).alias("a")).collect()}
    for cut in CUTS:
        got = {r.seq: r.m for r in
               S.rolling_avg(df, "k", ["ts", "seq"], "v", 7, "m", **cut).collect()}
        assert ref.keys() == got.keys()
        for s in ref:
            assert (ref[s] is None and got[s] is None) or abs(ref[s] - got[s]) < 1e-9


def test_one_key_with_all_rows_in_a_month(spark):
    df = spark.range(30_000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % 2_400_000)
                                    .cast("timestamp_ntz").alias("ts"), F.col("id").alias("seq"), (F.col("id") % 97).alias("v"))
    w = Window.partitionBy("k").orderBy("ts", "seq")
    plain = df.withColumn("prev_v", F.lag("v").over(w)).withColumn("next_v", F.lead("v").over(w))
    got = S.lead_within(S.lag_within(df, "k", ["ts", "seq"], ["v"]), "k", ["ts", "seq"], ["v"])
    digest = F.sum(F.xxhash64("seq", "prev_v", "next_v").bitwiseAND(F.lit(0xFFFFFF)))
    assert got.agg(digest).first() == plain.agg(digest).first()


def test_hot_hour_is_split_over_tasks(spark):
    """A key with two thirds of a million rows, all within one hour, meets in several window partitions."""
    df = spark.range(1_000_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 1000).otherwise(-1).alias("k"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 3600).cast("timestamp_ntz").alias("ts"), F.col("id").alias("seq"), (F.col("id") % 97).alias("v"))
    r = S.runs(df, "k", ["ts", "seq"], one_in=256)
    sizes = [x["n"] for x in r.df.where("k = -1").groupBy("_run").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert r.split and len(sizes) >= 5 and max(sizes) < 400_000
    assert r.df.where("k <> -1").agg(F.max("_run")).first()[0] == 0  # the other keys are one run each
    w = Window.partitionBy("k").orderBy("ts", "seq")
    plain = (df.withColumn("prev_v", F.lag("v").over(w)).withColumn("next_v", F.lead("v").over(w))
             .withColumn("m", F.avg("v").over(w.rowsBetween(-6, 0))))
    got = r.neighbour(["v"], -1, "prev_").neighbour(["v"], 1, "next_").rolling_avg("v", 7, "m").df
    digest = F.sum(F.xxhash64("seq", "prev_v", "next_v", F.round("m", 6)).bitwiseAND(F.lit(0xFFFFFF)))
    assert got.agg(digest).first() == plain.agg(digest).first()


def test_one_instant_and_null_keys(spark):
    """Ties of the first order column are cut by the next; null keys and null times are ordered too."""
    rows = [(None if i % 2 else 5, dt.datetime(2024, 1, 1) if i % 5 else None, i, i % 7 or None) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, seq int, v int")
    w = Window.partitionBy("k").orderBy("ts", "seq")
    want = df.select("seq", F.lag("v").over(w).alias("p"), F.last("v", True).over(w).alias("l")).collect()
    r = S.runs(df, "k", ["ts", "seq"], one_in=1, per_run=9)
    got = r.neighbour(["v"], -1, "prev_").last_known("v", "l").df.select("seq", "prev_v", "l").collect()
    assert r.split and {x[0]: x[1:] for x in got} == {x[0]: x[1:] for x in want}


def test_cut_points_are_bounded_and_none_without_hot_keys(spark):
    df = spark.range(20_000).select((F.col("id") % 4000).alias("k"), F.col("id").alias("seq"))
    assert not S.runs(df, "k", "seq", one_in=1, per_run=64).split
    one = S.runs(df.withColumn("k", F.lit(1)), "k", "seq", one_in=1, per_run=2)
    assert one.df.agg(F.max("_run")).first()[0] <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
