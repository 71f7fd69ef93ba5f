"""SCD2 semantics (FIXTURES K7 cases) and properties."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ludex.operators import scd2

SCHEMA = "app_id long, currency_code string, price decimal(10,2), discount_pct int, ts timestamp_ntz, seq int"
#: No cut at all, runs of a few rows, of some dozens.
CUTS = [{}, {"one_in": 1, "per_run": 2}, {"one_in": 2, "per_run": 10}]
KEYS, TRACKED = ["app_id", "currency_code"], ["price", "discount_pct"]


def T(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def versions(spark, rows):
    feed = spark.createDataFrame(rows, SCHEMA)
    out = scd2.collapse(feed, KEYS, TRACKED, "ts", tiebreak=["seq"])
    return sorted(out.collect(), key=lambda r: (r.app_id, r.currency_code, r.valid_from, r.valid_to is None, r.valid_to))


D = Decimal


def test_same_state_is_noop(spark):
    v = versions(spark, [(1, "USD", D("9.99"), 0, T(1), 0), (1, "USD", D("9.99"), 0, T(2), 0)])
    assert len(v) == 1 and v[0].is_current and v[0].valid_from == T(1)


def test_price_change_closes_and_opens(spark):
    v = versions(spark, [(1, "USD", D("9.99"), 0, T(1), 0), (1, "USD", D("4.99"), 0, T(3), 0)])
    assert [(r.price, r.valid_from, r.valid_to, r.is_current) for r in v] == [
        (D("9.99"), T(1), T(3), False), (D("4.99"), T(3), None, True)]


def test_discount_only_change(spark):
    v = versions(spark, [(1, "USD", D("9.99"), 0, T(1), 0), (1, "USD", D("9.99"), 50, T(2), 0)])
    assert len(v) == 2 and v[1].discount_pct == 50


def test_null_to_null_no_change(spark):
    v = versions(spark, [(1, "USD", None, None, T(1), 0), (1, "USD", None, None, T(2), 0)])
    assert len(v) == 1


def test_a_b_a_three_versions(spark):
    v = versions(spark, [(1, "USD", D("1"), 0, T(1), 0), (1, "USD", D("2"), 0, T(2), 0), (1, "USD", D("1"), 0, T(3), 0)])
    assert [r.price for r in v] == [D("1"), D("2"), D("1")]


def test_same_instant_zero_length(spark):
    v = versions(spark, [(1, "USD", D("1"), 0, T(1), 0), (1, "USD", D("2"), 0, T(1), 1)])
    assert v[0].valid_from == v[0].valid_to == T(1) and v[1].is_current
    hist = spark.createDataFrame([tuple(r) for r in v], "app_id long, currency_code string, price decimal(10,2), "
                                 "discount_pct int, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean")
    got = scd2.as_of(hist, "2024-01-01 00:00:00").collect()
    assert [r.price for r in got] == [D("2")]


def test_currencies_version_independently(spark):
    v = versions(spark, [(1, "USD", D("1"), 0, T(1), 0), (1, "INR", D("80"), 0, T(2), 0), (1, "USD", D("1"), 0, T(3), 0)])
    assert len(v) == 2


def _random_feed(n_keys=5, n=400, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = rnd.randrange(n_keys)
        day = dt.datetime(2023, 1, 1) + dt.timedelta(days=rnd.randrange(400))
        p = rnd.choice([D("1.00"), D("2.00"), None])
        rows.append((k, "USD", p, rnd.choice([0, 10]), day, i))
    return rows


def _plain_collapse(rows):
    out = []
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[4], r[5])):
        by.setdefault((r[0], r[1]), []).append(r)
    for key, rs in by.items():
        kept = []
        prev = None
        for r in rs:
            if prev is None or (r[2], r[3]) != (prev[2], prev[3]):
                kept.append(r)
            prev = r
        for i, r in enumerate(kept):
            nxt = kept[i + 1][4] if i + 1 < len(kept) else None
            out.append((r[0], r[1], r[2], r[3], r[4], nxt, nxt is None))
    return sorted(out, key=str)


@pytest.mark.parametrize("cut", CUTS)
def test_collapse_matches_brute_force(spark, cut):
    rows = _random_feed()
    got = scd2.collapse(spark.createDataFrame(rows, SCHEMA), KEYS, TRACKED, "ts", tiebreak=["seq"],
                            **cut)
    assert sorted([tuple(r) for r in got.collect()], key=str) == _plain_collapse(rows)


def test_properties_one_current_gap_free(spark):
    rows = _random_feed(seed=9)
    got = scd2.collapse(spark.createDataFrame(rows, SCHEMA), KEYS, TRACKED, "ts", tiebreak=["seq"]).collect()
    by = {}
    for r in got:
        by.setdefault((r.app_id, r.currency_code), []).append(r)
    for rs in by.values():
        rs.sort(key=lambda r: (r.valid_from, r.valid_to is None, r.valid_to))
        assert sum(r.is_current for r in rs) == 1
        for a, b in zip(rs, rs[1:]):
            assert a.valid_to == b.valid_from


def test_collapse_is_idempotent(spark):
    rows = _random_feed(seed=5)
    feed = spark.createDataFrame(rows, SCHEMA)
    once = scd2.collapse(feed, KEYS, TRACKED, "ts", tiebreak=["seq"])
    again = scd2.collapse(once.withColumnRenamed("valid_from", "ts").withColumn("seq", F.lit(0)),
                          KEYS, TRACKED, "ts", tiebreak=["seq"])
    a = sorted([(r.app_id, r.price, r.discount_pct, r.valid_from) for r in once.collect()], key=str)
    b = sorted([(r.app_id, r.price, r.discount_pct, r.valid_from) for r in again.collect()], key=str)
    assert a == b


@pytest.mark.parametrize("seed", [1, 2])
def test_apply_equals_collapse_of_union(spark, seed):
    rows = _random_feed(seed=seed)
    split = dt.datetime(2023, 7, 1)
    a = [r for r in rows if r[4] < split]
    b = [r for r in rows if r[4] >= split]
    hist = scd2.collapse(spark.createDataFrame(a, SCHEMA), KEYS, TRACKED, "ts", tiebreak=["seq"])
    applied, late = scd2.apply(hist, spark.createDataFrame(b, SCHEMA), KEYS, TRACKED, "ts", tiebreak=["seq"])
    assert late.count() == 0
    assert sorted([tuple(r) for r in applied.collect()], key=str) == _plain_collapse(rows)


def test_apply_rejects_late_rows_and_is_idempotent(spark):
    hist = scd2.collapse(spark.createDataFrame([(1, "USD", D("1"), 0, T(5), 0)], SCHEMA), KEYS, TRACKED, "ts",
                         tiebreak=["seq"])
    batch = spark.createDataFrame([(1, "USD", D("2"), 0, T(2), 0), (1, "USD", D("1"), 0, T(6), 0)], SCHEMA)
    applied, late = scd2.apply(hist, batch, KEYS, TRACKED, "ts", tiebreak=["seq"])
    assert [r.ts for r in late.collect()] == [T(2)]
    assert applied.count() == 1  # same state again: no-op


def test_collapse_with_one_hot_key(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(900):
        k = 0 if i % 3 else rnd.randrange(1, 30)          # key 0 holds two thirds of the feed
        day = dt.datetime(2022, 1, 1) + dt.timedelta(days=rnd.randrange(700), hours=rnd.randrange(24))
        rows.append((k, "USD", rnd.choice([D("1.00"), D("2.00"), D("3.00")]), rnd.choice([0, 5]), day, i))
    for cut in CUTS:
        got = scd2.collapse(spark.createDataFrame(rows, SCHEMA), KEYS, TRACKED, "ts", tiebreak=["seq"],
                            **cut)
        assert sorted([tuple(r) for r in got.collect()], key=str) == _plain_collapse(rows)


@pytest.mark.parametrize("cut", CUTS)
def test_as_of_join_matches_range_join(spark, cut):
    rows = _random_feed(n_keys=3, n=300, seed=21)
    hist = scd2.collapse(spark.createDataFrame(rows, SCHEMA), KEYS, TRACKED, "ts", tiebreak=["seq"])
    versions = [tuple(r) for r in hist.collect()]
    rnd = random.Random(4)
    facts = [(k, "USD", dt.datetime(2022, 12, 1) + dt.timedelta(hours=rnd.randrange(24 * 480)), i)
             for i, k in enumerate([rnd.randrange(3) for _ in range(200)])]
    fdf = spark.createDataFrame(facts, "app_id long, currency_code string, at timestamp_ntz, fid int")
    got = {r.fid: (r.price, r.discount_pct) for r in
           scd2.as_of_join(fdf, hist, KEYS, "at", ["price", "discount_pct"], **cut).collect()}
    want = {}
    for k, c, at, fid in facts:
        hit = [v for v in versions if v[0] == k and v[1] == c and v[4] <= at and (v[5] is None or v[5] > at)]
        assert len(hit) <= 1
        want[fid] = (hit[0][2], hit[0][3]) if hit else (None, None)
    assert got == want
