"""Feed readers on literal files."""

import json
import os
from decimal import Decimal

from ludex.sources import files as FS


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_snapshot_defaults_and_latest_file(spark, tmpdir_session):
    d = os.path.join(tmpdir_session, "snap")
    _write(f"{d}/steamspy_snapshot_2024-01-01.csv", "app_id,name,snapshot_time,owners,price,discount\n1,Old,,,,\n")
    _write(f"{d}/steamspy_snapshot_2024-01-02.csv",
           "app_id,name,snapshot_time,owners,price,discount\n"
           "10,Game,2024-01-02T09:00:00,\"1,000 .. 2,000\",1999,10\n11,,,,,\n")
    rows = sorted(FS.read_snapshot(spark, d).collect(), key=lambda r: r.app_id)
    assert [r.app_id for r in rows] == [10, 11]
    assert rows[0].price == Decimal("19.99") and rows[0].discount_pct == 10
    assert rows[1].name == "app_11" and rows[1].owners_estimate == "0" and rows[1].price == Decimal("0.00")
    assert rows[1].snapshot_time is not None
    # the listing reads no content, and only the newest file is scanned
    assert FS.latest_path(spark, d).endswith("2024-01-02.csv")
    os.utime(f"{d}/steamspy_snapshot_2024-01-01.csv", (4_000_000_000, 4_000_000_000))
    assert FS.latest_path(spark, d, by="time").endswith("2024-01-01.csv")
    assert "2024-01-01" not in FS.read_snapshot(spark, d)._jdf.queryExecution().executedPlan().toString()


def test_app_details(spark, tmpdir_session):
    p = os.path.join(tmpdir_session, "apps", "appdetails.json")
    _write(p, json.dumps([
        {"appid": 1, "name": "A", "developer": "D", "initialprice": "1999", "price": "999", "discount": "50",
         "ccu": 5, "owners": "0 .. 20,000", "tags": {"FPS": 3, "Action": 1}, "genre": "Action, Indie"},
        {"appid": 2, "name": "B", "tags": [], "genre": ["RPG", " "]},
    ]))
    rows = sorted(FS.read_app_details(spark, p).collect(), key=lambda r: r.app_id)
    assert rows[0].base_price_usd == Decimal("19.99") and rows[0].price == Decimal("9.99")
    assert sorted(rows[0].tags) == ["Action", "FPS"] and rows[0].genres == ["Action", "Indie"]
    assert rows[1].developer == "Unknown" and rows[1].tags == [] and rows[1].genres == ["RPG"]
    assert rows[1].base_price_usd == Decimal("0.00")


def test_reviews_flat_and_store(spark, tmpdir_session):
    flat = os.path.join(tmpdir_session, "rev", "reviews.json")
    _write(flat, json.dumps([{"review_id": 5, "app_id": 1, "review_text": "x", "review_time": 86400,
                              "is_positive": True, "playtime_at_review": 30}]))
    r = FS.read_reviews(spark, flat).collect()[0]
    assert r.review_time.year == 1970 and r.review_time.day == 2
    store = os.path.join(tmpdir_session, "rev2", "store.json")
    _write(store, json.dumps([{"recommendationid": "77", "review": "good", "timestamp_created": 0,
                               "voted_up": False, "author": {}}]))
    s = FS.read_reviews(spark, store, store_payload=True, app_id=9).collect()[0]
    assert (s.review_id, s.app_id, s.is_positive, s.playtime_at_review) == (77, 9, False, 0)


def test_price_payload_cases(spark):
    payload = {
        "1": {"success": False},
        "2": {"success": True, "data": []},
        "3": {"success": True, "data": {"price_overview": {"currency": "USD", "final": 999}}},
        "4": {"success": True, "data": {"price_overview": {"currency": "INR", "final": 49900, "discount_percent": 10}}},
        "5": {"success": True, "data": {"is_free": True}},
        "6": {"success": True, "data": {"price_overview": {"currency": "INR", "final": None}}},
    }
    df = spark.createDataFrame([(json.dumps(payload),)], "payload string")
    got = {r.app_id: (r.price, r.discount_pct) for r in FS.parse_price_payload(df).collect()}
    assert got == {2: (Decimal("0.00"), 0), 4: (Decimal("499.00"), 10), 5: (Decimal("0.00"), 0)}


def test_snapshot_missing_price_option(spark, tmpdir_session):
    d = os.path.join(tmpdir_session, "snap_null")
    _write(f"{d}/steamspy_snapshot_2024-02-01.csv", "app_id,name,snapshot_time,owners,price,discount\n5,X,,,,\n")
    assert FS.read_snapshot(spark, d).collect()[0].price == Decimal("0.00")
    assert FS.read_snapshot(spark, d, missing_price="null").collect()[0].price is None
