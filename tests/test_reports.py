"""Report writer, parameterised SQL, stored warehouse layout."""

import datetime as dt
import os
import re
import tempfile

from ludex.plans import reports
from ludex.sources.testdata import load
from ludex.sources.warehouse import build, collapse_feed, laid_out, materialize, player_counts, price_feed, price_history, query

SF = "/root/testdata/sf0.001"


def test_write_stats_page(spark):
    t = build(spark, SF)
    root = tempfile.mkdtemp(prefix="ludex-report-")
    paths = reports.write(reports.stats_page(t), root)
    assert set(paths) == {"stats", "top_games", "tag_gaps"}
    assert spark.read.json(paths["stats"]).count() == 1
    assert spark.read.json(paths["top_games"]).count() == 10


def test_query_with_parameters(spark):
    t = build(spark, SF)
    n = query(t, "SELECT count(*) AS n FROM {games} WHERE app_id < :lim", lim=50).first().n
    assert n == t["games"].filter("app_id < 50").count()


def test_materialized_price_history_roundtrip(spark):
    t = build(spark, SF)
    root = tempfile.mkdtemp(prefix="ludex-wh-")
    a = sorted(map(tuple, t["price_history"].collect()), key=str)   # derived, before storing
    st = materialize(t, root, names=["price_history", "games"])
    assert os.path.isdir(os.path.join(root, "price_history", "is_current=true"))
    b = sorted(map(tuple, st["price_history"].collect()), key=str)
    assert a == b
    plan = st["price_history"].filter("is_current AND currency_code = 'USD'")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters" in plan or "partition" in plan.lower()


def _exchanges(df):
    return re.findall(r"(?<!Reused)Exchange (\w+)", df._jdf.queryExecution().executedPlan().toString())


def test_price_history_is_shuffled_and_sorted_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # parts too many to broadcast
    try:
        raw = load(spark, SF)
        df = laid_out(price_history(raw), "price_history")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert _exchanges(df) == ["hashpartitioning"] * 2  # line items, parts
        assert "SortMergeJoin" not in plan and len(re.findall(r"\bSort \[", plan)) == 2  # windows, files
        assert "_tb2" not in plan and "_tb3" not in plan  # price and discount break ties as they are
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_player_counts_are_shuffled_once(spark):
    df = laid_out(player_counts(load(spark, SF)), "player_counts")
    assert _exchanges(df) == ["rangepartitioning"]


def test_price_history_of_repeated_and_missing_parts(spark):
    day = dt.datetime(1998, 1, 1)
    items = [(i, k, 1, 1, 3.0, 0.01 * (i % 3), 0.02, "O" if i % 2 else "F", day + dt.timedelta(days=i % 7))
             for i in range(60) for k in (7, 8, 9, None)]
    raw = {"lineitem": spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                                    "l_discount double, l_tax double, l_linestatus string, l_shipdate timestamp_ntz"),
           "part": spark.createDataFrame([(7, 10), (7, 30), (8, 3), (None, 4)], "p_partkey long, p_size int")}
    plain = collapse_feed(price_feed(raw))
    got = price_history(raw)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert {r.app_id for r in got.collect()} == {7, 8}
