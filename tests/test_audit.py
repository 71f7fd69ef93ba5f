"""The one-pass audit on tables with planted violations."""

import datetime as dt

from ludex.operators import quality as Q


def test_planted_violations(spark):
    T = dt.datetime(2024, 1, 1)
    t = {
        "developers": spark.createDataFrame([(1, "a", None), (2, "a", 1), (2, None, 9), (3, "b", 8)], "dev_id long, name string, parent_dev_id long"),
        "games": spark.createDataFrame([(1, "x", 1), (2, None, 7), (None, "y", None), (None, "z", 1)], "app_id long, name string, dev_id long"),
        "tags": spark.createDataFrame([(1, "t"), (2, "t"), (3, "t")], "tag_id long, tag_name string"),
        "game_tags": spark.createDataFrame([(1, 1), (1, 1), (1, 2), (5, 1), (5, 99), (None, 1)], "app_id long, tag_id long"),
        "genres": spark.createDataFrame([], "genre_id long, genre_name string"),
        "game_genres": spark.createDataFrame([(1, 1), (2, 1)], "app_id long, genre_id long"),
        "price_history": spark.createDataFrame([(1, "USD", True), (1, "USD", True), (1, "USD", False), (1, "INR", True), (6, "USD", False)],
                                               "app_id long, currency_code string, is_current boolean"),
        "player_counts": spark.createDataFrame([(1, T), (1, T), (1, None), (1, None), (3, T)], "app_id long, snapshot_time timestamp_ntz"),
        "reviews": spark.createDataFrame([(i, 1 if i % 2 else 77) for i in range(50)] + [(0, 1)], "review_id long, app_id long"),
    }
    got = {(r.rule, r.table): r.violations for r in Q.audit(t).collect()}
    want = {
        ("pk", "developers"): 1, ("unique_name", "developers"): 1, ("fk_parent", "developers"): 2, ("not_null_name", "developers"): 1,
        ("pk", "games"): 1, ("not_null_name", "games"): 1, ("fk_dev", "games"): 1, ("pk", "tags"): 0, ("unique_name", "tags"): 1, ("not_null_name", "tags"): 0,
        ("pk", "game_tags"): 1, ("fk_app", "game_tags"): 2, ("fk_tag", "game_tags"): 1, ("pk", "genres"): 0, ("unique_name", "genres"): 0,
        ("not_null_name", "genres"): 0, ("pk", "game_genres"): 0, ("fk_app", "game_genres"): 0, ("fk_genre", "game_genres"): 2,
        ("fk_app", "price_history"): 1, ("one_current", "price_history"): 1, ("pk", "player_counts"): 2, ("fk_app", "player_counts"): 1,
        ("pk", "reviews"): 1, ("fk_app", "reviews"): 25,
    }
    assert got == want


def test_every_key_is_read_once_and_alone(spark):
    from ludex.sources.warehouse import build, materialize
    import tempfile

    stored = materialize(build(spark, "/root/testdata/sf0.001"), tempfile.mkdtemp(prefix="ludex-audit-"))
    plan = Q.audit(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len(Q.RULES)
    assert plan.count("Join") == 1  # the rules' list with their counts
