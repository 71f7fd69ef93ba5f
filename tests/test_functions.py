"""Literal cases of the reference's helpers (FIXTURES.md section 2)."""

from decimal import Decimal

from pyspark.sql import functions as F

from ludex.functions import labels as L
from ludex.functions import predicates as P
from ludex.operators import text as TX


def col_values(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


def test_parse_genres_reference_asserts(spark):
    vals = col_values(spark, [("Action, Free To Play",), ("",), (None,),
                              ("Casual, Indie, Animation & Modeling, Design & Illustration, Photo Editing, Utilities",)],
                      "g string", L.parse_genres(F.col("g")))
    assert vals[0] == ["Action", "Free To Play"]
    assert vals[1] == []
    assert vals[2] == []
    assert vals[3] == ["Casual", "Indie", "Animation & Modeling", "Design & Illustration", "Photo Editing", "Utilities"]


def test_parse_genre_field_list_and_string(spark):
    vals = col_values(spark, [('["Action", " RPG ", ""]',), ("Action, RPG",), (None,)], "g string",
                      L.parse_genre_field(F.col("g")))
    assert vals == [["Action", "RPG"], ["Action", "RPG"], []]


def test_tag_names_object_or_empty_list(spark):
    vals = col_values(spark, [('{"FPS": 10, "Action": 3}',), ("[]",), (None,)], "t string", L.tag_names(F.col("t")))
    assert sorted(vals[0]) == ["Action", "FPS"]
    assert vals[1] == [] and vals[2] == []


def test_owners_lo(spark):
    vals = col_values(spark, [("10,000,000 .. 20,000,000",), ("0",), (None,), ("",)], "o string",
                      L.owners_lo(F.col("o")))
    assert vals == [10000000, 0, None, None]


def test_compact(spark):
    vals = col_values(spark, [(999,), (1500,), (35510000,), (1000,), (-2500,), (2_400_000_000,)], "n long",
                      L.compact(F.col("n")))
    assert vals == ["999", "2k", "36m", "1k", "-3k", "2b"]


def test_owners_label(spark):
    vals = col_values(spark, [("10,000,000 .. 20,000,000",), ("0",), (None,), ("5000",), ("n/a",)], "o string",
                      L.owners_label(F.col("o")))
    assert vals == ["10m–20m", "—", "—", "5k", "n/a"]


def test_price_labels(spark):
    df = spark.createDataFrame([(Decimal("29.99"), Decimal("2499.00")), (Decimal("0.00"), None),
                                (None, Decimal("249900.50")), (None, None)], "usd decimal(10,2), inr decimal(10,2)")
    out = [r[0] for r in df.select(L.store_price_label("usd", "inr")).collect()]
    assert out == ["$29.99 · ₹2,499", "Free", "₹2,49,900.50", "—"]


def test_hours_label(spark):
    vals = col_values(spark, [(720,), (90,), (40,), (None,)], "m int", L.hours_label(F.col("m")))
    assert vals == ["12h", "1.5h", "40m", "—"]


def test_review_quota(spark):
    vals = col_values(spark, [(9,), (10,), (199,), (999,), (1000,)], "r int", L.review_quota(F.col("r")))
    assert [(v["pages"], v["per_page"]) for v in vals] == [(5, 100), (2, 100), (1, 100), (1, 50), (1, 8)]


def test_lexicon(spark):
    df = spark.createDataFrame([("Fun, but BUGS! broken",), ("great great",), ("",)], "t string")
    rows = TX.with_lexicon(df, "t").collect()
    assert (rows[0].lex_pos, rows[0].lex_neg, rows[0].lex_score, rows[0].lex_label) == (1, 2, -1, "negative")
    assert (rows[1].lex_pos, rows[1].lex_label) == (2, "positive")
    assert rows[2].lex_label == "neutral"


def test_name_rule(spark):
    names = ["My SDK", "SDKs", "Foo Dedicated  Server", "wallpaper engine 2", "Playtester", "Soundtrack: Vol 1",
             "Half-Life"]
    vals = col_values(spark, [(n,) for n in names], "name string", P.name_is_game(F.col("name")))
    assert vals == [False, True, False, False, True, False, True]


def _free_case(spark, base, cur_rows, f2p):
    """base price, current USD rows [(price)], has F2P tag -> is_free."""
    games = spark.createDataFrame([(1, base)], "app_id long, base_price_usd decimal(10,2)")
    ph = spark.createDataFrame([(1, "USD", p, True) for p in cur_rows],
                               "app_id long, currency_code string, price decimal(10,2), is_current boolean")
    tags = spark.createDataFrame([(1, "Free to Play"), (2, "Action")], "tag_id long, tag_name string")
    gt = spark.createDataFrame([(1, 1)] if f2p else [(1, 2)], "app_id long, tag_id long")
    t = {"price_history": ph, "game_tags": gt, "tags": tags}
    return P.with_is_free(games, t).collect()[0].is_free


def test_is_free_seven_cases(spark):
    D = Decimal
    assert _free_case(spark, D("0"), [], False) is True
    assert _free_case(spark, D("9.99"), [], False) is False
    assert _free_case(spark, None, [], False) is None
    assert _free_case(spark, None, [], True) is True
    assert _free_case(spark, None, [None], True) is None      # a current row with unknown price
    assert _free_case(spark, None, [D("0")], False) is True
    assert _free_case(spark, D("0"), [D("4.99")], False) is False


def test_name_search_wildcards_are_literal(spark):
    from ludex.plans.search import name_search
    games = spark.createDataFrame([(1, "100% Orange"), (2, "1000 Miles"), (3, "Orange 100%")], "app_id long, name string")
    pc = spark.createDataFrame([], "app_id long, snapshot_time timestamp_ntz, concurrent_players int, owners_estimate string")
    out = name_search({"games": games, "player_counts": pc}, q="100%").collect()
    assert [r.app_id for r in out] == [1, 3]


def test_full_count_and_short_labels(spark):
    vals = col_values(spark, [(1234,), (None,)], "n long", L.full_count(F.col("n")))
    assert vals == ["1,234", "—"]
    vals = col_values(spark, [("A very long category name",), ("Short",)], "s string", L.short_label(F.col("s"), 10))
    assert vals == ["A very lo…", "Short"]
    vals = col_values(spark, [("10,000,000 .. 20,000,000",)], "s string", L.short_band(F.col("s"), 40))
    assert vals == ["10000000–20000000"]


def test_parse_num(spark):
    vals = col_values(spark, [("1,234",), ("abc",), ("",)], "s string", L.parse_num(F.col("s")))
    assert vals == [1234.0, None, 0.0]
