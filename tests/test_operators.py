"""Hierarchy, vectors, tags, ingest and quality operators."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ludex.operators import hierarchy as H
from ludex.operators import ingest as IG
from ludex.operators import tags as TG
from ludex.operators import vectors as V

NODES = "dev_id long, name string, parent_dev_id long"


def test_walk_paths_and_cycle_guard(spark):
    nodes = spark.createDataFrame([(1, "A", None), (2, "B", 1), (3, "C", 2), (4, "D", 1),
                                   (5, "X", 6), (6, "Y", 5)], NODES)   # 5 <-> 6 is a cycle without a root
    tree = H.walk(nodes, H.roots_of(nodes), sep=" > ")
    got = sorted((r.path, r.depth) for r in tree.collect())
    assert got == [("A", 0), ("A > B", 1), ("A > B > C", 2), ("A > D", 1)]
    cyc = spark.createDataFrame([(1, "A", None), (2, "B", 1), (1, "A2", 2)], NODES)
    assert H.walk(cyc, H.roots_of(cyc)).count() == 2  # id 1 again below B: guard stops the loop


def test_walk_has_no_depth_limit(spark):
    chain = spark.createDataFrame([(i, f"n{i}", i - 1 if i else None) for i in range(106)],
                                  "dev_id long, name string, parent_dev_id long").repartition(1)
    got = H.walk(chain, H.roots_of(chain))
    assert got.agg(F.count("dev_id"), F.max("depth")).first()[:] == (106, 105)


def test_seed_gives_a_child_to_its_first_parent(spark):
    nodes = spark.createDataFrame([(1, "c", None)], "dev_id long, name string, parent_dev_id long")
    got = sorted(tuple(r) for r in H.seed(nodes, {"p": ["c"], "q": ["c"]}).collect())
    assert got == [(1, "c", 2), (2, "p", None), (3, "q", None)]


def test_walk_linked_only(spark):
    nodes = spark.createDataFrame([(1, "A", None), (2, "B", 1), (9, "Lone", None)], NODES)
    assert [r.name for r in H.roots_of(nodes, linked_only=True).collect()] == ["A"]


def test_seed(spark):
    nodes = spark.createDataFrame([(1, "Treyarch", None), (2, "Other", None), (3, "Beenox", 2)], NODES)
    out = {r.name: (r.dev_id, r.parent_dev_id) for r in
           H.seed(nodes, {"Activision Blizzard": ["Treyarch", "Beenox"], "Ubisoft": []}).collect()}
    assert out["Activision Blizzard"] == (4, None) and out["Ubisoft"] == (5, None)
    assert out["Treyarch"] == (1, 4)
    assert out["Beenox"] == (3, 2)   # already had a parent


def test_knn_matches_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(200)], "id long, v array<float>")
    q = m[7]
    got = [r.id for r in V.knn(df, "v", V.vector_literal(q), 5, tiebreak="id").collect()]
    sims = (m.astype(float) @ q.astype(float)) / (np.linalg.norm(m.astype(float), axis=1) * np.linalg.norm(q))
    assert got == list(np.argsort(-sims)[:5])


def test_embed_and_backfill(spark):
    df = spark.createDataFrame([(1, "good game", None), (2, "bad game", [1.0, 0.0])], "id long, t string, e array<float>")
    out = {r.id: r.e for r in V.backfill(df, "t", "e", dim=8).collect()}
    assert out[2] == [1.0, 0.0] and len(out[1]) == 8
    assert abs(sum(x * x for x in out[1]) - 1) < 1e-5


def test_embed_hands_out_pieces_of_bounded_bytes(spark):
    plain = V.hashing_encoder(8)

    def encoder(texts):
        sizes = [len(x or "") + 1 for x in texts]
        assert sum(sizes) - max(sizes) <= 1 << 20, sizes  # beside the longest text
        return plain(texts)
    rows = [(i, None if i % 50 == 0 else f"w{i} " * (i % 40) * 200) for i in range(300)] + [(300, "long " * (1 << 20)), (301, "")]
    df = spark.createDataFrame(rows, "id long, txt string").coalesce(1)
    got = {r.id: r for r in V.embed(df, "txt", "v", encoder=encoder, dim=8).collect()}
    assert len(got) == 302
    for (i, txt), want in zip(rows, plain(pd.Series([t for _, t in rows]))):
        assert got[i].txt == txt and np.array_equal(np.float32(got[i].v), want)
    small = V.embed(df, "txt", "v", encoder=lambda x: plain(x) if len(x) <= 7 else 1 / 0, dim=8, batch_size=7)
    assert small.count() == 302


def test_pair_counts_symmetric_and_lift(spark):
    gt = spark.createDataFrame([(a, t) for a in range(40) for t in ([1, 2] if a % 2 else [1, 3])],
                               "app_id long, tag_id long")
    p = {(r.tag_a_id, r.tag_b_id): r.together for r in TG.pair_counts(gt).collect()}
    assert p == {(1, 2): 20, (1, 3): 20}
    lift = {(r.tag_a_id, r.tag_b_id): r.lift for r in TG.lift(gt, 1).collect()}
    assert abs(lift[(1, 2)] - 1.0) < 1e-12   # tag 1 is on every game: independent


def test_ingest_ops(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    names = spark.createDataFrame([("b",), ("d",), ("c",), ("d",)], "name string")
    assert sorted(tuple(r) for r in IG.assign_keys(dim, names, "id", "name").collect()) == [("b", 2), ("c", 3), ("d", 4)]
    tgt = spark.createDataFrame([(1, "A", 10.0)], "k long, name string, price double")
    upd = spark.createDataFrame([(1, "Z", 5.0), (2, "B", 7.0)], "k long, name string, price double")
    out = sorted(tuple(r) for r in IG.upsert(tgt, upd, "k", ["price"]).collect())
    assert out == [(1, "A", 5.0), (2, "B", 7.0)]
    merged, inserted = IG.insert_missing(tgt, upd, "k")
    assert merged.count() == 2 and [r.k for r in inserted.collect()] == [2]
    assert [r.k for r in IG.pending(upd, tgt, "k").collect()] == [2]


def test_ingest_keeps_one_row_a_key(spark):
    tgt = spark.createDataFrame([(1, "A", 10.0)], "k long, name string, price double")
    new = spark.createDataFrame([(2, "B", 7.0), (2, "C", 6.0), (2, "B", 8.0), (1, "Z", 1.0), (1, "Y", 2.0)], tgt.schema)
    merged, _ = IG.insert_missing(tgt, new, "k", order=["price"])
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "A", 10.0), (2, "C", 6.0)]
    out = IG.upsert(tgt, new, "k", ["price"], order=["price"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, "A", 2.0), (2, "B", 8.0)]


def test_ledger(spark, tmp_path):
    ledger = str(tmp_path / "done")
    for ids in (range(3), range(2, 5)):
        IG.mark_done(spark.createDataFrame([(i,) for i in ids], "k long"), "k", ledger)
    left = IG.pending(spark.range(7).withColumnRenamed("id", "k"), spark.read.parquet(ledger), "k")
    assert sorted(r.k for r in left.collect()) == [5, 6]


def test_quota_beyond_any_tier(spark):
    """A quota of 1,000 gives 1,000 reviews; ties go to the smaller id, rows without a time come last."""
    import datetime as dt
    rows = [(i, i % 2, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i // 40) if i % 11 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "review_id long, app_id long, review_time timestamp")
    quota = spark.createDataFrame([(0, 10, 100), (1, 1, 1995), (2, 1, 5)], "app_id long, pages int, per_page int")
    got = {(r.app_id, r.review_id) for r in IG.within_quota(df, quota).collect()}
    for app, n in ((0, 1000), (1, 1995)):
        want = sorted((r for r in rows if r[1] == app), key=lambda r: (-(r[2].timestamp() if r[2] else -1e12), r[0]))[:n]
        assert {i for a, i in got if a == app} == {r[0] for r in want}


def test_quota_of_a_hot_key_ranks_one_bucket(spark):
    """Of a key with two thirds of all rows, only the day that holds its last row to keep is ranked."""
    df = spark.range(30_000).select(F.col("id").alias("review_id"), F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("app_id"),
                                    F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 300).alias("review_time"))
    quota = spark.createDataFrame([(-1, 1, 5000)], "app_id long, pages int, per_page int")
    plan = IG.within_quota(df, quota)
    got = [r.review_id for r in plan.collect()]
    hot = sorted((i for i in range(30_000) if i % 3), reverse=True)[:5000]
    assert sorted(got) == sorted(hot)


def test_function_defaults_are_the_fixed_values():
    from inspect import signature

    from ludex import config
    from ludex.plans import categories, market, reviews, search, tags

    def default(fn, name):
        return signature(fn).parameters[name].default
    for fn in (market.top_games, market.top_free, tags.busy_niches, categories.leaderboard, categories.top_by_genre,
               categories.category_niches, categories.category_pick, categories.genre_mix):
        assert default(fn, "filters") is config.DEFAULT_FILTERS
    for fn in (reviews.review_bombs_soft, reviews.review_bombs_feed):
        assert (default(fn, "min_reviews"), default(fn, "threshold")) == (5, 2.0)
    for fn in (reviews.review_lexicon, search.review_search):
        assert (default(fn, "positive"), default(fn, "negative")) == (config.POSITIVE_WORDS, config.NEGATIVE_WORDS)
    assert default(categories.category_genres, "genres") is config.OFFICIAL_GENRES
    assert default(categories.category_niches, "niches") is config.NICHE_TAGS


def test_knn_join_ties_keep_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(20)], "id long, v array<double>").repartition(4)
    got = V.knn_join(df.filter("id < 2"), df, "id", "id", "v", 3, exclude_self=True, block_rows=4).collect()
    assert sorted((r[0], r[1]) for r in got) == [(0, 2), (0, 4), (0, 6), (1, 3), (1, 5), (1, 7)]


def test_constraint_audit_on_sf0001(spark):
    from ludex.operators import quality as Q
    from ludex.sources.warehouse import build
    t = build(spark, "/root/testdata/sf0.001")
    rows = {(r.rule, r.table): r.violations for r in Q.audit(t).collect()}
    assert rows[("one_current", "price_history")] == 0
    assert rows[("pk", "games")] == 0


def test_knn_join_exact_with_chunks(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(120, 6))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(120)], "id long, v array<double>").repartition(3)
    got = V.knn_join(df, df, "id", "id", "v", 3, exclude_self=True, block_rows=25)  # 5 x 5 blocks
    rows = got.collect()
    nm = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = nm @ nm.T
    np.fill_diagonal(sims, -np.inf)
    want = {(q, int(c)) for q in range(120) for c in np.argsort(-sims[q], kind="stable")[:3]}
    got_pairs = {(r[0], r[1]) for r in rows}
    assert got_pairs == want and len(rows) == 360


def test_sequential_ids_dense_in_order(spark):
    names = spark.createDataFrame([(f"n{i:04d}",) for i in range(997)], "name string").repartition(7)
    got = IG.sequential_ids(names, "name", "id", start=10, partitions=5).collect()
    assert sorted((r.name, r.id) for r in got) == [(f"n{i:04d}", 11 + i) for i in range(997)]
