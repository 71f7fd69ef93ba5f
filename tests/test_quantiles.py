"""Exact quantiles against the built-in aggregate; sketch error bounds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ludex.operators import quantiles as Q


def _skewed(spark):
    """A key with two thirds of the rows, log-normal values; small keys, ties, nulls, a null key."""
    r = random.Random(3)
    rows = [(1, r.lognormvariate(0, 3)) for _ in range(20_000)]
    rows += [(k, float(r.randrange(3))) for k in range(2, 40) for _ in range(r.randrange(1, 400))]
    rows += [(None, 5.5), (None, 6.5), (50, None), (51, None), (51, 1.25)]
    return spark.createDataFrame(rows, "k int, v double").repartition(5)


@pytest.mark.parametrize("q", [0.5, 0.0, 0.25, 0.9, 0.999, 1.0])
def test_equals_percentile(spark, q):
    df = _skewed(spark)
    want = {r.k: r.m for r in df.where("v IS NOT NULL").groupBy("k").agg(F.percentile("v", F.lit(q)).alias("m")).collect()}
    for accuracy in (100, 10_000):
        got = {r.k: r.median for r in Q.exact_quantile(df, "k", "v", q, accuracy=accuracy).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)


def test_only_the_bracket_is_ordered(spark):
    """Of a hot key's distinct values few are kept apart."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * F.lit(0.37)).alias("v"))
    out = Q.exact_quantile(df, "k", "v", also=[F.count(F.lit(1)), F.max("v")]).collect()
    assert [tuple(r) for r in out] == [(1, 200_000, 199_999 * 0.37, pytest.approx(199_999 * 0.37 / 2))]
    sketch = df.agg(F.percentile_approx("v", [0.4998, 0.5002], 10_000).alias("b")).first()["b"]
    assert df.where(F.col("v").between(*sketch)).count() < 2_000


def test_trailing_estimates_merge_days(spark):
    r = random.Random(9)
    rows = [(r.randrange(2), r.randrange(3000), dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(24 * 60)), r.lognormvariate(2, 1)) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "g int, app long, ts timestamp, v double")
    daily = Q.daily_sketches(df, "g", "ts", "app", "v")
    assert daily.count() == 120
    for days in (1, 7, 45):
        until = dt.date(2024, 2, 20)
        got = {x.g: x for x in Q.trailing_estimates(daily, "g", str(until), days, (0.1, 0.5, 0.99)).collect()}
        for g in (0, 1):
            part = [x for x in rows if x[0] == g and until - dt.timedelta(days=days) < x[2].date() <= until]
            assert got[g].rows == len(part)
            apps = len({x[1] for x in part})
            assert abs(got[g].distinct - apps) <= max(1, 0.06 * apps)
            for q in (0.1, 0.5, 0.99):
                rank = sum(x[3] <= got[g][f"q_{round(100 * q)}"] for x in part) / len(part)
                assert abs(rank - q) <= 0.02 + 1 / len(part)
