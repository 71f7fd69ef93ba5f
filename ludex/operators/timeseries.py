"""Time-series operators: moving average (W2), z-score (W3/W4), change (W5),
trailing interval (F11), daily counts.

z-scores use a per-key aggregate (partial aggregation, so a hot key is
pre-reduced on every map task) joined back to the rows; AQE's skew-join
handling splits the big side of a hot key.  Moving averages and LAG use the
sequence operators, which cut hot keys into runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludex.operators.sequence import lag_within, rolling_avg


def moving_avg(df: DataFrame, key, ts: str, value: str, n: int, out: str) -> DataFrame:
    """AVG(value) over the current and n-1 preceding rows of the key, by ts."""
    return rolling_avg(df, key, [ts], value, n, out)


def zscore(df: DataFrame, key, value: str, out: str = "z", mean_out: str | None = None,
           sd_out: str | None = None) -> DataFrame:
    """(value - mean) / NULLIF(stddev_samp, 0) with mean/sd over the whole key."""
    keys = [key] if isinstance(key, str) else list(key)
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    out_df = df.join(stats, keys).withColumn(
        out, (F.col(value) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0)))
    if mean_out:
        out_df = out_df.withColumnRenamed("_mean", mean_out)
    if sd_out:
        out_df = out_df.withColumnRenamed("_sd", sd_out)
    return out_df.drop("_mean", "_sd")


def change(df: DataFrame, key, ts: str, value: str) -> DataFrame:
    """value - LAG(value) and its percent of LAG(value) (NULL when LAG is 0/NULL)."""
    lagged = lag_within(df, key, [ts], [value], prefix="_prev_")
    prev = F.col("_prev_" + value)
    return (lagged.withColumn("change", F.col(value) - prev)
                  .withColumn("pct_change", F.lit(100.0) * (F.col(value) - prev) / F.nullif(prev, F.lit(0)))
                  .drop("_prev_" + value))


def trailing(df: DataFrame, ts: str, days: int, now: str | None = None) -> DataFrame:
    """Rows with ``ts > now - days`` (``now`` explicit for reproducible runs)."""
    anchor = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()
    return df.filter(F.col(ts) > anchor - F.make_dt_interval(F.lit(days)))


def daily_counts(reviews: DataFrame, key: str = "app_id", ts: str = "review_time",
                 flag: str = "is_positive", min_total: int = 0) -> DataFrame:
    """Per (key, UTC day): negative, positive and total counts (HAVING total >= min_total)."""
    g = reviews.groupBy(key, F.to_date(F.col(ts)).alias("review_day")).agg(
        F.count_if(F.col(flag) == F.lit(False)).alias("negative_count"),
        F.count_if(F.col(flag) == F.lit(True)).alias("positive_count"),
        F.count(F.lit(1)).alias("total_count"))
    return g.filter(F.col("total_count") >= min_total) if min_total else g
