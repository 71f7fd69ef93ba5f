"""Ingest operators (K1-K7, S7, F19): set-based forms of the reference's
per-row upserts.

Every operator is a join plan over whole tables: no per-row round trips, no
collect.  ``store.Store`` writes a load's tables and makes them visible together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ludex.session import checkpoint_dir


def sequential_ids(df: DataFrame, order_col: str, id_col: str, start=0, partitions: int | None = None) -> DataFrame:
    """Dense ids ``start + 1, start + 2, ...`` in ``order_col`` order (values distinct).

    No single-task window: rows are range-partitioned by ``order_col``,
    numbered inside each range, and shifted by the row count of the earlier
    ranges (a window over one row per partition).  The ranges come from a
    sample, so the numbered rows are checkpointed: a second evaluation could
    cut them elsewhere."""
    checkpoint_dir(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(n, order_col).withColumn("_pid", F.spark_partition_id())
    r = r.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(order_col))).checkpoint()
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    start_col = start if isinstance(start, F.Column) else F.lit(start)
    return (r.join(F.broadcast(offs), "_pid")
             .withColumn(id_col, (start_col + F.col("_off") + F.col("_rn")).cast("bigint"))
             .drop("_pid", "_rn", "_off"))


def assign_keys(dim: DataFrame, names: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """K1: ids for every name in ``names``; names not in ``dim`` get new ids
    after the current max, in name order.  Returns (name, id) for all names.

    The new-name set (the dimension delta) is numbered with ``sequential_ids``."""
    incoming = names.select(name_col).distinct()
    new = incoming.join(dim.select(name_col), name_col, "left_anti")
    max_id = dim.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint")).scalar()
    new = sequential_ids(new.select(name_col), name_col, id_col, start=max_id).select(name_col, id_col)
    known = incoming.join(dim.select(name_col, id_col), name_col)
    return known.unionByName(new)


def one_per_key(df: DataFrame, keys, order=(), last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``, then by the other columns: a partial aggregate."""
    rest = [*order, *[c for c in df.columns if c not in keys and c not in order]]
    if not rest:
        return df.distinct()
    pick = F.max if last else F.min
    return df.groupBy(*keys).agg(pick(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def upsert(target: DataFrame, updates: DataFrame, key, update_cols, order=()) -> DataFrame:
    """K2: insert new keys; for existing keys only ``update_cols`` change
    (``ON CONFLICT DO UPDATE SET col = EXCLUDED.col``).  Of several updates of a
    key the last by ``order`` (columns of ``updates``; ties: the largest row) counts."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = target.columns
    updates = one_per_key(updates, keys, order, last=True)
    u = updates.select(*keys, *[F.col(c).alias("_u_" + c) for c in cols if c not in keys])
    j = target.withColumn("_t", F.lit(True)).join(u.withColumn("_n", F.lit(True)), keys, "full_outer")
    out = []
    for c in cols:
        if c in keys:
            out.append(F.col(c))
        elif c in update_cols:
            out.append(F.when(F.col("_n").isNotNull(), F.col("_u_" + c)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_t").isNotNull(), F.col(c)).otherwise(F.col("_u_" + c)).alias(c))
    return j.select(*out)


def insert_missing(target: DataFrame, new: DataFrame, key, order=()) -> tuple[DataFrame, DataFrame]:
    """K3-K6: insert-or-ignore on ``key``.  Returns (target after insert, the
    rows really inserted) -- count the second for the loader's report.  Of
    several new rows of a key the first by ``order`` (ties: the smallest row) is kept."""
    keys = [key] if isinstance(key, str) else list(key)
    fresh = one_per_key(new, keys, order).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns)), fresh


def newest_per_key(df: DataFrame, limits: DataFrame, key: str, newest: str, tiebreak: str, limit: str = "_most",
                   bucket: Column | None = None) -> DataFrame:
    """The ``limit`` newest rows of each key, as ``limits`` (key, limit) has them, whatever the limit.

    In two phases, so that no key is ranked whole in one task: counts per (key, bucket
    of time; the day by default) find the bucket that holds the key's last row to keep.  Newer buckets
    pass as they are; only rows of that bucket are ranked, and only down to what is left of the limit.
    Ties go to the smaller ``tiebreak``; rows without a time come last.
    """
    bucket = F.date_trunc("day", F.col(newest)) if bucket is None else bucket
    rows = df.withColumn("_b", F.coalesce(bucket.cast("timestamp"), F.lit("0001-01-01").cast("timestamp")))
    counts = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n")).join(limits.select(key, F.col(limit).alias("_limit")), key)
    later = Window.partitionBy(key).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    counts = counts.withColumn("_left", F.col("_limit") - F.coalesce(F.sum("_n").over(later), F.lit(0))).where("_left > 0")
    kept = rows.join(counts.select(key, "_b", "_n", "_left"), [key, "_b"])
    whole = kept.where(F.col("_n") <= F.col("_left"))
    w = Window.partitionBy(key, "_b").orderBy(F.desc_nulls_last(newest), tiebreak)
    cut = kept.where(F.col("_n") > F.col("_left")).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col("_left"))
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


def within_quota(reviews: DataFrame, quota: DataFrame, key: str = "app_id", newest: str = "review_time",
                 tiebreak: str = "review_id") -> DataFrame:
    """Each game's newest ``pages * per_page`` reviews, whatever quotas ``quota`` (key, pages, per_page) holds."""
    return newest_per_key(reviews, quota.select(key, (F.col("pages") * F.col("per_page")).alias("_most")), key, newest, tiebreak)


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume ledger -- rows whose key is not in the ``done`` ledger."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def missing(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """rows lacking a related row in ``other``."""
    return df.join(other.select(key), key, "left_anti")


def mark_done(done: DataFrame, key: str, ledger: str) -> None:
    """Append keys that are done to the ledger (a Parquet folder); repeats do no harm."""
    done.select(key).distinct().write.mode("append").parquet(ledger)
