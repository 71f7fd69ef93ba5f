"""Tables of a load that become visible together: partitions written per batch, one commit record.

Plain Parquet has neither MERGE nor transactions.  Every table is a folder partitioned by
``batch`` (and by what else its writer names).  A batch writes its own partitions with dynamic
partition overwrite, so a batch that runs again replaces what it wrote before, and nothing else;
its commit record, one small file written last, makes all its partitions visible at once.
Batches are numbered upwards and run one at a time, as a stream's micro-batches do; readers take
the batches up to the newest commit.

Two kinds of tables:

* appended ones: a batch adds rows (snapshots, closed price versions, late rows);
* replaced ones: rows are dealt to ``buckets`` by a hash of their key; a batch writes the whole new
  content of the buckets that it touches, and the commit record names, for each bucket, the
  batch whose partition is the live one.  Bytes written follow the buckets touched, not the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_COMMIT = "batch bigint, at timestamp, live map<string,array<struct<bucket:int,batch:bigint>>>, counts map<string,bigint>"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Path check through the Hadoop FileSystem (works for HDFS / object stores)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Store:
    """The tables under ``root``; ``buckets``: how many a replaced table has."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def newest(self, before: int | None = None):
        """The newest commit record (older than ``before``), or None."""
        path = f"{self.root}/commits"
        if not path_exists(self.spark, path):
            return None
        commits = self.spark.read.schema(_COMMIT).parquet(path)
        commits = commits if before is None else commits.where(F.col("batch") < before)
        return commits.orderBy(F.desc("batch")).limit(1).first()

    def _table(self, name: str, schema: str, parts: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], f"{schema}, {parts}")
        return self.spark.read.schema(f"{schema}, {parts}").parquet(path)

    def appended(self, name: str, schema: str, before: int | None = None, keep_batch: bool = False) -> DataFrame:
        """The visible rows of an appended table (``keep_batch``: with their batch)."""
        commit = self.newest(before)
        rows = self._table(name, schema, "batch bigint")
        rows = rows.where(F.col("batch") <= (commit["batch"] if commit else -1))
        return rows if keep_batch else rows.drop("batch")

    def replaced(self, name: str, schema: str, before: int | None = None, only=None) -> DataFrame:
        """The visible rows of a replaced table; ``only``: of these buckets.

        The filter is on partition columns alone: dead and other partitions aren't read."""
        commit = self.newest(before)
        live = (commit["live"].get(name) or []) if commit else []
        spots = [f"{x['bucket']}/{x['batch']}" for x in live if only is None or x["bucket"] in only]
        rows = self._table(name, schema, "bucket int, batch bigint")
        return rows.where(F.concat_ws("/", "bucket", "batch").isin(spots) if spots else F.lit(False)).drop("bucket", "batch")

    def write(self, name: str, rows: DataFrame, batch: int, bucket: str | None = None) -> int:
        """Write a batch's partitions of a table; returns the rows written, counted by the write itself.

        ``bucket``: the key of a replaced table."""
        seen = Observation()
        rows = rows.withColumn("batch", F.lit(batch).cast("bigint"))
        parts = ["batch"]
        if bucket:
            rows, parts = rows.withColumn("bucket", bucket_of(bucket, self.buckets)), ["bucket", "batch"]
            rows = rows.repartition(F.col("bucket"))  # a file a bucket
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.root}/{name}")
        return seen.get["n"]

    def commit(self, batch: int, at, touched: dict[str, list[int]] | None = None, counts: dict[str, int] | None = None) -> None:
        """Make a batch visible.  ``touched``: the buckets that it wrote of each replaced table."""
        before = self.newest(batch)
        live = {name: {x["bucket"]: x["batch"] for x in xs} for name, xs in before["live"].items()} if before else {}
        for name, buckets in (touched or {}).items():
            live.setdefault(name, {}).update(dict.fromkeys(buckets, batch))
        rows = {name: sorted(xs.items()) for name, xs in live.items()}
        record = self.spark.createDataFrame([(batch, at, rows, counts or {})], _COMMIT)
        record.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/record={batch}")

    def expire(self, name: str) -> int:
        """Delete the partitions of a replaced table that neither the newest commit nor the one before it reads."""
        newest = self.newest()
        if newest is None:
            return 0
        kept = {(x["bucket"], x["batch"]) for c in (newest, self.newest(newest["batch"])) if c for x in c["live"].get(name) or []}
        rows = self._table(name, "_none int", "bucket int, batch bigint")
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        dead = [r for r in rows.where(F.col("batch") <= newest["batch"]).select("bucket", "batch").distinct().collect() if tuple(r) not in kept]
        for r in dead:  # at most buckets x batches since the last call
            p = fs.Path(f"{self.root}/{name}/bucket={r['bucket']}/batch={r['batch']}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return len(dead)
