"""Helpers shared by the corpus operators: table access, stored intermediates, run iteration."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ludex.session import checkpoint_dir

#: MB of rows that a Python worker gets at once.
BATCH_MB = 4

#: Word characters of every contract: anything but space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions to deal rows out to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    Cuts the lineage like a checkpoint, but as a columnar table: later readers prune
    columns, and a lost executor re-reads its part of the files.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` whose workers get batches of about ``BATCH_MB`` MB: long texts aren't
    gathered to ten thousand in the JVM's and the worker's memory.  A session that has its own
    setting keeps it.  It is read when the rows are asked for, so it stays set."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == "67108864b":  # Spark's default
        conf.set(name, f"{BATCH_MB}m")
    return df.mapInArrow(fn, schema)


def crc_bucket(col: str | Column, n: int) -> Column:
    """crc32 of an id as text, modulo n (null ids: the empty text)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def texts(batch: pa.RecordBatch | pa.Table, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null texts are empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut a partition sorted by integer ``keys`` into runs of equal keys.

    Yields (table, bounds): run i is rows bounds[i]..bounds[i+1] of the table.  A run that
    crosses batches is carried on, so only one run at a time is held beyond a batch.
    """
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change) + 1
        first = tuple(c[0] for c in cols)
        if last is not None and first != last:
            t = pa.concat_tables(held)
            yield t, np.array([0, t.num_rows])
            held = []
        last = tuple(c[-1] for c in cols)
        t = pa.Table.from_batches([batch])
        if len(cuts):
            if held:
                whole = pa.concat_tables([*held, t.slice(0, cuts[-1])])
                shift = whole.num_rows - cuts[-1]
                yield whole, np.concatenate([[0], cuts + shift])
            else:
                yield t.slice(0, cuts[-1]), np.concatenate([[0], cuts])
            held = [t.slice(cuts[-1])]
        else:
            held.append(t)
    if held:
        t = pa.concat_tables(held)
        yield t, np.array([0, t.num_rows])


def split_hot(rows: DataFrame, key: str, member: str, cap: int) -> DataFrame:
    """Blocks of bounded size for pairwise work within equal keys.

    Keys with one member go.  A key with n members is cut into c = ceil(n / cap) chunks by
    the member's hash, and chunk u goes to the blocks (u, w) for every chunk w, so each pair
    of members meets in exactly one block of at most about 2 * cap rows.  Adds ``bi``, ``bj``
    (the block) and ``u`` (the row's chunk).
    """
    size = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    chunks = F.ceil(F.col("_n") / cap).cast("int")
    return (rows.join(size, key)
            .withColumn("_c", chunks)
            .withColumn("u", F.pmod(F.xxhash64(F.col(member)), F.col("_c").cast("long")).cast("int"))
            .withColumn("_w", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
            .withColumn("bi", F.least("u", "_w")).withColumn("bj", F.greatest("u", "_w"))
            .drop("_n", "_c", "_w"))


def find(parent: np.ndarray | list, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i
