"""Token-id files: Simple-8b word-aligned coding in blocks of whole documents.

A 64-bit word holds a 4-bit selector and 60 bits of ids of one width: selector s packs
``COUNTS[s]`` ids of ``60 // COUNTS[s]`` bits.  Ids of more than 60 bits escape: the stream
holds 0 in their place and the block lists (position, value).  A block holds whole documents
(at least ``block_ids`` ids, or the last of its shard) with their lengths and its first id's
place in the shard, so any block decodes by itself, selector by selector in whole arrays.
A file is a Parquet table of blocks, which Spark can write to and read from any store.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import parts
from .encoding import encoder

#: Ids per word of each selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = tuple(60 // c for c in COUNTS)

BLOCK = ("shard int, seq int, first bigint, n_ids bigint, doc_ids array<{id}>, lengths array<bigint>, "
         "words binary, escape_at array<bigint>, escape_value array<bigint>")


_SMALL = np.array([v.bit_length() for v in range(1 << 16)], np.uint8)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    high = int(values.max()) if len(values) else 0
    if high < 1 << 16:
        return _SMALL[values.astype(np.uint16)]
    out = np.zeros(len(values), np.uint8)
    for shift in range(0, high.bit_length(), 16):
        part = (values >> np.uint64(shift)) & np.uint64(0xFFFF)
        out = np.where(part > 0, _SMALL[part] + shift, out).astype(np.uint8)
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-negative ids -> (words uint64, escape positions, escaped values)."""
    ids = np.asarray(ids, np.uint64)
    at = np.flatnonzero(ids >> np.uint64(60))
    values = ids[at]
    padded = np.zeros(len(ids) + COUNTS[0], np.uint64)
    padded[:len(ids)] = ids
    padded[at] = 0
    n = len(ids)
    # a selector that fits makes all of fewer ids fit, so the first that fits is told by how
    # many don't; most[c] is the largest bit length among the c ids from each place
    most = {1: _bit_lengths(padded)}
    for c in range(2, COUNTS[0] + 1):
        if c in COUNTS:
            a = max(x for x in most if x < c and 2 * x >= c)
            most[c] = np.maximum(most[a][:len(padded) - c + 1], most[a][c - a:][:len(padded) - c + 1])
    pick = np.zeros(n, np.uint8)
    for c, w in zip(COUNTS[:-1], WIDTHS[:-1]):
        pick += (most[c][:n] > w).view(np.uint8)
    step = np.array(COUNTS, np.uint8)[pick].tobytes()
    where, i = [], 0
    while i < n:
        where.append(i)
        i += step[i]
    where = np.array(where, np.int64)
    chosen = pick[where] if n else np.zeros(0, np.uint8)
    words = np.zeros(len(where), np.uint64)
    for s, (c, w) in enumerate(zip(COUNTS, WIDTHS)):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            group = padded[where[rows, None] + np.arange(c)] << (np.arange(c, dtype=np.uint64) * np.uint64(w))
            words[rows] = np.bitwise_or.reduce(group, axis=1) | np.uint64(s << 60)
    return words, at, values


def decode(words: np.ndarray, n: int, at=(), values=()) -> np.ndarray:
    """The n ids of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = np.array(COUNTS + (0, 0))[selector]
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s, (c, w) in enumerate(zip(COUNTS, WIDTHS)):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            group = words[rows, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(w))
            out[place[rows, None] + np.arange(c)] = group & np.uint64((1 << w) - 1)
    out = out[:n]
    out[np.asarray(at, np.int64)] = np.asarray(values, np.uint64)
    return out


def _writer(path: str, end: int | None, block_ids: int, key_type: pa.DataType):
    schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                        ("doc_ids", pa.list_(key_type)), ("lengths", pa.list_(pa.int64())), ("words", pa.binary()),
                        ("escape_at", pa.list_(pa.int64())), ("escape_value", pa.list_(pa.int64()))])

    def run(batches):
        enc = encoder(path)
        shard = TaskContext.get().partitionId()
        tail = np.array([] if end is None else [end], np.uint32)
        docs, held, lengths, size, seq, first = [], [], [], 0, 0, 0

        def block():
            words, at, values = encode(np.concatenate(held))
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "seq": seq, "first": first, "n_ids": size, "doc_ids": docs,
                "lengths": lengths, "words": words.astype("<u8").tobytes(),
                "escape_at": at.tolist(), "escape_value": values.astype(np.int64).tolist()}], schema)

        for b in batches:
            for d, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist()):
                docs.append(d)
                ids = enc(t)
                held.extend((ids, tail))
                lengths.append(len(ids) + len(tail))
                size += lengths[-1]
                if size >= block_ids:
                    yield block()
                    docs, held, lengths, first, size, seq = [], [], [], first + size, 0, seq + 1
        if docs:
            yield block()
        enc.forget()
    return run


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text",
          end: int | None = 1, block_ids: int = 65536) -> None:
    """Encode every whole text and write the blocks in ascending key order (null keys first,
    equal keys by text) as shards, one for each range of keys.  Null texts are empty."""
    kind = docs.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    n = parts(docs.sparkSession)
    ordered = (docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
               .repartitionByRange(n, "k").sortWithinPartitions("k", "t"))
    (ordered.mapInArrow(_writer(tokenizer, end, block_ids, to_arrow_type(kind)), BLOCK.format(id=kind.simpleString()))
     .write.option("compression", "zstd").parquet(path))


def read(spark: SparkSession, path: str, key: str = "doc_id", key_type: str = "bigint", digest: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids) of every document in the files at ``path``; with ``digest``
    the unsigned crc32 of the ids as little-endian uint32 (``ids_crc32``) in place of the ids.

    ``start``: ids of all documents before it.  Only one total per shard is windowed.
    """
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = decode(np.frombuffer(r["words"], "<u8"), r["n_ids"], r["escape_at"], r["escape_value"])
                lengths = np.array(r["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                if digest:
                    raw = memoryview(ids.astype("<u4").view(np.uint8))
                    last = pa.array([zlib.crc32(raw[4 * s:4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist())], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], b.schema.field("doc_ids").type.value_type), pa.array([r["shard"]] * len(lengths), pa.int32()),
                     pa.array(r["first"] + starts), pa.array(lengths), last],
                    names=["k", "shard", "place", "n_tokens", name])

    name, kind = ("ids_crc32", "bigint") if digest else ("ids", "array<bigint>")
    blocks = spark.read.schema(BLOCK.format(id=key_type)).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = (blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
            .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    return (blocks.mapInArrow(run, f"k {key_type}, shard int, place bigint, n_tokens bigint, {name} {kind}")
            .join(F.broadcast(base), "shard")
            .select(F.col("k").alias(key), (F.col("base") + F.col("place")).alias("start"), "n_tokens", name))
