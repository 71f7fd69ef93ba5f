"""Cross-tokenizer alignment: where two tokenizations of one text end together.

A byte-level BPE (A, given space + text) and a sentence-piece model (B, which adds that space
itself) cover the same bytes.  For each text a dictionary maps every cumulative byte end of A to
its token's index, another that of B; the intersection of their key sets, sorted, cuts both id
lists into groups.  The last tokens of a group's two sides end together: that pair is a link.

Counts of id pairs are corpus-wide.  Texts are dealt with in blocks of bounded size; a block
keeps its distinct pairs once, so that what is shuffled to count pairs and to bring the counts
back is a row a block and pair, whatever the number of links.

Texts that are null, empty, or whose tokens' bytes differ from space + text (the sentence-piece
model may normalize) have no tokens: zeros, no groups, no links.  Rows are dealt with one by one:
repeated rows, equal or null keys each give their own row, an empty table gives none.  Columns of
the input other than key and text aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ludex.functions.batches import pieces

from .common import map_arrow, stored

#: Bytes of text handed to the tokenizers at once, and in one block.
BATCH_BYTES, BLOCK_BYTES = 1 << 20, 8 << 20


#: Characters beyond those that both pre-tokenizers are compared on when they are loaded.
_OTHER = re.compile("[^\x00-\u024f]")


def _byte_of() -> dict[str, int]:
    """The byte that each character of the byte-level alphabet stands for."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class Aligner:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, byte_path: str, piece_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # their strings within a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        byte_of = _byte_of()
        n = max(self.a.get_vocab().values()) + 1
        entries = [self.a.id_to_token(i) or "" for i in range(n)]
        # entries with other characters (the special ones) are never given
        self.a_bytes = [bytes(map(byte_of.get, e)) if all(c in byte_of for c in e) else e.encode() for e in entries]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.quick = self._quick(byte_path)
        marked = lambda n, mark: [f"{i}{mark}" for i in range(n)]
        self.a_text = np.array([marked(n, ","), marked(n, "|")], object)
        m = len(self.b_bytes)
        self.b_text = np.array([marked(m, ","), marked(m, ";")], object)

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def _quick(self, byte_path: str):
        """The rank-based encoder over the same vocabulary, or None.

        Ranks stand for the merges only if the i-th merge makes the i-th entry after the 256
        bytes, and both pre-tokenizers must take every character below U+0250 alike: each is
        tried between letters, digits and spaces.  Texts with others go to the tokenizers library.
        """
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        with open(byte_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(model["vocab"].get("".join(m)) != 256 + i for i, m in enumerate(merges)):
            return None
        n = 256 + len(merges)
        quick = tiktoken.Encoding("pairs", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.a_bytes[:n])}, special_tokens={})
        tries = [f"a{c}b 1{c}2 {c} {c}{c}  {c}x\n{c}" for c in map(chr, range(0x250))] + ["it's we'll I'd <|endoftext|> ' s", " \t\n  x \r\n\n y  "]
        want = [e.ids for e in self.a.encode_batch(tries, add_special_tokens=False)]
        return quick if [quick.encode_ordinary(t) for t in tries] == want else None

    def _byte_ids(self, texts: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        out = [None if _OTHER.search(t) else self.quick.encode_ordinary(t) for t in texts]
        other = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(other, self.a.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text in A and in B, empty where the tokens don't spell space + text."""
        spaced = [" " + t for t in texts]
        a_ids = self._byte_ids(spaced)
        b_ids = self.b.encode(texts, num_threads=1)
        for text, spelt, a, b in zip(texts, spaced, a_ids, b_ids):
            want = spelt.encode()
            same = (text and b"".join(map(self.a_bytes.__getitem__, a)) == want
                    and b"".join(map(self.b_bytes.__getitem__, b)) == want)
            yield (np.array(a, np.int64), np.array(b, np.int64)) if same else (_NONE, _NONE)

    def cut(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the last token of every group, in A and in B."""
        at_a = dict(zip(np.cumsum(self.a_len[a]).tolist(), count()))
        at_b = dict(zip(np.cumsum(self.b_len[b]).tolist(), count()))
        ends = sorted(at_a.keys() & at_b.keys())
        return (np.array([at_a[e] for e in ends], np.int64), np.array([at_b[e] for e in ends], np.int64))

    def spelled(self, a, b, a_last, b_last) -> str:
        """The groups as text: ``a1,a2|b1;a3|b2,b3``."""
        out = np.empty(len(a) + len(b), object)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[a_last] = last_b[b_last] = 1
        # a token of A comes after the B tokens of the groups before its own, a token of B after the A tokens up to its own
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        out[np.arange(len(a)) + np.concatenate([[0], b_last + 1])[group_a]] = self.a_text[last_a, a]
        out[np.arange(len(b)) + (a_last + 1)[group_b]] = self.b_text[last_b, b]
        return "".join(out.tolist())[:-1]


_NONE = np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One aligner for each pair of paths and Python worker."""
    return Aligner(byte_path, piece_path)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _pieces(batches, most: int) -> Iterator[tuple[pa.Array, list[str], int]]:
    """(keys, texts, bytes) of ``most`` bytes of text beside the longest; only one piece's texts are strings at a time."""
    for batch in batches:
        for i, j in pieces(batch.column(1), size=most):
            texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
            yield batch.column(0).slice(i, j - i), texts, sum(4 * len(t) if not t.isascii() else len(t) for t in texts)


def align(docs: DataFrame, paths: tuple[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's ids and groups.

    Returns (key, a_ids, b_ids, a_last, b_last): the ids in A and in B, and for each group the
    index of its last token in either list.
    """
    lists = [T.StructField(n, T.ArrayType(T.IntegerType()), False) for n in ("a_ids", "b_ids", "a_last", "b_last")]
    schema = T.StructType([docs.schema[key], *lists])

    def run(batches):
        al = aligner(*paths)
        for keys, texts, _ in _pieces(batches, BATCH_BYTES):
            rows = [(a, b, *al.cut(a, b)) for a, b in al.encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [keys, *[pa.array([r[i].astype(np.int32) for r in rows], pa.list_(pa.int32())) for i in range(4)]],
                names=schema.names)

    return map_arrow(docs.select(key, text), run, schema)


#: Ids of a pair in one number: the one of A, then that of B.
_SHIFT = 32


def _blocks(docs: DataFrame, paths, key: str, text: str) -> DataFrame:
    """A row a text with its figures and links, and a row a block with the block's distinct pairs.

    Links are given as places in the block's sorted pairs (``at``) and how often (``times``).
    """
    schema = T.StructType([
        T.StructField("block", T.LongType()), docs.schema[key],
        T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()),
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType())),
        T.StructField("pairs", T.ArrayType(T.LongType()))])
    schema = T.StructType([T.StructField(f"_{i}", f.dataType, True) for i, f in enumerate(schema.fields)])

    def block(number, keys, figures, found):
        pairs, at = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
        times = np.concatenate([n for _, n in found])
        total = np.bincount(at, times, len(pairs)).astype(np.int32)
        cuts = np.concatenate([[0], np.cumsum([len(p) for p, _ in found])]).astype(np.int32)
        lists = lambda v: pa.ListArray.from_arrays(cuts, v.astype(np.int32))
        n, keys = len(found), pa.concat_arrays(keys)
        own = pa.array([number] * n, pa.int64())
        rows = [own, keys, *[pa.array(c, t) for c, t in zip(zip(*figures), (pa.int64(),) * 3 + (pa.string(),))],
                lists(at), lists(times), pa.nulls(n, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(rows, types(keys))], names=schema.names)
        whole = [pa.array([number], pa.int64()), pa.nulls(1, keys.type), *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.string()),
                 pa.nulls(1, pa.list_(pa.int32())), pa.array([total], pa.list_(pa.int32())), pa.array([pairs], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(whole, names=schema.names)

    def types(keys):
        return [pa.int64(), keys.type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches):
        al = aligner(*paths)
        number, size, keys, figures, found = TaskContext.get().partitionId() << 32, 0, [], [], []
        for some, texts, n_bytes in _pieces(batches, BATCH_BYTES):
            keys.append(some)
            size += n_bytes
            for a, b in al.encode(texts):
                a_last, b_last = al.cut(a, b)
                spelled = hashlib.sha256(al.spelled(a, b, a_last, b_last).encode()).hexdigest() if len(a) else ""
                figures.append((len(a), len(b), len(a_last), spelled))
                found.append(np.unique(a[a_last] << _SHIFT | b[b_last], return_counts=True))
            if size >= BLOCK_BYTES:
                yield from block(number, keys, figures, found)
                number, size, keys, figures, found = number + 1, 0, [], [], []
        if found:
            yield from block(number, keys, figures, found)

    out = map_arrow(docs.select(key, text), run, schema)
    return out.toDF("block", "key", "n_a", "n_b", "n_groups", "groups_sha256", "at", "times", "pairs")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, is_best) over the whole corpus; ``is_best``: no pair of its B id has a higher count."""
    each = blocks.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("p.times").cast("long")).alias("count"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND((1 << _SHIFT) - 1))
    best = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(best, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("is_best"))


def link_figures(docs: DataFrame, paths: tuple[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Figures of every text's groups and links.

    Returns (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).  A link's count
    is the number of links of the corpus with its two ids; ``n_best`` counts the links whose
    count is the highest of their B id, ties included; ``count_sum`` adds the counts up.
    """
    blocks = stored(_blocks(docs, paths, key, text), "alignment")
    own = (blocks.where("pairs IS NOT NULL")
           .select("block", F.posexplode("pairs").alias("place", "pair")))
    known = own.join(pair_counts(blocks), "pair").select(F.col("block").alias("home"), "place", "count", "is_best")
    texts = blocks.where("pairs IS NULL").drop("pairs")
    key_type = docs.schema[key].dataType
    schema = T.StructType([T.StructField("key", key_type), *[T.StructField(n, T.LongType()) for n in (
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])

    def figures(texts, known):
        place = known.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place] = known.column("count").to_numpy()
        best[place] = known.column("is_best").combine_chunks().cast(pa.int8()).to_numpy(zero_copy_only=False)
        at, times = [texts.column(c).combine_chunks() for c in ("at", "times")]
        row = np.repeat(np.arange(texts.num_rows), at.value_lengths().to_numpy())
        at, times = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)

        def add(values):
            total = np.zeros(texts.num_rows, np.int64)
            np.add.at(total, row, values)
            return pa.array(total)

        return pa.table([texts.column("key"), texts.column("n_a"), texts.column("n_b"), texts.column("n_groups"), add(times),
                         add(times * best[at]), add(times * count[at]), texts.column("groups_sha256")], names=schema.names)

    out = texts.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(figures, schema)
    return out.withColumnRenamed("key", key)
