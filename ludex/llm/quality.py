"""Quality: votes of the nearest labelled neighbours in a latent-semantic space.

Terms are words, word shapes and repetitions, hashed to ``TERMS`` columns; a text's vector is
log(1 + count) times the term's idf, of length 1.  A truncated SVD of the labelled sample's
matrix gives the latent space.  The labelled vectors (a bounded sample) are broadcast; every
document gets its exact cosine with all of them, block by block, and the ``k`` nearest vote
with their similarity.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_bucket, texts
from .toxicity import labelled_sample

SHAPES, WORDS = 256, 512
EXTRA = 4  # repeated neighbours, repeated lines' words, words, distinct words
TERMS = SHAPES + WORDS + EXTRA

_KIND = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def shape(word: bytes) -> bytes:
    """A for capitals, a for other letters, 0 for digits, marks as they are; runs count once."""
    return _RUN.sub(rb"\1", word.translate(_KIND))


class Terms:
    """Counts of a text's hashed terms; words' columns are kept in a memo of bounded size."""

    def __init__(self, cap: int = 400_000):
        self.cap, self.memo = cap, {}

    def __call__(self, text: bytes) -> np.ndarray:
        out = np.zeros(TERMS, np.float32)
        words = text.split()
        if not words:
            return out
        memo = self.memo
        try:
            at = np.fromiter(map(memo.__getitem__, words), np.int32, len(words))
        except KeyError:
            if len(memo) > self.cap:
                memo.clear()
            for w in set(words):
                if w not in memo:
                    memo[w] = zlib.crc32(shape(w)) % SHAPES * WORDS + zlib.crc32(w.lower()) % WORDS
            at = np.fromiter(map(memo.__getitem__, words), np.int32, len(words))
        out[:SHAPES] = np.bincount(at // WORDS, minlength=SHAPES)
        out[SHAPES:SHAPES + WORDS] = np.bincount(at % WORDS, minlength=WORDS)
        same = sum(map(bytes.__eq__, words[1:], words))
        lines = text.split(b"\n")
        seen = len(lines) - len(set(lines))
        # repetition weighs by its share of the text, in steps a text of any length can reach
        n = len(words)
        out[-4] = np.expm1(12 * same / n)
        out[-3] = np.expm1(6 * seen / len(lines))
        return out


@dataclass
class Space:
    """idf, projection (terms x latent), labelled latent vectors of length 1, labels, prior."""
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def latent(counts: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    z = weighted(counts, idf) @ basis
    size = np.linalg.norm(z, axis=1, keepdims=True)
    return (z / np.where(size < 1e-9, 1, size)).astype(np.float32)


def build(counts: np.ndarray, labels: np.ndarray, dims: int = 32) -> Space:
    """The latent space of the labelled rows.  No rows: a space whose votes are the prior 0.5."""
    n = len(counts)
    if not n:
        return Space(np.zeros(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1
    x = weighted(counts.astype(np.float64), idf)
    value, vector = np.linalg.eigh(x.T @ x)
    top = np.argsort(value)[::-1][:dims]
    basis = vector[:, top]
    basis *= np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(len(top))])
    return Space(idf, basis, latent(counts, idf, basis), labels.astype(np.float32), float(labels.mean()))


def vote(space: Space, counts: np.ndarray, k: int) -> np.ndarray:
    """Similarity-weighted share of label 1 among the k nearest; no similarity at all: the prior."""
    if not len(space.vectors):
        return np.full(len(counts), space.prior)
    near = latent(counts, space.idf, space.basis) @ space.vectors.T
    k = min(k, near.shape[1])
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float64) ** 4
    total = weight.sum(axis=1)
    return np.where(total > 0, (weight * space.labels[at]).sum(axis=1) / np.where(total > 0, total, 1), space.prior).clip(0, 1)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        rows: int = 3000, modulus: int = 5, held: int = 0, dims: int = 32) -> Space:
    """The space of at most ``rows`` labelled rows; their term counts (``TERMS`` each) reach the driver."""
    def run(batches):
        terms = Terms()
        for b in batches:
            c = [terms(t) for t in texts(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("y"), pa.array(c, pa.list_(pa.float32()))], names=["key", "y", "c"])

    kind = docs.schema[key].dataType.simpleString()
    sample = labelled_sample(docs.select(key, F.col(text).alias("text")), labels, label, key, rows, modulus, held)
    got = sample.mapInArrow(run, f"key {kind}, y int, c array<float>").toArrow().sort_by("key")
    counts = got.column("c").combine_chunks().flatten().to_numpy().reshape(-1, TERMS)
    return build(counts, np.array(got.column("y").to_pylist(), np.float64), dims)


def score(docs: DataFrame, space: Space, key: str = "doc_id", text: str = "text", k: int = 15, modulus: int = 5, held: int = 0,
          threshold: float = 0.3, block: int = 256) -> DataFrame:
    """(key, held_out, score, predicted) for every row.  Null and blank texts get the prior;
    null keys count as the empty text's crc32; repeated rows are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        terms, known = Terms(), shared.value
        for b in batches:
            for s in range(0, b.num_rows, block):
                part = b.slice(s, block)
                votes = vote(known, np.stack([terms(t) for t in texts(part, "t")]), k)
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("held_out"), pa.array(votes, pa.float64())], names=["k", "held_out", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("k"), (crc_bucket(key, modulus) == held).alias("held_out"), F.col(text).alias("t"))
            .mapInArrow(run, f"k {kind}, held_out boolean, score double")
            .select(F.col("k").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep(docs: DataFrame, space: Space, text: str = "text", k: int = 15, threshold: float = 0.3, block: int = 256) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(space)
    place = docs.columns.index(text)

    def run(batches):
        terms, known = Terms(), shared.value
        for b in batches:
            for s in range(0, b.num_rows, block):
                part = b.slice(s, block)
                votes = vote(known, np.stack([terms(t) for t in texts(part, part.schema.names[place])]), k)
                yield part.filter(pa.array(votes >= threshold))

    return docs.mapInArrow(run, docs.schema)
