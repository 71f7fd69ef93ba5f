"""Toxicity: a bag of subword embeddings, averaged, into a linear softmax.

Every word is the mean of the embeddings of its character n-grams (hashed to ``buckets``), a
text the mean of its words; a linear layer and a softmax over the two labels follow.  Both
the embeddings and the layer are trained jointly, in numpy, by Adam on a bounded sample of
labelled rows.  A misspelling that was never seen shares most of its n-grams with the word.

The model is linear after the lookup, so for scoring each n-gram is reduced to one number;
its table has ``buckets`` entries whatever the corpus, and is what the executors get.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import crc_bucket, map_arrow, texts

BUCKETS = 1 << 15
LEAST, MOST = 3, 5
GAIN = 32.0
#: Bags that a worker holds at once.
BAGS = 128
#: Zero vectors averaged in with a text's words: a few words alone can't decide.
PAD = 16


def ngrams(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the word's character n-grams (over UTF-8 bytes) and of the word itself."""
    w = b"<" + word[:200] + b">"
    out = [zlib.crc32(word) % buckets]
    for n in range(LEAST, MOST + 1):
        out.extend(zlib.crc32(w[i:i + n]) % buckets for i in range(len(w) - n + 1))
    # a longer run of characters goes on in steps, so no part of it is left out
    for s in range(195, len(word), 195):
        out.extend(ngrams(word[s:s + 200], buckets)[1:])
    return out


def bag(text: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Sparse mean over words of the mean over their n-grams: (buckets, weights)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    known: dict[bytes, int] = {}
    for w in words:
        known[w] = known.get(w, 0) + 1
    at, weight = [], []
    for w, c in known.items():
        g = ngrams(w, buckets)
        at.extend(g)
        weight.extend([c / len(g)] * len(g))
    total = np.bincount(at, weights=weight, minlength=0)
    nz = np.flatnonzero(total)
    return nz.astype(np.int32), (total[nz] / (len(words) + PAD)).astype(np.float32)


@dataclass
class Model:
    """Per n-gram bucket its pull towards label 1, and the bias: logit = bias + GAIN * mean."""
    pull: np.ndarray
    bias: float


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 4, epochs: int = 12,
          batch: int = 128, rate: float = 0.03, decay: float = 1e-4, seed: int = 5, buckets: int = BUCKETS) -> Model:
    """Jointly trained embeddings and softmax layer.  One label only, or no rows: its share.

    An n-gram counts with the square of its idf in the sample, so those that occur everywhere
    don't drown the telling ones.
    """
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.zeros(buckets), float(math.log(share / (1 - share))))
    seen = np.zeros(buckets, np.int64)
    for at, _ in rows:
        seen[at] += 1
    idf = (np.log(len(rows) / (1 + seen)) ** 2).clip(0.05).astype(np.float32)
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.1, (buckets, dim)), "w": rng.normal(0, 0.3, (dim, 2)), "b": np.zeros(2)}
    p = {k: x.astype(np.float32) for k, x in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        lr = rate * (1 - epoch / epochs)
        for s in range(0, len(order), batch):
            pick = order[s:s + batch]
            size = np.array([len(rows[i][0]) for i in pick])
            at = np.concatenate([rows[i][0] for i in pick])
            wt = np.concatenate([rows[i][1] for i in pick]) * idf[at] * np.float32(GAIN)
            who = np.repeat(np.arange(len(pick)), size)
            used, place = np.unique(at, return_inverse=True)
            x = np.zeros((len(pick), len(used)), np.float32)
            x[who, place] = wt
            h = x @ p["e"][used]
            z = h @ p["w"] + p["b"]
            z -= z.max(axis=1, keepdims=True)
            soft = np.exp(z)
            soft /= soft.sum(axis=1, keepdims=True)
            soft[np.arange(len(pick)), labels[pick]] -= 1
            soft /= len(pick)
            g = {"w": h.T @ soft + decay * p["w"], "b": soft.sum(axis=0), "e": x.T @ (soft @ p["w"].T) + decay * p["e"][used]}
            step += 1
            for k, grad in g.items():
                rows_of = used if k == "e" else slice(None)
                m[k][rows_of] = 0.9 * m[k][rows_of] + 0.1 * grad
                v[k][rows_of] = 0.999 * v[k][rows_of] + 0.001 * grad ** 2
                p[k][rows_of] -= lr * (m[k][rows_of] / (1 - 0.9 ** step)) / (np.sqrt(v[k][rows_of] / (1 - 0.999 ** step)) + 1e-8)
    d = p["w"][:, 1] - p["w"][:, 0]
    return Model((p["e"] @ d).astype(np.float64) * idf, float(p["b"][1] - p["b"][0]))


class Scorer:
    """Scores of texts; words' pulls are kept in a memo of bounded size."""

    def __init__(self, model: Model, cap: int = 400_000):
        self.pull, self.bias, self.cap = model.pull.tolist(), model.bias, cap
        self.buckets = len(self.pull)
        self.memo: dict[bytes, float] = {}

    def __call__(self, text: bytes) -> float:
        words = text.lower().split()
        logit = self.bias
        if words:
            memo = self.memo
            try:
                total = sum(map(memo.__getitem__, words))
            except KeyError:
                if len(memo) > self.cap:
                    memo.clear()
                for w in set(words):
                    if w not in memo:
                        g = ngrams(w, self.buckets)
                        memo[w] = sum(map(self.pull.__getitem__, g)) / len(g)
                total = sum(map(memo.__getitem__, words))
            logit += GAIN * total / (len(words) + PAD)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, logit))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, rows: int, modulus: int, held: int) -> DataFrame:
    """(key, text, y) of at most ``rows`` training rows, the first by a hash of the key.

    Only keys that occur in ``docs`` count; rows held out (crc32 of the key modulo ``modulus``
    is ``held``), null keys and null labels don't.  Of rows that repeat a key, the first by
    text counts, so the bound holds however often a key occurs.
    """
    marked = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (crc_bucket(key, modulus) != held))
              .groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y")))
    chosen = (marked.join(docs.select(key), key, "left_semi")
              .orderBy(F.xxhash64(key), key).limit(rows))
    return (docs.join(F.broadcast(chosen), key)
            .groupBy(F.col(key).alias("key"), "y").agg(F.min("text").alias("text")).select("key", "text", "y"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        rows: int = 6000, modulus: int = 4, held: int = 2) -> Model:
    """Train on at most ``rows`` labelled rows.  Their sparse bags (at most ``rows`` times
    ``BUCKETS`` numbers) meet in one task, which trains; the driver gets the pulls alone, one
    number a bucket.  A lost task trains the same model again: rows are taken by key."""
    def bags(batches):
        for whole in batches:
            for b in (whole.slice(s, BAGS) for s in range(0, whole.num_rows, BAGS)):
                each = [bag(t) for t in texts(b, "text")]
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), b.column("y"), pa.array([x[0] for x in each], pa.list_(pa.int32())),
                     pa.array([x[1] for x in each], pa.list_(pa.float32()))], names=["key", "y", "at", "weight"])

    def learn(batches):
        rows_of, keys, marks = [], [], []  # rows are views of the batches: they are held once
        for b in batches:
            at, weight = b.column("at"), b.column("weight")
            ends = at.offsets.to_numpy()
            at, weight = at.values.to_numpy(), weight.values.to_numpy()
            rows_of.extend((at[s:e], weight[s:e]) for s, e in zip(ends[:-1], ends[1:]))
            keys.append(b.column("key"))
            marks.extend(b.column("y").to_pylist())
        order = pc.sort_indices(pa.chunked_array(keys)).to_pylist() if keys else []
        model = train([rows_of[i] for i in order], np.array([marks[i] for i in order], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.pull], pa.list_(pa.float64())), pa.array([model.bias])], names=["pull", "bias"])

    kind = docs.schema[key].dataType.simpleString()
    sample = labelled_sample(docs.select(key, F.col(text).alias("text")), labels, label, key, rows, modulus, held)
    bagged = map_arrow(sample, bags, f"key {kind}, y int, at array<int>, weight array<float>")
    got = map_arrow(bagged.repartition(1), learn, "pull array<double>, bias double").toArrow()
    if not got.num_rows:  # no task ran, as no row is labelled
        return train([], np.zeros(0, np.int64))
    return Model(got.column("pull").combine_chunks().flatten().to_numpy(), got.column("bias")[0].as_py())


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", modulus: int = 4, held: int = 2,
          threshold: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted) for every row.  Null and blank texts get the bias's
    score; null keys count as the empty text's crc32; repeated rows are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            s = [scorer(t) for t in texts(b, "t")]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("held_out"), pa.array(s, pa.float64())], names=["k", "held_out", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), (crc_bucket(key, modulus) == held).alias("held_out"), F.col(text).alias("t"))
    return (map_arrow(rows, run, f"k {kind}, held_out boolean, score double")
            .select(F.col("k").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            low = [scorer(t) < threshold for t in texts(b, b.schema.names[place])]
            yield b.filter(pa.array(low, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
