"""Digests and votes against plain counts."""

import zlib

import numpy as np

from ludex.llm import quality, simple8b
from ludex.llm.encoding import default_path


def test_digests_are_those_of_the_library_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["The cat sat.", None, "", "naïve café\n\ttabs", "a" * 500, "The cat sat."]
    df = spark.createDataFrame([(3 * i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    path = str(tmp_path / "ids")
    simple8b.write(df.select("doc_id", "text"), path, default_path())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in simple8b.read(spark, path, digest=True).collect()}
    library, start = Tokenizer.from_file(default_path()), 0
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert got[3 * i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_vote_is_the_plain_weighted_vote():
    r = np.random.default_rng(4)
    counts = r.poisson(0.3, (60, quality.TERMS)).astype(np.float32)
    labels = (r.random(60) < 0.5).astype(float)
    space = quality.build(counts, labels, 8)
    asked = r.poisson(0.3, (25, quality.TERMS)).astype(np.float32)
    got = quality.vote(space, asked, 7)
    latent = quality.latent(asked, space.idf, space.basis)
    for row, value in zip(latent, got):
        sims = [float(row @ v) for v in space.vectors]
        near = sorted(range(60), key=lambda i: -sims[i])[:7]
        weight = [max(sims[i], 0.0) ** 4 for i in near]
        want = sum(w * space.labels[i] for w, i in zip(weight, near)) / sum(weight) if sum(weight) else space.prior
        assert abs(value - want) < 1e-4
    assert (quality.vote(space, asked, 1000) >= 0).all()  # more neighbours asked for than there are


def test_links_of_split_shards(spark):
    """Shards cut into chunks of three fingerprints link what one shard links: all within three bits, by forests."""
    import random

    from ludex.llm import simhash

    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(12)]
    prints = {b ^ sum(1 << i for i in r.sample(range(64), r.randrange(5))) for b in base for _ in range(25)} | {0, 1, 3}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")

    def groups(pairs):
        own = {p: p for p in prints}

        def top(p):
            while own[p] != p:
                p = own[p]
            return p

        for a, b in pairs:
            own[top(a)] = top(b)
        return {frozenset(q for q in prints if top(q) == top(p)) for p in prints}

    want = groups((a, b) for a in prints for b in prints if (a ^ b).bit_count() <= 3)
    for cap in (3, 4096):
        got = [(x.src % (1 << 64), x.dst % (1 << 64)) for x in simhash.link(df, 3, cap).collect()]
        assert groups(got) == want
