"""Corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("ludex.llm")

from ludex.llm import licenses, lthash, mixing, packing, ppm, quality, rabitq, simhash, simple8b, toxicity
from ludex.llm.common import shared_path
from ludex.llm.encoding import default_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k string, t string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(3)
    vocab = ["the", "of", "Ünter", "réeux", "cat's", "idiot", "a1b2", "x,", "END.", "naïve!!"] + [
        "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    texts = [None, "", "  \n ", "one", "two words", "\t lead\n\ntail  "]
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 120))) for _ in range(30)]
    texts += [texts[10]] * 3 + ["\n".join(" ".join(rng.choice(vocab) for _ in range(9)) for _ in range(900))]
    texts += ["Intro words here. Released under the MIT License. More words follow."]
    out = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return out + [out[12], (None, "no key at all here", "en", "s1", 18, "clash", "clash")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash_groups(docs, empty):
    got = sorted((r.doc_id is None, r.doc_id or 0, int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_groups(docs).collect())
    fps = [(d, simhash.fingerprint((t or "").encode())) for d, t, *_ in rows()]
    group = {f: {f} for _, f in fps}
    for _, a in fps:
        for _, b in fps:
            if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
                whole = group[a] | group[b]
                for x in whole:
                    group[x] = whole
    low = {f: min((d for d, g in fps if g in group[f] and d is not None), default=None) for _, f in fps}
    assert got == sorted((d is None, d or 0, f, low[f]) for d, f in fps)
    assert simhash.simhash_groups(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({low[f] for _, f in fps if low[f] is not None})


def test_keep_one_of_null_keys(spark):
    data = [(1, "a b c d", 1), (None, "a b c d", 2), (None, "a b c d", 3), (None, "x y z w", 4), (None, "X y z w", 5), (None, "x y z w", 6),
            (None, None, 7), (None, "", 8)]
    got = simhash.keep_one(spark.createDataFrame(data, "doc_id bigint, text string, n int")).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, [(1, "a b c d"), (None, "X y z w"), (None, None)]))


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(1)
    items = {rng.getrandbits(12) for _ in range(300)}
    tree = simhash.BKTree()
    for x in items:
        tree.add(x)
    for x in list(items)[:50]:
        assert {tree.items[i] for i in tree.within(x, 2)} == {y for y in items if (x ^ y).bit_count() <= 2}


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    near = np.concatenate([base, base[:10] + rng.normal(size=(10, 16)) * 0.03, base[:5], base[:3] * 7])
    data = [(i, [float(x) for x in v], "clash") for i, v in enumerate(near.astype(np.float32))]
    data += [(100, None, ""), (101, [], ""), (102, [0.0] * 16, ""), (103, [float("nan")] * 16, ""), (104, [1.0, None], ""), data[0]]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, cls string")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in rabitq.near_vectors(df, cap=8).collect()}
    e = np.array([d[1] for d in data[:len(near)]] + [data[0][1]])
    ids = [*range(len(near)), 0]
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    link = e @ e.T >= 0.95
    reach = np.linalg.matrix_power(link.astype(float), 8) > 0
    want = {(ids[i], int(link[i].sum()) - 1, min(ids[j] for j in np.flatnonzero(reach[i])), False) for i in range(len(ids))}
    want = {(i, n, c, i == c) for i, n, c, _ in want} | {(i, 0, i, True) for i in range(100, 105)}
    assert got == want
    assert rabitq.near_vectors(df.limit(0)).count() == 0


def test_multiset_fingerprints(docs, empty):
    got = lthash.fingerprints(docs).collect()
    assert len(got) == len(rows())
    text = {d: t or "" for d, t, *_ in rows() if d is not None}
    by = {}
    for r in got:
        if r.doc_id is not None:
            by.setdefault(r.fingerprint, set()).add(tuple(sorted(text[r.doc_id].split("\n"))))
            assert r.n_chars == len(text[r.doc_id])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by.values())
    assert len(by) == len({tuple(sorted(t.split("\n"))) for t in text.values()})
    assert lthash.fingerprints(empty).count() == 0


def test_multiset_sum_is_incremental(spark):
    df = spark.createDataFrame([(0, "a b\nc d"), (1, "c d\na b"), (2, "a b"), (3, "c d")], "id int, text string")
    f = {r.id: r for r in lthash.with_fingerprint(df, "text", "f").collect()}
    assert f[0].f == f[1].f
    both = spark.createDataFrame([(f[2].f, f[3].f, f[0].f)], "a array<bigint>, b array<bigint>, ab array<bigint>")
    r = both.select(lthash.plus(both.a, both.b).alias("p"), lthash.minus(both.ab, both.b).alias("m")).first()
    assert r.p == f[0].f and r.m == f[2].f


def test_likeness_of_long_texts(spark):
    rng = random.Random(6)

    def text(n):
        return " ".join("".join(rng.choice("bcdfgh") for _ in range(9)) + "a" for _ in range(n))

    def cosine(a, b):
        a, b = (Counter(x for x in re.split(r"\s*\n\s*|(?<=[aeiouyns.,;:!?])[\x20\x09-\x0D]+", t) if x) for t in (a, b))
        return sum(a[x] * b[x] for x in a) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5

    long, other = text(40_000), text(40_000)
    pairs = [(long, other), (long, long[:len(long) * 3 // 4] + other[:len(long) // 4]), (long, other[:len(other) // 10]), ("ba " * 40_000, other),
             ("ba " * 40_000 + long, "ba " * 300 + long)]
    df = spark.createDataFrame([(i, side, x) for i, ab in enumerate(pairs) for side, x in enumerate(ab)], "id int, side int, text string")
    f = {(r.id, r.side): r.f for r in lthash.with_fingerprint(df, "text", "f").collect()}
    both = spark.createDataFrame([(i, f[i, 0], f[i, 1]) for i in range(len(pairs))], "id int, fa array<bigint>, fb array<bigint>")
    got = {r.id: r.near for r in lthash.with_likeness(both, "fa", "fb", "near").collect()}
    for i, (a, b) in enumerate(pairs):
        assert abs(got[i] - cosine(a, b)) < 0.35, (i, got[i], cosine(a, b))
    assert got[1] > 0.5 and max(got[0], got[2], got[3]) < 0.35


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 59, 60, 61, 500):
        for top in (1, 2, 16, 20, 60, 63):
            x = rng.integers(0, 1 << top, n, dtype=np.uint64)
            words, at, values = simple8b.encode(x)
            assert (simple8b.decode(words, n, at, values) == x).all()


def _ids(end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return [(d, t.encode(x or "", add_special_tokens=False).ids + [end]) for d, x, *_ in rows()]


def test_token_files(spark, docs, empty):
    path = shared_path(spark, "t8b")
    simple8b.write(docs, path, default_path(), block_ids=500)
    got = [(r.doc_id, r.n_tokens, list(r.ids), r.start) for r in simple8b.read(spark, path).orderBy("start").collect()]
    assert sorted((str(d), ids) for d, _, ids, _ in got) == sorted((str(d), ids) for d, ids in _ids(1))
    assert [g[0] for g in got] == sorted((g[0] for g in got), key=lambda d: (d is not None, d))
    assert [g[3] for g in got] == list(np.cumsum([g[1] for g in got]) - [g[1] for g in got])
    path = shared_path(spark, "t8b")
    simple8b.write(empty, path, default_path())
    assert simple8b.read(spark, path).count() == 0


def test_packing(docs, empty):
    got = packing.pack(docs, default_path(), capacity=256, deme=16).collect()
    want = Counter()
    for d, ids in _ids(0):
        for p, s in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[s:s + 256], "<u4")
            want[(d, p, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.1 * sum(r.length for r in got) / 256 + 2
    assert packing.pack(empty, default_path()).count() == 0


def test_mixing(docs, empty):
    got = mixing.taken(docs, block_words=8, shard_slots=16).collect()
    again = mixing.taken(docs, block_words=8, shard_slots=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(rows())
    size = Counter()
    for _, t, _, s, *_ in rows():
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        level = left / max(1, sum(weight[s] for s in order if s not in capped))
        over = {s for s in order if s not in capped and level * weight[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    target = {s: 2 * size[s] if s in capped else level * weight[s] for s in order}
    total = Counter()
    for r in got:
        assert r.taken <= 2 * r["size"]
        s = next(s for s in order if abs(target[s] - r.target) < 1e-6 and size[s] == r.source_size)
        total[s] += r.taken
    assert all(abs(total[s] - target[s]) <= 8 for s in order)
    assert mixing.taken(empty).count() == 0
    out = mixing.mixed_documents(docs, block_words=8, shard_slots=16)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(total.values())


def test_ppm_is_a_distribution_and_base_matches(docs, empty):
    key, count = ppm.count_events([b"aab", b"abc", b"", b"b" * 9], np.array([3, 2, 4, 1]))
    trie = ppm.Trie(key, count)
    for prefix in (b"", b"a", b"aa", b"zz"):
        total = 0.0
        for sym in range(ppm.SYMBOLS):
            e = ppm.events([prefix + b"x"])
            i = len(prefix)
            total += 10 ** trie._steps(np.array([sym]), [s[i:i + 1] for s in e.slots])[0]
        assert abs(total - 1) < 1e-9
    got = {(r.doc_id, r.n_tokens): r for r in ppm.score(docs).collect()}
    tok = [(d, ppm.tokens((t or "").encode())) for d, t, *_ in rows()]
    train = Counter(w for d, x in tok if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for w in x)
    n, v = sum(train.values()), len(train)
    for d, x in tok:
        r = got[d, len(x)]
        assert r.train_tokens == n and r.n_known == sum(train[w] > 0 for w in x)
        assert abs(r.base_score - sum(np.log10((train[w] + 1) / (n + v + 1)) for w in x)) < 1e-6
        assert r.score < 0
    assert ppm.score(empty).count() == 0


def test_ppm_scores_are_code_lengths_of_the_running_text(spark, docs):
    def want(given):
        train = [x for d, x in given if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
        return ppm.Trie(*ppm.count_events(train, np.ones(len(train), np.int64))).log10([x for _, x in given])

    given = [(d, (t or "").encode()) for d, t, *_ in rows()]
    assert np.allclose(sorted(r.score for r in ppm.score(docs).collect()), sorted(want(given)))
    plain = "the cat sat on the mat and the dog lay by the door"
    texts = [plain] * 40 + [" ".join(reversed(plain.split())), plain.replace(" ", "\n"), plain.upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in ppm.score(df).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want([(i, t.encode()) for i, t in enumerate(texts)]))
    # word order, white space and case cost what they cost
    assert got[0] > max(got[40], got[41], got[42]) + 1


def test_ppm_contexts_are_exact_and_long_texts_go_on():
    rng = random.Random(5)
    text = bytes(rng.randrange(256) for _ in range(70_000))
    key, _ = ppm.count_events([text], np.array([1]))
    padded = [ppm.START] * ppm.ORDER + list(text) + [ppm.TEXT_END]
    for k in range(ppm.ORDER + 1):
        exact = {tuple(padded[i - k:i + 1]) for i in range(ppm.ORDER, len(padded))}
        assert (key >> (ppm.BITS * (ppm.ORDER + 1)) == k).sum() == len(exact)
    whole = np.concatenate([g for _, _, g in ppm.grams([text, b"", b"ab"])])
    cut = np.concatenate([g for _, _, g in ppm.grams([text, b"", b"ab"], 1000)])
    assert (whole == cut).all() and len(whole) == len(text) + 1 + 1 + 3


def test_ppm_counts_are_packed_beside_their_grams():
    rng = np.random.default_rng(3)
    top = (1 << ppm.BITS * (ppm.ORDER + 1)) - 1
    gram = np.concatenate([rng.integers(0, 50, 400), [top, top, 0]])
    count = np.concatenate([rng.integers(0, 4000, 400), [0, 10 ** 6, ppm.MOST]])
    held = [ppm.packed(gram[:200], count[:200]), ppm.packed(gram[200:], count[200:])]
    assert all(h.min() >= 0 and h.dtype == np.int64 for h in held)
    want = Counter()
    for g, c in zip(gram.tolist(), count.tolist()):
        want[g] += c
    got, c = ppm.added(held)
    assert dict(zip(got.tolist(), c.tolist())) == dict(want) and not held and (np.diff(got) > 0).all()


def test_ppm_gram_counts_hold_few_bytes(spark):
    import tracemalloc
    import pyarrow as pa
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 6000, np.uint8)).decode() for _ in range(2000)] + ["same words " * 20000] * 200
    steps = ppm.steps_of(pa.table({"t": texts}))
    tracemalloc.start()
    try:
        n = sum(len(gram) for _, _, gram in steps)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == sum(len(t) + 1 for t in texts)
    assert peak < 64 << 20, peak
    df = spark.createDataFrame([(i % 3 > 0, t) for i, t in enumerate(texts[:40] + texts[-3:])], "train boolean, t string").coalesce(1)
    want = {r.gram: r.c for r in ppm.gram_counts(df).collect()}
    assert {r.gram: r.c for r in ppm.gram_counts(df, flush=20000).collect()} == want


def test_ppm_chunks_are_bounded_in_bytes(spark):
    copies = spark.createDataFrame([(None, "x" * 999)] * 2000, "k bigint, t string")
    size = Counter(r.chunk for r in ppm.dealt(copies, 100_000).select("chunk").collect())
    assert len(size) == 21 and max(size.values()) * 1000 <= 200_000
    assert {r.chunk for r in ppm.dealt(copies).select("chunk").distinct().collect()} == {0}


def test_license_scan(docs, empty):
    got = {(r.doc_id, r.license, r.containment, r.from_word) for r in licenses.scan(docs).collect()}
    where = next(d for d, t, *_ in rows() if t and "MIT" in t)
    assert got == {(where, "mit", 1.0, 3)}
    assert licenses.scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, {"x": "All rights reserved."})


def test_license_scan_against_brute_force(spark):
    def words(t):
        out = [re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in (t or "").lower().split()]
        return [w for w in out if w]

    def runs(w, n):
        return [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)]

    every = licenses.shipped()
    header = (" * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in\n"
              " * compliance with the License.\n")
    gpl = words(every["text:gpl-3.0"])
    edited = " ".join(w if i % 60 else "xx" for i, w in enumerate(gpl))
    cut = " ".join(gpl[:len(gpl) // 2])
    texts = ["/*\n" + header + " */ int main;", "(Released under the MIT License), she said", "x Licensed under the Apache License, Version 2.0 now",
             "foo. ALL RIGHTS\n# reserved", "all rights were reserved", "// SPDX-License-Identifier: MPL-2.0", edited, cut, None, "", "-" * 50_000 + " a",
             every["text:isc"], "\n".join("# " + x for x in every["text:unlicense"].split("\n")), every["agpl-3.0-or-later-notice"] + " tail"]
    rng = random.Random(8)
    for name in sorted(every)[:12]:
        w = every[name].split()[:400]
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    want = set()
    for d, t in enumerate(texts):
        w = words(t)
        for short, given in ((False, every), (True, licenses.PHRASES)):
            for name, wording in given.items():
                tw = words(wording)
                size = len(tw) if short else licenses.SHINGLE
                own, have, best, first = set(runs(tw, size)), runs(w, size), 0, None
                for s in range(-2 * len(tw), len(w) + 1, len(tw)) if not short else [0]:
                    at = [i for i in range(max(s, 0), min(s + 3 * len(tw), len(have)) if not short else len(have)) if have[i] in own]
                    share = len({have[i] for i in at}) / len(own)
                    if share >= 0.8:
                        best, first = max(best, share), min(at) if first is None else first
                if best:
                    want.add((d, name, round(best, 9), first))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = licenses.scan(df).collect()
    assert {(r.doc_id, r.license, round(r.containment, 9), r.from_word) for r in got} == want
    found = {d: {n for e, n, *_ in want if e == d} for d in range(len(texts))}
    assert {"apache-2.0", "apache-2.0-notice"} & found[0] == {"apache-2.0", "apache-2.0-notice"} and found[1] == {"mit"} and "apache-2.0" in found[2]
    assert found[3] == {"all-rights-reserved"} and not found[4] and found[5] == {"spdx:mpl-2.0"} and "text:gpl-3.0" in found[6]
    assert "text:gpl-3.0" not in found[7] and "text:isc" in found[11] and "text:unlicense" in found[12] and "agpl-3.0-or-later-notice" in found[13]
    assert [r.matches for r in got if r.doc_id == 3] == [1]
    assert licenses.scan(df, {}).count() == 0


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, docs, empty, module, label):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioulmn") for _ in range(5)) for _ in range(80)]
    data = []
    for i in range(240):
        bad = i % 3 == 0
        w = [rng.choice(words) for _ in range(40)]
        if bad:
            w = [x + "$$$" for x in w] if label == "quality" else [x if rng.random() > 0.1 else "idiots" for x in w]
        data.append((i, " ".join(w), int(bad) if label == "toxic" else int(not bad)))
    given = spark.createDataFrame(data, f"doc_id bigint, text string, {label} int")
    labels = given.select("doc_id", label).union(spark.createDataFrame([(None, 1), (5000, None)], f"doc_id bigint, {label} int"))
    texts = given.select("doc_id", "text")
    model = module.fit(texts, labels)
    got = {r.doc_id: r for r in module.score(texts, model).collect()}
    truth = {d: y for d, _, y in data}
    held = [d for d, r in got.items() if r.held_out]
    assert held and sum(got[d].predicted == truth[d] for d in held) >= 0.95 * len(held)
    scored = module.score(docs, model).collect()
    assert len(scored) == len(rows()) and all(0 <= r.score <= 1 for r in scored)
    assert module.keep(docs, model).columns == docs.columns
    assert module.score(empty, module.fit(empty, labels)).count() == 0


def test_labelled_sample_is_bounded_where_keys_repeat(spark):
    docs = spark.createDataFrame([(1, "b")] * 50 + [(1, "a"), (2, None), (3, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in (1, 1, 2, 3, 9)], "doc_id bigint, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", "doc_id", 2, 4, 99).collect()
    assert len(got) == 2 and all(r.text in {1: ("a",), 2: (None,), 3: ("c",)}[r.key] for r in got)


@pytest.mark.parametrize("piece", [7, 64, 1 << 22])
def test_ppm_words_are_the_tokens(piece, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ppm, "WORD_BYTES", piece)

    rng = random.Random(8)
    given = ["".join(rng.choice("aB é\x1c\x85\xa0\t\n\x0b\x0c\r .İ") for _ in range(rng.randrange(30))) for _ in range(300)] + ["", " ", None]
    got = [[] for _ in given]
    for words, at, text in ppm.words_of(pa.array(given, pa.string())):
        words = words.to_pylist()
        assert len(set(words)) == len(words)
        for w, i in zip(at, text):
            got[i].append(words[w])
    assert got == [ppm.tokens((t or "").encode())[:-1] for t in given]


def test_exact_lanes_are_sums_of_paragraph_digests(spark):
    import hashlib

    given = ["a\nb\na", "b\na\na", "", None, "a\n\nb", "é\n漢"]
    df = spark.createDataFrame(list(enumerate(given)), "id int, text string")
    got = {r.id: list(r.f)[:lthash.EXACT] for r in lthash.with_fingerprint(df, "text", "f").collect()}
    for i, t in enumerate(given):
        digests = [hashlib.sha256(p.encode()).hexdigest() for p in (t or "").split("\n")]
        assert got[i] == [sum(int(d[15 * k:15 * k + 15], 16) for d in digests) % (1 << 60) for k in range(lthash.EXACT)]
    assert got[0] == got[1] != got[4]


def test_edited_texts_and_their_likeness(spark):
    """The edited text is the contract's, and likeness follows the share of words that stays."""
    import hashlib

    rng = random.Random(12)
    texts = ["".join(rng.choice(["one ", "two ", "naïve ", "漢字 ", "line\n", "sea ", "tree "]) for _ in range(rng.randrange(60, 400))) for _ in range(12)]
    texts[4], texts[7] = "", "x"
    df = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in lthash.fingerprints(df).collect():
        i = r.doc_id // 3
        t, follow = texts[i], texts[(i + 1) % len(texts)]
        k = len(t) // 4
        edited = t[:len(t) - k] + follow[:k]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (sorted(t.split("\n")) == sorted(edited.split("\n")))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.near_edited == 1
