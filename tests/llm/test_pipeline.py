"""The corpus pipeline: every stage on its own input, the whole run, and odd tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("ludex.llm")

import corpus_pipeline as pipeline
from ludex.llm import mixing, quality, simhash, toxicity
from ludex.llm.encoding import default_path

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ["key", "text_", "k", "t", "y", "mark", "row", "copy", "words", "kept", "_cuts", "_words", "_copy", "fp", "sid", "place"]
LABELS = "doc_id bigint, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    """(documents, labels): clean texts, toxic ones, poor ones, exact and near copies, odd rows."""
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    insults = ["vrokdash", "zubbquik", "gromphex"]
    docs, labels = [], []
    for i in range(260):
        text = [rng.choice(words) for _ in range(60)]
        toxic, poor = i % 5 == 1, i % 5 == 3
        if toxic:
            text = [w if rng.random() > 0.2 else rng.choice(insults) for w in text]
        if poor:
            text = [w.upper() + "$#" for w in text]
        docs.append((i, " ".join(text), "en", None if i % 11 == 0 else f"s{i % 3}", 0))
        labels.append((i, int(not poor), int(toxic)))
    clean = docs[0][1]
    docs += [(300 + i, clean, "en", "s1", 0) for i in range(30)]
    docs += [(400, clean.replace(" ", "\n", 1), "en", "s2", 0), (401, None, None, None, None), (402, "", "en", "s0", 0),
             (None, "no key but words enough to be kept in the mix", "en", "s0", 0), docs[2],
             (403, " ".join(rng.choice(words) for _ in range(20000)), "en", "s2", 0)]
    return ([(*d[:4], len(d[1] or "")) for d in docs], labels + [(None, 1, 0), (9000, 1, 1), (2, None, None)])


@pytest.fixture(scope="module")
def folder(spark, tmpdir_session):
    """A folder of the two tables the pipeline reads; documents have clashing extra columns."""
    docs, labels = corpus()
    path = f"{tmpdir_session}/pipeline"
    wide = spark.createDataFrame(docs, DOCUMENTS).selectExpr("*", *[f"'own' AS `{c}`" for c in CLASHES])
    wide.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def read(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def keyed(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_are_the_five_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality", "simhash", "mixing", "packing"]


@pytest.mark.parametrize("stage, module, label, rejects", [
    (pipeline.drop_toxic, toxicity, "toxic", 1), (pipeline.drop_poor, quality, "quality", 0)])
def test_filters_drop_what_the_model_rejects(spark, folder, stage, module, label, rejects):
    docs, labels = read(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    out = stage(spark, docs, folder)
    assert out.schema == docs.schema
    kept = keyed(out)
    scores = {(r.doc_id): r.predicted for r in module.score(docs, module.fit(docs, labels)).collect()}
    assert kept == Counter({k: n for k, n in keyed(docs).items() if scores[k[0]] != rejects})
    truth = {d: (q, t)[label == "toxic"] for d, q, t in corpus()[1][:260]}
    gone = {d for d, _ in keyed(docs)} - {d for d, _ in kept}
    assert len(gone & {d for d, y in truth.items() if y == rejects}) >= 0.95 * sum(y == rejects for y in truth.values())
    assert not gone & {d for d, y in truth.items() if y != rejects}
    own = out.first()
    assert all(own[c] == "own" for c in CLASHES)


def test_one_document_of_each_group_stays(spark, folder):
    docs = read(spark, folder)
    out = pipeline.drop_copies(spark, docs, folder)
    assert out.schema == docs.schema
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = {t: simhash.fingerprint((t or "").encode()) for _, t in rows}
    group = {f: {f} for f in fps.values()}
    for a in list(group):
        for b in list(group):
            if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
                whole = group[a] | group[b]
                for x in whole:
                    group[x] = whole
    want = {min(d for d, t in rows if d is not None and fps[t] in g) for g in {frozenset(g) for g in group.values()}
            if any(d is not None and fps[t] in g for d, t in rows)}
    got = [r for r in out.collect()]
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in got) == 1
    assert 0 in want and not want & {*range(300, 330), 400, 402}
    assert all(r[c] == "own" for r in got for c in CLASHES)


def test_mix_takes_whole_words_in_order(spark, folder):
    docs = read(spark, folder).dropDuplicates(["doc_id"])
    out = pipeline.mix_sources(spark, docs, folder)
    assert out.columns == docs.columns
    texts = {r.doc_id: WORD.findall(r.text or "") for r in docs.collect()}
    taken, got = Counter(), out.collect()
    for r in got:
        words = WORD.findall(r.text)
        taken[r.doc_id] += len(words)
        assert r.n_chars == len(r.text)
        assert not Counter(words) - Counter(texts[r.doc_id])
        if len(words) == len(texts[r.doc_id]):
            assert words == texts[r.doc_id]
    total = sum(map(len, texts.values()))
    assert abs(sum(taken.values()) - 1.5 * total) <= 4 * 128
    assert all(n <= 2 * len(texts[d]) for d, n in taken.items())
    assert all(r[c] == "own" for r in got for c in CLASHES)
    assert Counter((r.doc_id, r.text) for r in got) == keyed(pipeline.mix_sources(spark, docs, folder))


def test_mix_texts_are_their_spans(spark, folder):
    """Every row of the mix, whole or cut, is its spans' words with the white space after them."""
    docs = read(spark, folder).dropDuplicates(["doc_id"])
    texts = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", r.text or "") for r in docs.collect()}
    cuts = {}
    for r in mixing.mix(docs)[1].collect():
        assert r["size"] == len(texts[r["key"]])
        cuts.setdefault((r["key"], r["pass"]), []).append((r["from_word"], r["n_words"]))
    want = Counter((k, "".join(w for a, n in sorted(c) for w in texts[k][a:a + n])) for (k, _), c in cuts.items())
    assert any(0 < sum(n for _, n in c) < len(texts[k]) for (k, _), c in cuts.items())
    assert keyed(mixing.mixed_documents(docs)) == want


def test_run_is_its_stages_in_turn(spark, folder):
    from tokenizers import Tokenizer

    docs = read(spark, folder)
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    encode = Tokenizer.from_file(default_path()).encode
    want = Counter()
    for d, t in ((r.doc_id, r.text) for r in docs.collect()):
        ids = np.array(encode(t, add_special_tokens=False).ids + [0], "<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s:s + 2048]
            want[d, p, s, len(part), zlib.crc32(part.tobytes())] += 1
    got = pipeline.run(spark, folder).collect()
    assert want and Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    left = {r.doc_id for r in got}
    labels = corpus()[1][:260]
    assert sum(d in left for d, _, t in labels if t) <= 1 and not {*range(300, 330), 400} & left


def test_empty_tables(spark, tmpdir_session):
    path = f"{tmpdir_session}/pipeline-empty"
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.count() == 0
    assert pipeline.run(spark, path).count() == 0


def test_no_labels_keep_everything(spark, folder, tmpdir_session):
    """Without labelled rows both filters fall back to 0.5: toxicity rejects at 0.3, quality keeps."""
    path = f"{tmpdir_session}/pipeline-unlabelled"
    spark.createDataFrame([], LABELS).write.parquet(f"{path}/labels.parquet")
    docs = read(spark, folder)
    assert pipeline.drop_poor(spark, docs, path).count() == docs.count()


def test_workers_forget_words_after_packing(spark):
    import pyarrow as pa

    from ludex.llm import packing
    from ludex.llm.encoding import encoder

    path = default_path()
    docs = spark.range(0, 800, 1, 4).selectExpr("id AS doc_id", "concat('some text ', id) AS text")
    assert packing.pieces(docs, path).count() == 800

    def known(batches):
        for _ in batches:
            e = encoder(path)  # the worker's own
            yield pa.RecordBatch.from_arrays([pa.array([len(e.words) + len(e.old)])], names=["n"])

    assert [r.n for r in docs.mapInArrow(known, "n bigint").collect()] == [0] * 4
