"""Groups and links of two tokenizations against a plain count."""

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from ludex.llm import alignment as A


def _tokens(text):
    """(id, bytes) of A and of B by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    byte_path, piece_path = A.default_paths()
    t = Tokenizer.from_file(byte_path)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    alphabet = A._byte_of()
    a = [(i, bytes(alphabet[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()))
    return a, b


def _plain(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    links, rows = [], []
    for text in texts:
        a, b = _tokens(text) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            links.append([])
            rows.append((0, 0, 0, ""))
            continue
        groups, ga, gb, i, j, na, nb = [], [], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if j == len(b) or (i < len(a) and na <= nb):
                na += len(a[i][1])
                ga.append(a[i][0])
                i += 1
            else:
                nb += len(b[j][1])
                gb.append(b[j][0])
                j += 1
            if na == nb and ga and gb:
                groups.append((ga, gb))
                ga, gb = [], []
        links.append([(x[-1], y[-1]) for x, y in groups])
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), hashlib.sha256(said.encode()).hexdigest()))
    count = Counter(p for ls in links for p in ls)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(n_a, n_b, n_g, len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), sha)
            for (n_a, n_b, n_g, sha), ls in zip(rows, links)]


TEXTS = ["The cat sat on the mat.", "The cat sat on the mat.", "", None, " ", "naïve café — déjà vu", "数字 123 😀 ok", "<|endoftext|> and <s> </s> are text",
         "two  spaces\tand\ttabs\n\nlines", "a" * 3000, "ligature ﬁ and half width ｱ", "▁ own mark", "x\x00y \x1c z", "the " * 2000]




def test_links_equal_plain_count(spark):
    rows = [(i, t, "b", 7) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, at int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in A.link_figures(df, A.default_paths()).collect()}
    want = _plain(TEXTS)
    assert got == dict(enumerate(want))
    assert want[7][0] > 0 and want[11][0] == 0  # special strings are text; a text with the mark isn't spelled by B


def test_rows_without_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_a, r.n_links, r.groups_sha256 == "") for r in A.link_figures(df, A.default_paths()).collect())
    assert got == [(False, 0, 0, True), (False, 2, 2, False), (True, 2, 2, False), (True, 2, 2, False)]
    assert A.link_figures(df.where("false"), A.default_paths()).count() == 0


def test_groups_spell_the_text(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    al = A.aligner(*A.default_paths())
    for r in A.align(df, A.default_paths()).collect():
        text = TEXTS[r.doc_id]
        if not r.a_ids:
            assert r.b_ids == [] and r.a_last == []
            continue
        i = j = 0
        out = b""
        for x, y in zip(r.a_last, r.b_last):
            a = b"".join(al.a_bytes[k] for k in r.a_ids[i:x + 1])
            assert a == b"".join(al.b_bytes[k] for k in r.b_ids[j:y + 1])
            out, i, j = out + a, x + 1, y + 1
        assert out == (" " + text).encode()


def test_blocks_share_counts(spark):
    """Counts don't depend on how texts are cut into blocks."""
    texts = [f"the cat number {i % 7} sat" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = {tuple(r) for r in A.link_figures(df.coalesce(1), A.default_paths()).collect()}
    many = {tuple(r) for r in A.link_figures(df.repartition(17), A.default_paths()).collect()}
    assert one == many == {(i, *r) for i, r in enumerate(_plain(texts))}


def test_quick_encoder_is_the_library(spark):
    al = A.aligner(*A.default_paths())
    assert al.quick is not None
    for text in filter(None, TEXTS):
        assert al._byte_ids([" " + text])[0] == [i for i, _ in _tokens(text)[0]]


def test_workers_get_texts_by_a_few_mb(spark):
    from ludex.llm.common import BATCH_MB, map_arrow

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    docs = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("word "), 20_000).alias("text"))
    got = map_arrow(docs, sizes, "n bigint, size bigint").collect()
    assert sum(r.n for r in got) == 400
    assert max(r.size for r in got) < (BATCH_MB + 1) << 20
