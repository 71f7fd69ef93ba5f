"""The corpus operators as named queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, extraction, licenses, lthash, mixing, packing, ppm, quality, rabitq, rtree, simhash, simple8b, toxicity
from .common import shared_path, table
from .encoding import default_path


def op1_embedding_near_dup(spark, sf_dir):
    """All rows of embeddings linked at cosine 0.95 and above."""
    return rabitq.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_multiset_fingerprints(spark, sf_dir):
    """Multiset fingerprints of every document and of its edited text."""
    return lthash.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_simple8b(spark, sf_dir):
    """Every document's ids, written as Simple-8b blocks and read back."""
    path = shared_path(spark, "simple8b")
    simple8b.write(table(spark, sf_dir, "documents").select("doc_id", "text"), path, default_path())
    return simple8b.read(spark, path, digest=True)


def op4_license_scan(spark, sf_dir):
    """Licence wordings in every document."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_ppm_scores(spark, sf_dir):
    """Unigram and PPM scores of every document."""
    return ppm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_best_fit_packing(spark, sf_dir):
    """Every document's pieces packed into sequences of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path())


def op7_source_mixing(spark, sf_dir):
    """What a mix of 150% of all words by source weights takes from each document."""
    return mixing.taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_simhash_bktree(spark, sf_dir):
    """SimHash fingerprints of every document and their groups within 3 bits."""
    return simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_subword_toxicity(spark, sf_dir):
    """Toxicity scores of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_neighbour_quality(spark, sf_dir):
    """Quality scores of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_token_alignment(spark, sf_dir):
    """Groups and links of two tokenizations of every document."""
    return alignment.link_figures(table(spark, sf_dir, "documents").select("doc_id", "text"), alignment.default_paths())


def op12_html_extraction(spark, sf_dir):
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract(pages, extraction.fit(pages))


def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of the rows whose vec_id is divisible by 100, on vectors of floor(256 * x)."""
    rows = table(spark, sf_dir, "embeddings").where(
        "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    rows = rows.select("vec_id", label.alias("label"), whole.alias("embedding"))
    return rtree.hard_negatives(rows, F.col("id") % 100 == 0)


def queries():
    return {f.__name__: f for f in (
        op1_embedding_near_dup, op2_multiset_fingerprints, op3_simple8b, op4_license_scan, op5_ppm_scores,
        op6_best_fit_packing, op7_source_mixing, op8_simhash_bktree, op9_subword_toxicity, op10_neighbour_quality,
        op11_token_alignment, op12_html_extraction, op13_hard_negatives)}


OP1_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), link AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(vec_id, other) AS (
    SELECT vec_id, vec_id FROM v
    UNION
    SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.other
)
SELECT v.vec_id,
       (SELECT count(*) FROM link l WHERE l.a = v.vec_id) AS n_links,
       (SELECT min(other) FROM reach r WHERE r.vec_id = v.vec_id) AS component_id,
       (SELECT min(other) FROM reach r WHERE r.vec_id = v.vec_id) = v.vec_id AS kept
FROM v
"""


OP13_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), score AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
           CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM score WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN score s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


def oracle_sql():
    return {"op1_embedding_near_dup": OP1_SQL, "op13_hard_negatives": OP13_SQL}
