"""The corpus pipeline: five stages, each applying one operator to all that the one before kept.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ludex.llm import mixing, packing, quality, simhash, toxicity
from ludex.llm.common import stored, table
from ludex.llm.encoding import default_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, predicts 0."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality vote, over the labelled ones among them, predicts 1."""
    space = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, space)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest doc_id."""
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: a row per document and pass, with the words it takes."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix, packed into sequences of 2048 ids."""
    return packing.pack(docs, default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("simhash", drop_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The trained models, SimHash and token ids can't be expressed in SQL; the stages are tested
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
