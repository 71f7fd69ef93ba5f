"""The driver's synthetic parquet tables (one file per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]


class Raw(dict):
    """Lazy name -> DataFrame mapping over ``{sf_dir}/{name}.parquet``.

    Reading is lazy; Catalyst prunes columns and pushes filters into each
    scan, so a query only pays for the columns it uses.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __missing__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self[name] = df
        return df


def load(spark: SparkSession, sf_dir: str) -> Raw:
    return Raw(spark, sf_dir)
