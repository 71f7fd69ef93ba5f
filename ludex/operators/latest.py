"""Latest row per key.

``max_by(struct(cols), order)`` is a declarative aggregate: Spark runs it as a
partial (map-side) aggregation followed by a final one, so a key that holds a
third of all rows is reduced on every map task before the shuffle -- no sort,
no single hot task.  The latest *row* is kept even when its value is NULL,
as the reference's DISTINCT ON does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys, order, cols, skip_null: str | None = None) -> DataFrame:
    """One row per ``keys``: the values of ``cols`` on the row with max ``order``.

    ``order`` is a column name or list of names (compared as a struct, so
    later names break ties).  ``skip_null``: name of a column whose NULL rows
    are ignored (the "latest known value" variant).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    cols = [c for c in cols if c not in keys]
    src = df if skip_null is None else df.filter(F.col(skip_null).isNotNull())
    ord_col: Column = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(o) for o in order])
    packed = F.max_by(F.struct(*[F.col(c) for c in cols]), ord_col).alias("_latest")
    out = src.groupBy(*keys).agg(packed)
    return out.select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in cols])
