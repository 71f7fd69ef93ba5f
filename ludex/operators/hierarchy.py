"""Parent/child trees (J10, K9): level-by-level walk and seeding.

The walk is the DataFrame form of a recursive CTE: one equi-join per level
(children to the previous level on parent id), so the number of jobs grows
with tree depth, not with rows.  A path-membership guard stops cycles (the
reference's recursive SQL would loop on one).  Lineage is cut every few
levels with ``checkpoint()`` into the session's shared checkpoint folder, and
the result is one checkpoint: no level stays cached.
"""

from __future__ import annotations

from itertools import count

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ludex.session import checkpoint_dir


def walk(nodes: DataFrame, roots: DataFrame, id_col: str = "dev_id", parent_col: str = "parent_dev_id",
         name_col: str = "name", sep: str = " > ", checkpoint_every: int = 8) -> DataFrame:
    """(id, name, parent, path, depth) for every node reachable from ``roots``.

    ``roots`` has the columns of ``nodes``; their depth is 0 and path is the name.
    """
    base = nodes.select(id_col, name_col, parent_col)
    level = roots.select(id_col, name_col, parent_col, F.col(name_col).cast("string").alias("path"),
                         F.lit(0).alias("depth"), F.array(F.col(id_col)).alias("_seen"))
    level = level.persist(StorageLevel.MEMORY_AND_DISK)
    levels = [level]
    for depth in count(1):  # the path guard ends the loop
        prev = level.select(F.col(id_col).alias("_pid"), F.col("path").alias("_ppath"), "_seen")
        nxt = (base.join(prev, base[parent_col] == prev["_pid"])
                   .filter(~F.array_contains(F.col("_seen"), F.col(id_col)))
                   .select(id_col, name_col, parent_col,
                           F.concat(F.col("_ppath"), F.lit(sep), F.col(name_col)).alias("path"),
                           F.lit(depth).alias("depth"),
                           F.concat(F.col("_seen"), F.array(F.col(id_col))).alias("_seen")))
        if depth % checkpoint_every == 0:
            checkpoint_dir(nxt.sparkSession)
            nxt = nxt.checkpoint(eager=True)
        else:
            nxt = nxt.persist(StorageLevel.MEMORY_AND_DISK)
        if nxt.isEmpty():
            break
        levels.append(nxt)
        level = nxt
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    # the levels are released once the result has a copy of its own
    checkpoint_dir(out.sparkSession)
    out = out.drop("_seen").checkpoint(eager=True)
    for lv in [*levels, nxt]:
        lv.unpersist()
    return out


def roots_of(nodes: DataFrame, id_col: str = "dev_id", parent_col: str = "parent_dev_id",
             linked_only: bool = False) -> DataFrame:
    """Nodes without a parent; with ``linked_only`` only those that have children."""
    r = nodes.filter(F.col(parent_col).isNull())
    if linked_only:
        parents = nodes.filter(F.col(parent_col).isNotNull()).select(F.col(parent_col).alias(id_col))
        r = r.join(parents, id_col, "left_semi")
    return r


def seed(nodes: DataFrame, mapping: dict, id_col: str = "dev_id", parent_col: str = "parent_dev_id",
         name_col: str = "name") -> DataFrame:
    """K9: insert missing parent names (new ids after the current max, in
    mapping order); set the parent of listed children whose parent is NULL."""
    spark = nodes.sparkSession
    parents = spark.createDataFrame([(p, i) for i, p in enumerate(mapping)], f"{name_col} string, _ord int")
    first = {}  # a child listed under several parents goes to the first
    for p, cs in mapping.items():
        for c in cs:
            first.setdefault(c, p)
    links = spark.createDataFrame(list(first.items()),
                                  f"_child string, _parent string")
    missing = parents.join(nodes.select(name_col), name_col, "left_anti")
    max_id = nodes.agg(F.max(id_col)).scalar()
    new = missing.select((max_id + F.row_number().over(Window.orderBy("_ord"))).cast("bigint").alias(id_col),
                         name_col, F.lit(None).cast("bigint").alias(parent_col))
    all_nodes = nodes.select(id_col, name_col, parent_col).unionByName(new)
    pid = links.join(all_nodes.select(F.col(name_col).alias("_parent"), F.col(id_col).alias("_pid")), "_parent")
    pid = pid.select(F.col("_child").alias(name_col), "_pid")
    return (all_nodes.join(pid, name_col, "left")
                     .withColumn(parent_col, F.coalesce(F.col(parent_col), F.col("_pid")))
                     .select(id_col, name_col, parent_col))
