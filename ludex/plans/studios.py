"""Studio hierarchy views: full tree, linked tree, seeding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ludex.config import STUDIO_SEED, TREE_SEPARATOR, TREE_SEPARATOR_SIGNALS
from ludex.operators import hierarchy as H
from ludex.plans.prelude import sql
from ludex.plans.registry import register

# Extra seed links over the synthetic region names, so seeding changes the tree.
TEST_SEED = {**STUDIO_SEED, "Test Holding": ["AFRICA", "EUROPE"]}


def _tree(t, linked: bool, sep: str):
    d = t["developers"]
    tree = H.walk(d, H.roots_of(d, linked_only=linked), sep=sep)
    games = t["games"].groupBy("dev_id").agg(F.count("app_id").alias("_n"))
    j = tree.join(games, "dev_id", "left")
    return j.groupBy("path", "depth").agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("game_count"))


def _tree_sql(linked: bool, sep: str) -> str:
    # every studio climbs to its root, putting each ancestor before its path
    only = "AND (steps > 0 OR dev_id IN (SELECT parent_dev_id FROM developers))" if linked else ""
    return "WITH RECURSIVE " + sql(f"""
SELECT path, steps AS depth, COALESCE(CAST(sum(n) AS BIGINT), 0) AS game_count
FROM climb LEFT JOIN (SELECT dev_id, count(*) AS n FROM games GROUP BY dev_id) USING (dev_id)
WHERE above IS NULL {only} GROUP BY ALL""", [("climb(dev_id, above, path, steps)", f"""
    SELECT dev_id, parent_dev_id, name, 0 FROM developers
    UNION ALL
    SELECT climb.dev_id, up.parent_dev_id, concat(up.name, '{sep}', path), steps + 1
    FROM climb JOIN developers up ON up.dev_id = above""")])[len("WITH "):]


# Q14 -----------------------------------------------------------------------
@register("studio_tree", _tree_sql(False, TREE_SEPARATOR))
def studio_tree(t, sep: str = TREE_SEPARATOR):
    """Every studio under its root: path, depth, number of games."""
    return _tree(t, False, sep)


# Q15 -----------------------------------------------------------------------
@register("studio_tree_linked", _tree_sql(True, TREE_SEPARATOR))
def studio_tree_linked(t, sep: str = TREE_SEPARATOR):
    """Only roots that have children, and their descendants."""
    return _tree(t, True, sep)


@register("studio_tree_signals", _tree_sql(True, TREE_SEPARATOR_SIGNALS))
def studio_tree_signals(t, sep: str = TREE_SEPARATOR_SIGNALS):
    """The signals-page form of the linked tree (other path separator)."""
    return _tree(t, True, sep)


# K9 ------------------------------------------------------------------------
def _seed_sql(mapping) -> str:
    def q(s):
        return "'" + s.replace("'", "''") + "'"
    seed_rows = ", ".join(f"({q(p)}, {i})" for i, p in enumerate(mapping))
    link_rows = ", ".join(f"({q(c)}, {q(p)})" for p, cs in mapping.items() for c in cs)
    return sql("""
SELECT d.dev_id, d.name, COALESCE(d.parent_dev_id, p.dev_id) AS parent_dev_id
FROM all_devs d LEFT JOIN links l ON l.child = d.name LEFT JOIN all_devs p ON p.name = l.parent""", [
        ("seed", f"SELECT * FROM (VALUES {seed_rows}) v(name, ord)"),
        ("links", f"SELECT * FROM (VALUES {link_rows}) v(child, parent)"),
        ("new_parents", """SELECT CAST((SELECT max(dev_id) FROM developers) + row_number() OVER (ORDER BY ord) AS BIGINT)
                              AS dev_id, name, CAST(NULL AS BIGINT) AS parent_dev_id
                           FROM seed WHERE name NOT IN (SELECT name FROM developers)"""),
        ("all_devs", "SELECT * FROM developers UNION ALL SELECT * FROM new_parents")])


@register("seed_hierarchy", _seed_sql(TEST_SEED))
def seed_hierarchy(t, mapping=TEST_SEED):
    """Developers after seeding known parent studios and links."""
    return H.seed(t["developers"], mapping)
