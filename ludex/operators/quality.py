"""Quality operators: constraint audit (K11) and load report.

The reference enforces PK / UNIQUE / FK / NOT NULL / one-current-row in the
database; on files these become an audit: one row per rule with the number of
violating rows (0 = holds).

All rules are counted by one aggregate.  Every key of a table is read once and
tagged: as an owner of its key space (primary and unique keys, parents), as a
child of it (foreign keys), or as a null.  One aggregate of their union by key
counts owners and children -- partial counts on the map side, so a key with a
third of all rows is one row a task -- and a second one, by key space, adds up
what breaks a rule.  Scans read the key columns alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most tables whose foreign keys name one parent.
_CHILDREN = 5


@dataclass(frozen=True)
class Rule:
    """A constraint: ``kind`` is 'unique' (no key twice among the table's rows, nulls one key),
    'child' (every non-null key is some parent's) or 'filled' (the column isn't null).

    ``space`` names the key space that owners and children share; ``where`` restricts the rows."""

    name: str
    table: str
    kind: str
    keys: tuple[str, ...]
    space: str
    where: str = "true"


def _unique(name, table, *keys, where="true"):
    return Rule(name, table, "unique", keys, f"{table}.{','.join(keys)}{'' if where == 'true' else '?' + where}", where)


def _child(name, table, key, space):
    return Rule(name, table, "child", (key,), space)


def _filled(name, table, key):
    return Rule(name, table, "filled", (key,), f"null:{table}.{key}")


RULES = [
    _unique("pk", "developers", "dev_id"), _unique("unique_name", "developers", "name"),
    _child("fk_parent", "developers", "parent_dev_id", "developers.dev_id"),
    _unique("pk", "games", "app_id"), _filled("not_null_name", "games", "name"), _child("fk_dev", "games", "dev_id", "developers.dev_id"),
    _unique("pk", "tags", "tag_id"), _unique("unique_name", "tags", "tag_name"),
    _unique("pk", "game_tags", "app_id", "tag_id"), _child("fk_app", "game_tags", "app_id", "games.app_id"),
    _child("fk_tag", "game_tags", "tag_id", "tags.tag_id"),
    _unique("pk", "genres", "genre_id"), _unique("unique_name", "genres", "genre_name"),
    _filled("not_null_name", "developers", "name"), _filled("not_null_name", "tags", "tag_name"), _filled("not_null_name", "genres", "genre_name"),
    _unique("pk", "game_genres", "app_id", "genre_id"), _child("fk_app", "game_genres", "app_id", "games.app_id"),
    _child("fk_genre", "game_genres", "genre_id", "genres.genre_id"), _child("fk_app", "price_history", "app_id", "games.app_id"),
    _unique("pk", "player_counts", "app_id", "snapshot_time"), _child("fk_app", "player_counts", "app_id", "games.app_id"),
    _unique("one_current", "price_history", "app_id", "currency_code", where="is_current"),
    _unique("pk", "reviews", "review_id"), _child("fk_app", "reviews", "app_id", "games.app_id"),
]


def _key(df: DataFrame, keys) -> list[Column]:
    """A key of up to two whole numbers and a text."""
    whole, text = [], []
    for k in keys:
        kind = df.schema[k].dataType.typeName()
        if kind in ("string", "char", "varchar"):
            text.append(F.col(k))
        else:
            whole.append(F.unix_micros(F.col(k).cast("timestamp")) if kind.startswith("timestamp") else F.col(k).cast("bigint"))
    whole += [F.lit(None).cast("bigint")] * (2 - len(whole))
    return [whole[0].alias("k1"), whole[1].alias("k2"), (text[0] if text else F.lit(None).cast("string")).alias("k3")]


def audit(t, rules=RULES) -> DataFrame:
    """Constraint audit of the warehouse tables ``t``: (rule, table, violations), a row a rule."""
    spaces = {s: i for i, s in enumerate(dict.fromkeys(r.space for r in rules))}
    role, children = {}, {}
    for r in rules:  # the place of a rule among those of its key space: 0 the owner, then its children
        if r.kind == "child":
            children[r.space] = children.get(r.space, 0) + 1
            role[r] = children[r.space]
        else:
            role[r] = 0
    width = max([*children.values(), _CHILDREN])
    none = [F.lit(0).cast("bigint").alias("k1"), F.lit(None).cast("bigint").alias("k2"), F.lit(None).cast("string").alias("k3")]

    def tagged(r: Rule) -> DataFrame:
        takes_part = {"unique": F.expr(r.where), "child": F.col(r.keys[0]).isNotNull(), "filled": F.col(r.keys[0]).isNull()}[r.kind]
        df = t[r.table].where(takes_part)
        return df.select(F.lit(spaces[r.space]).alias("space"), F.lit(role[r]).alias("role"), *(none if r.kind == "filled" else _key(df, r.keys)))

    rows = reduce(lambda a, b: a.unionByName(b), map(tagged, rules))
    per_key = rows.groupBy("space", "k1", "k2", "k3").agg(
        F.count_if(F.col("role") == 0).alias("c0"), *[F.count_if(F.col("role") == i).alias(f"c{i}") for i in range(1, width + 1)])
    # by key space: keys with several owners, owners in all, and children without an owner
    orphan = [F.sum(F.when(F.col("c0") == 0, F.col(f"c{i}")).otherwise(0)).alias(f"o{i}") for i in range(1, width + 1)]
    found = per_key.groupBy("space").agg(F.count_if(F.col("c0") > 1).alias("twice"), F.sum("c0").alias("owners"), *orphan)
    found = found.select("space", F.array("twice", "owners", *[f"o{i}" for i in range(1, width + 1)]).alias("counts"))
    place = {"unique": lambda r: 0, "filled": lambda r: 1, "child": lambda r: 1 + role[r]}
    listed = t["games"].sparkSession.createDataFrame(
        [(r.name, r.table, spaces[r.space], place[r.kind](r)) for r in rules], "rule string, table string, space int, place int")
    return listed.join(found, "space", "left").select("rule", "table", F.coalesce(F.get("counts", "place"), F.lit(0)).cast("bigint").alias("violations"))


def load_report(df: DataFrame, status_col: str = "status") -> DataFrame:
    """Counters per status (linked / ok / empty / error / skipped) in one row."""
    statuses = ["linked", "ok", "empty", "error", "skipped"]
    return df.agg(*[F.count_if(F.col(status_col) == s).alias(s) for s in statuses],
                  F.count(F.lit(1)).alias("total"))
