"""DuckDB SQL for the warehouse tables (same definitions as sources/warehouse.py).

Every oracle query is ``WITH <prelude>, <own ctes> SELECT ...`` over the
driver's pre-registered views of the test tables.  DuckDB only evaluates the
CTEs a query references.
"""

from __future__ import annotations

PRELUDE = [
    ("developers", """
    SELECT CAST(1000000 + r_regionkey AS BIGINT) AS dev_id, r_name AS name,
           CAST(NULL AS BIGINT) AS parent_dev_id FROM region
    UNION ALL
    SELECT CAST(2000000 + n_nationkey AS BIGINT), n_name, CAST(1000000 + n_regionkey AS BIGINT) FROM nation
    UNION ALL
    SELECT CAST(s_suppkey AS BIGINT), s_name, CAST(2000000 + s_nationkey AS BIGINT) FROM supplier"""),
    ("games", """
    SELECT p_partkey AS app_id, p_name AS name,
           CAST(NULL AS VARCHAR) AS description, CAST(NULL AS DATE) AS release_date,
           CAST(p_partkey % (SELECT count(*) FROM supplier) AS BIGINT) AS dev_id,
           CAST(CASE WHEN p_partkey % 11 = 0 THEN NULL
                     WHEN p_size <= 5 THEN 0
                     ELSE p_size * 1.5 - 4.01 END AS DECIMAL(10,2)) AS base_price_usd
    FROM part"""),
    ("game_tag_names", """
    SELECT DISTINCT app_id, tag_name FROM (
        SELECT p_partkey AS app_id, unnest(string_split(p_name, ' ')) AS tag_name FROM part
        UNION ALL SELECT p_partkey, p_brand FROM part
        UNION ALL SELECT p_partkey, 'Size ' || CAST(p_size AS VARCHAR) FROM part
        UNION ALL SELECT p_partkey, 'Free to Play' FROM part WHERE p_partkey % 22 = 0
    ) WHERE tag_name <> ''"""),
    ("tags", """
    SELECT CAST(row_number() OVER (ORDER BY tag_name) AS BIGINT) AS tag_id, tag_name
    FROM (SELECT DISTINCT tag_name FROM game_tag_names)"""),
    ("game_tags", """
    SELECT n.app_id, t.tag_id FROM game_tag_names n JOIN tags t ON t.tag_name = n.tag_name"""),
    ("game_genre_names", """
    SELECT DISTINCT app_id, genre_name FROM (
        SELECT p_partkey AS app_id, p_type AS genre_name FROM part
        UNION ALL SELECT p_partkey, 'BIG' FROM part WHERE p_size > 25)"""),
    ("genres", """
    SELECT CAST(row_number() OVER (ORDER BY genre_name) AS BIGINT) AS genre_id, genre_name
    FROM (SELECT DISTINCT genre_name FROM game_genre_names)"""),
    ("game_genres", """
    SELECT n.app_id, g.genre_id FROM game_genre_names n JOIN genres g ON g.genre_name = n.genre_name"""),
    ("player_counts", """
    SELECT app_id, snapshot_time,
           CASE WHEN s % 17 = 0 THEN NULL ELSE s END AS concurrent_players,
           CAST((s // 10) * 10000 AS VARCHAR) || ' .. ' || CAST((s // 10 + 1) * 10000 AS VARCHAR) AS owners_estimate
    FROM (SELECT l_partkey AS app_id, l_shipdate AS snapshot_time,
                 CAST(floor(sum(l_quantity)) AS INTEGER) AS s
          FROM lineitem GROUP BY l_partkey, l_shipdate)"""),
    ("price_feed", """
    SELECT l_partkey AS app_id,
           CASE WHEN l_linestatus = 'O' THEN 'USD' ELSE 'INR' END AS currency_code,
           CAST(CASE WHEN p_size <= 5 THEN 0
                     ELSE (p_size * 1.5 - 4.01) * (0.9 + CAST(l_tax AS DECIMAL(4,2)))
                          * (CASE WHEN l_linestatus = 'O' THEN 1 ELSE 80 END)
                END AS DECIMAL(10,2)) AS price,
           CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS INTEGER) AS discount_pct,
           l_shipdate AS ts, l_orderkey, l_linenumber, l_suppkey, l_quantity
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE NOT (p_partkey % 11 = 0 AND p_partkey % 5 < 3)"""),
    ("price_flagged", """
    SELECT *,
           row_number() OVER w AS rn,
           lag(price) OVER w AS prev_price,
           lag(discount_pct) OVER w AS prev_discount
    FROM price_feed
    WINDOW w AS (PARTITION BY app_id, currency_code
                 ORDER BY ts, l_orderkey, l_linenumber, price, discount_pct, l_suppkey, l_quantity)"""),
    ("price_history", """
    SELECT app_id, currency_code, price, discount_pct, valid_from, valid_to,
           valid_to IS NULL AS is_current, version
    FROM (
        SELECT app_id, currency_code, price, discount_pct, ts AS valid_from,
               lead(ts) OVER (PARTITION BY app_id, currency_code ORDER BY rn) AS valid_to,
               row_number() OVER (PARTITION BY app_id, currency_code ORDER BY rn) AS version
        FROM price_flagged
        WHERE rn = 1 OR price IS DISTINCT FROM prev_price OR discount_pct IS DISTINCT FROM prev_discount)"""),
    ("reviews", """
    SELECT event_id AS review_id, user_id AS app_id, ts AS review_time,
           event_type <> 'error' AS is_positive,
           CAST(floor(value * 60) AS INTEGER) AS playtime_at_review
    FROM events"""),
    ("reviews_full", """
    SELECT r.*, d.text AS review_text, e.embedding AS review_embedding
    FROM reviews r
    LEFT JOIN documents d ON d.doc_id = r.review_id
    LEFT JOIN embeddings e ON e.vec_id = r.review_id"""),
]


def sql(select: str, ctes=()) -> str:
    """``WITH prelude, ctes SELECT``; ``ctes`` is a list of (name, body)."""
    parts = [f"{name} AS ({body}\n)" for name, body in [*PRELUDE, *ctes]]
    return "WITH " + ",\n".join(parts) + "\n" + select


def rnd(expr: str, digits: int) -> str:
    """Round like the Spark side: through DECIMAL(38,10), half away from zero, as DOUBLE."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def sql_list(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def int_list(values) -> str:
    return "(" + ", ".join(str(int(v)) for v in values) + ")"
