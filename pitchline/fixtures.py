"""Views that give the star-schema test tables the shape of match tables.

Each is SQL text that Spark and DuckDB run alike, but for ``feat_long``. ``view`` runs
one in Spark; ``with_views`` puts the ones a statement needs in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS = {
    "matches": """
SELECT o_orderkey AS match_id, o_orderdate AS match_datetime_utc, CAST(year(o_orderdate) AS STRING) AS name,
       CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_orderpriority END AS tournament,
       o_custkey % 40 AS home_team_id, (o_custkey + 1 + o_orderkey % 39) % 40 AS away_team_id
FROM orders""",
    "halves": """
SELECT o.o_orderkey AS match_id,
       CASE WHEN o.o_orderkey % 97 = 0 THEN NULL ELSE count(CASE WHEN l_returnflag='A' AND l_linestatus='F' THEN 1 END) END AS home_1st_corners,
       count(CASE WHEN l_returnflag='A' AND l_linestatus='O' THEN 1 END) AS home_2nd_corners,
       count(CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN 1 END) AS away_1st_corners,
       count(CASE WHEN l_returnflag='R' AND l_linestatus='O' THEN 1 END) AS away_2nd_corners,
       count(CASE WHEN l_returnflag='N' AND l_linenumber % 2 = 0 THEN 1 END) AS home_score,
       count(CASE WHEN l_returnflag='N' AND l_linenumber % 2 = 1 THEN 1 END) AS away_score
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey""",
    "ev_matches": """
SELECT c_custkey AS match_id, CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE CAST(0 AS BIGINT) END AS home_team_id,
       CAST(1 AS BIGINT) AS away_team_id, c_custkey % 9 AS home_score, (c_custkey * 7) % 8 AS away_score
FROM customer""",
    "ev_base": """
SELECT event_id, user_id AS match_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id % 2 END AS team_id,
       event_id % 11 AS player_id, CASE WHEN event_id % 41 = 0 THEN NULL ELSE (event_id * 7) % 126 END AS minute,
       CASE WHEN event_type IN ('purchase','signup') THEN 'goal' ELSE event_type END AS event_type
FROM events""",
    "ev_shots": """
SELECT event_id, CASE WHEN (event_id * 7) % 126 > 90 AND event_id % 2 = 0 THEN (event_id * 7) % 126 - 90 ELSE event_id % 6 END AS added_time
FROM events WHERE event_id % 3 <> 0""",
    "pred1x2": """
SELECT o_orderkey AS match_id, m.model, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS y_true,
       CAST(1 + (o_orderkey * m.k) % 7 AS DOUBLE) / (3 + (o_orderkey * m.k) % 7 + (o_custkey + m.k) % 11 + (o_orderkey + o_custkey * m.k) % 5) AS p0,
       CAST(1 + (o_custkey + m.k) % 11 AS DOUBLE) / (3 + (o_orderkey * m.k) % 7 + (o_custkey + m.k) % 11 + (o_orderkey + o_custkey * m.k) % 5) AS p1,
       CAST(1 + (o_orderkey + o_custkey * m.k) % 5 AS DOUBLE) / (3 + (o_orderkey * m.k) % 7 + (o_custkey + m.k) % 11 + (o_orderkey + o_custkey * m.k) % 5) AS p2
FROM orders CROSS JOIN (SELECT 'm1' AS model, 1 AS k UNION ALL SELECT 'm2', 2 UNION ALL SELECT 'm3', 3 UNION ALL SELECT 'm4', 4 UNION ALL SELECT 'm5', 5) m""",
    "predcnt": """
SELECT h.match_id, coalesce(h.home_1st_corners,0) + h.home_2nd_corners AS y_home, h.away_1st_corners + h.away_2nd_corners AS y_away,
       0.25 + (h.match_id % 17) / CAST(8 AS DOUBLE) AS mu_home, 0.25 + (h.match_id % 13) / CAST(8 AS DOUBLE) AS mu_away,
       0.05 + (h.match_id % 5) / CAST(10 AS DOUBLE) AS alpha_home, 0.05 + (h.match_id % 7) / CAST(10 AS DOUBLE) AS alpha_away
FROM halves h""",
    "feat_long": """
SELECT vec_id AS rix, CAST(pos AS INT) AS feature, CAST(val AS DOUBLE) AS value, label
FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, val""",
    "nullimp": "SELECT rix AS run, feature, abs(value) AS imp FROM feat_long",
    "realimp": """
SELECT feature, max(abs(value)) * (0.6 + (feature % 3) / CAST(4 AS DOUBLE)) AS imp_real
FROM feat_long GROUP BY feature""",
}

DUCKDB_ONLY = {
    "feat_long": """
SELECT vec_id AS rix, CAST(i - 1 AS INT) AS feature, CAST(embedding[i] AS DOUBLE) AS value, label
FROM embeddings, (SELECT unnest(range(1,65)) AS i)""",
}


def _used(sql: str) -> list[str]:
    """Views that a statement reads, those they read first."""
    out: list[str] = []
    for name, body in VIEWS.items():
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            out += [x for x in [*_used(body), name] if x not in out]
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables in ``sf_dir``."""
    sql, frames = VIEWS[name], {}
    for other in [*TABLES, *VIEWS]:
        if re.search(rf"\b(FROM|JOIN)\s+{other}\b", sql):
            frames[other] = view(spark, sf_dir, other) if other in VIEWS else spark.read.parquet(f"{sf_dir}/{other}.parquet")
            sql = re.sub(rf"\b(FROM|JOIN)\s+{other}\b", rf"\1 {{{other}}}", sql)
    return spark.sql(sql, **frames)


def with_views(sql: str) -> str:
    """DuckDB text: the statement with the views it reads as common tables."""
    own = re.sub(r"^\s*WITH\s+", "", sql, flags=re.I)
    needed = _used(sql)
    if not needed:
        return sql
    parts = ", ".join(f"{v} AS ({DUCKDB_ONLY.get(v, VIEWS[v])})" for v in needed)
    return f"WITH {parts}, {own}" if own != sql else f"WITH {parts} {sql}"
