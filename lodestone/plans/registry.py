"""The registry of queries and the fact views that they read.

The views are written in SQL that Spark and DuckDB both run, so a query and its oracle start from the same facts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

VIEWS: dict[str, str] = {
    "br_edges": """
WITH seq AS (
  SELECT l_partkey AS src, l_quantity AS q,
         lead(l_partkey) OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS tgt
  FROM {lineitem})
SELECT DISTINCT concat('r', CAST(src % 5 AS STRING), ':p', CAST(src AS STRING)) AS source,
       concat('r', CAST(tgt % 5 AS STRING), ':p', CAST(tgt AS STRING)) AS target,
       CASE WHEN (src + tgt) % 3 = 0 THEN 'calls' ELSE 'imports' END AS kind,
       concat('r', CAST(src % 5 AS STRING)) AS repo
FROM seq WHERE tgt IS NOT NULL AND src <> tgt AND q >= 48""",
    "br_symbols": """
SELECT concat('r', CAST(p_partkey % 5 AS STRING)) AS repo,
       concat('r', CAST(p_partkey % 5 AS STRING), ':p', CAST(p_partkey AS STRING)) AS path, p_name AS name,
       CASE p_size % 4 WHEN 0 THEN 'interface' WHEN 1 THEN 'type' ELSE 'class' END AS kind, (p_size % 3 <> 0) AS exported
FROM {part}
UNION ALL
SELECT concat('r', CAST(p_partkey % 5 AS STRING)), concat('r', CAST(p_partkey % 5 AS STRING), ':p', CAST(p_partkey AS STRING)),
       p_brand, CASE WHEN p_size % 5 = 0 THEN 'interface' ELSE 'function' END, false
FROM {part} WHERE p_size % 2 = 0""",
    "br_commits": """
SELECT DISTINCT l_orderkey AS hash, concat(p_brand, '/', CAST(p_size AS STRING)) AS file_path
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "br_files": """
SELECT concat(p_brand, '/', CAST(p_size AS STRING)) AS file_path, count(*) AS symbol_count, concat('r', CAST(min(p_partkey) % 5 AS STRING)) AS repo
FROM {part} GROUP BY concat(p_brand, '/', CAST(p_size AS STRING))""",
    "br_findings": """
SELECT event_id AS ord,
       CASE event_type WHEN 'error' THEN 'fault/unhandled-error-path' WHEN 'click' THEN 'structural/dead-export'
         WHEN 'view' THEN 'hotspot/high-churn-complexity' WHEN 'signup' THEN 'config/dead-flag' ELSE 'arch/layer-violation' END AS rule_id,
       CASE WHEN value >= 100 THEN 'error' WHEN value >= 30 THEN 'warning' ELSE 'note' END AS level,
       concat(event_type, ' on u', CAST(user_id AS STRING)) AS message, concat('r', CAST(user_id % 5 AS STRING)) AS repo,
       concat('u', CAST(user_id AS STRING)) AS fqn,
       CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'baseline' ELSE 'current' END AS snapshot
FROM {events}""",
    "br_docs": "SELECT doc_id AS id, text AS content, source AS repo FROM {documents}",
    "br_flags": """
SELECT DISTINCT concat('r', CAST(user_id % 5 AS STRING)) AS repo, concat('k', regexp_extract(props, '[0-9]+', 0)) AS name,
       concat('u', CAST(user_id AS STRING)) AS module
FROM {events} WHERE event_type = 'error'""",
    "br_service_calls": """
SELECT DISTINCT concat('f', CAST(l_suppkey AS STRING)) AS source, concat('ep', CAST(l_partkey % 200 AS STRING)) AS endpoint,
       CASE l_returnflag WHEN 'A' THEN 'producer' WHEN 'R' THEN 'consumer' ELSE 'client' END AS role,
       concat('r', CAST(l_suppkey % 7 AS STRING)) AS repo
FROM {lineitem} WHERE l_linenumber = 7 AND l_quantity >= 48""",
    "br_nodes": """
SELECT event_id, concat('fn', CAST(user_id AS STRING)) AS function_id,
       CASE event_id % 12 WHEN 0 THEN 'await api.get(x)' WHEN 1 THEN 'await api.post(y)' WHEN 2 THEN 'await bus.send(z)' WHEN 3 THEN 'fetch(u)'
         WHEN 4 THEN 'catch (e)' WHEN 5 THEN 'for attempt in retry' WHEN 6 THEN 'users.findOne(i)' WHEN 7 THEN 'new AbortController()'
         WHEN 8 THEN 'm.get(k) ?? d' WHEN 9 THEN 'await sleep(1)' WHEN 10 THEN 'delay * 2' ELSE 'x = 1' END AS label
FROM {events}""",
    "br_params": """
SELECT concat('p', CAST(p_partkey AS STRING)) AS name, CASE WHEN p_size % 3 = 0 THEN 'setting' ELSE 'flag' END AS kind,
       CASE p_size % 3 WHEN 0 THEN 'number' ELSE 'boolean' END AS value_type,
       CASE WHEN p_size % 7 <> 0 THEN concat('r', CAST(p_partkey % 5 AS STRING), ':p', CAST(p_partkey - p_partkey % 20 + p_partkey % 5 AS STRING)) END AS module,
       CASE WHEN p_size % 4 = 0 THEN p_brand END AS choice, CASE WHEN p_size % 5 = 0 THEN 1 END AS range_min, CASE WHEN p_size % 5 = 0 THEN p_size END AS range_max
FROM {part}""",
    "br_constraints": """
SELECT DISTINCT CASE l_linenumber WHEN 1 THEN 'requires' WHEN 2 THEN 'mutex' WHEN 3 THEN 'implies' WHEN 4 THEN 'always' WHEN 5 THEN 'excludes' ELSE 'requires' END AS kind,
       concat('p', CAST(l_partkey AS STRING)) AS a, CASE WHEN l_linenumber <> 4 THEN concat('p', CAST(l_partkey * 7 % 2100 AS STRING)) END AS b
FROM {lineitem} WHERE l_linenumber <= 6""",
    "br_registry": "SELECT DISTINCT concat('p', CAST(user_id * 3 AS STRING)) AS name FROM {events}",
    "br_logs": """
SELECT event_id AS ord, concat('r', CAST(user_id % 5 AS STRING)) AS repo,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS severity,
       concat(event_type, ' for user ', CAST(user_id AS STRING), ' key ', regexp_extract(props, '[0-9]+', 0)) AS message
FROM {events}""",
}


class Facts:
    """The tables of a folder and the views over them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """SQL whose {names} are tables or views."""
        used = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{n: self[n] for n in used})


def oracle(text: str, **ctes: str) -> str:
    """DuckDB SQL: `text` after the views and the given CTEs that it names, in order."""
    parts, have = [], set()

    def need(sql: str) -> None:
        for name in VIEWS:
            if name not in have and re.search(rf"\b{name}\b", sql):
                have.add(name)
                parts.append(f"{name} AS ({re.sub(r'[{}]', '', VIEWS[name])})")

    for name, sql in ctes.items():
        need(sql)
        parts.append(f"{name} AS ({sql})")
    need(text)
    return f"WITH RECURSIVE {', '.join(parts)}\n{text}" if parts else text


def query(name: str, sql: str | None = None, **ctes: str) -> Callable[[Callable[[Facts], DataFrame]], Callable[[Facts], DataFrame]]:
    """Registers a query; sql, over the views and the CTEs, gives the same rows in DuckDB."""

    def register(f: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = lambda spark, sf_dir: f(Facts(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql, **ctes)
        return f

    return register
