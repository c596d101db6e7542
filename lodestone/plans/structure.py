"""Queries over edges, symbols and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import metrics, mining, store
from lodestone.plans.registry import Facts, query

MODULES = """
SELECT repo, module, ca, ce, CASE WHEN ca + ce = 0 THEN 0 ELSE ce / CAST(ca + ce AS DOUBLE) END AS instability,
       CASE WHEN syms = 0 THEN 0 ELSE abst / CAST(syms AS DOUBLE) END AS abstractness
FROM (SELECT repo, module, CAST(sum(i) AS BIGINT) AS ca, CAST(sum(o) AS BIGINT) AS ce, CAST(sum(s) AS BIGINT) AS syms, CAST(sum(a) AS BIGINT) AS abst FROM (
  SELECT repo, source AS module, 0 AS i, count(DISTINCT target) AS o, 0 AS s, 0 AS a FROM br_edges WHERE kind = 'imports' GROUP BY 1, 2
  UNION ALL SELECT repo, target, count(DISTINCT source), 0, 0, 0 FROM br_edges WHERE kind = 'imports' GROUP BY 1, 2
  UNION ALL SELECT repo, path, 0, 0, count(*), count(*) FILTER (kind IN ('interface', 'type')) FROM br_symbols GROUP BY 1, 2) GROUP BY 1, 2)"""
METRICS = """
SELECT *, CASE WHEN instability < 0.3 AND abstractness < 0.3 THEN 'pain' WHEN instability > 0.7 AND abstractness > 0.7 THEN 'uselessness'
               WHEN distance < 0.3 THEN 'main-sequence' ELSE 'balanced' END AS zone
FROM (SELECT *, abs(abstractness + instability - CAST(1 AS DOUBLE)) AS distance FROM modules)"""
M = {"modules": MODULES, "metrics": METRICS}


def _metrics(f: Facts) -> DataFrame:
    return metrics.module_metrics(f["br_edges"], f["br_symbols"])


@query("ag_module_metrics", "SELECT repo, module, ca, ce, instability, abstractness, distance, zone FROM metrics", **M)
def ag_module_metrics(f: Facts) -> DataFrame:
    return _metrics(f)


SUMMARY = """
SELECT repo, count(*) AS module_count, round(avg(instability), 6) AS avg_instability, round(avg(abstractness), 6) AS avg_abstractness,
       round(avg(distance), 6) AS avg_distance, count(*) FILTER (zone = 'pain') AS pain_count, count(*) FILTER (zone = 'uselessness') AS useless_count,
       count(*) FILTER (starts_with(module, repo || ':')) AS internal_count,
       count(*) FILTER (zone = 'pain' AND starts_with(module, repo || ':')) AS internal_pain,
       count(*) FILTER (zone = 'uselessness' AND starts_with(module, repo || ':')) AS internal_useless
FROM metrics GROUP BY repo"""


@query("ag_repo_summary", SUMMARY, **M)
def ag_repo_summary(f: Facts) -> DataFrame:
    return metrics.repo_summary(_metrics(f))


@query(
    "jn_sdp",
    """SELECT e.repo, e.source, count(*) AS violations, round(max(t.instability - s.instability), 6) AS max_delta
    FROM br_edges e JOIN metrics s ON e.repo = s.repo AND e.source = s.module JOIN metrics t ON e.repo = t.repo AND e.target = t.module
    WHERE e.kind = 'imports' AND t.instability - s.instability > CAST(0.3 AS DOUBLE) AND NOT regexp_matches(e.target, '(?:^|[/\\\\])index\\.[jt]sx?$')
    GROUP BY 1, 2""",
    **M,
)
def jn_sdp(f: Facts) -> DataFrame:
    return metrics.unstable_dependencies(f["br_edges"], _metrics(f))


@query("ag_sdp", "SELECT count(*) AS sources, CAST(sum(v) AS BIGINT) AS violations FROM (SELECT e.source, count(*) AS v FROM br_edges e JOIN metrics s ON e.repo = s.repo AND e.source = s.module JOIN metrics t ON e.repo = t.repo AND e.target = t.module WHERE e.kind = 'imports' AND t.instability - s.instability > CAST(0.3 AS DOUBLE) GROUP BY e.repo, 1)", **M)
def ag_sdp(f: Facts) -> DataFrame:
    return metrics.unstable_dependencies(f["br_edges"], _metrics(f)).agg(F.count("*").alias("sources"), F.sum("violations").alias("violations"))


@query(
    "ag_zone_findings",
    """SELECT repo, module, CASE zone WHEN 'pain' THEN 'structural/pain-zone-module' ELSE 'structural/uselessness-zone-module' END AS rule_id FROM metrics
    WHERE starts_with(module, repo || ':') AND (zone = 'uselessness' OR zone = 'pain' AND ca > 0 AND NOT regexp_matches(module, '(?:^|[/\\\\])index\\.[jt]sx?$'))""",
    **M,
)
def ag_zone_findings(f: Facts) -> DataFrame:
    return metrics.zone_findings(_metrics(f))


@query(
    "jn_dead_exports",
    """SELECT repo, path, count(*) AS dead_exports FROM br_symbols s WHERE exported AND NOT EXISTS (
      SELECT 1 FROM br_edges e WHERE e.kind = 'imports' AND e.repo = s.repo AND e.target = s.path) GROUP BY 1, 2""",
)
def jn_dead_exports(f: Facts) -> DataFrame:
    return metrics.dead_exports(f["br_edges"], f["br_symbols"])


RATE = "CASE WHEN {x} < CAST({a} AS DOUBLE) THEN 'good' WHEN {x} < CAST({b} AS DOUBLE) THEN 'warning' ELSE 'critical' END"


@query(
    "ag_health",
    f"""SELECT repo, {RATE.format(x="avg_distance", a=0.2, b=0.4)} AS distance_rating,
    {RATE.format(x="pain_count / CAST(module_count AS DOUBLE)", a=0.1, b=0.25)} AS pain_rating,
    {RATE.format(x="useless_count / CAST(module_count AS DOUBLE)", a=0.05, b=0.15)} AS useless_rating FROM summary""",
    **M,
    summary=SUMMARY,
)
def ag_health(f: Facts) -> DataFrame:
    return metrics.structural_health(metrics.repo_summary(_metrics(f)))


@query(
    "ag_dsm",
    """SELECT source, target, count(*) AS n FROM br_edges WHERE kind = 'imports' AND source IN (SELECT module FROM best) AND target IN (SELECT module FROM best) GROUP BY 1, 2""",
    best="""SELECT module FROM (SELECT source AS module FROM br_edges WHERE kind = 'imports' UNION ALL SELECT target FROM br_edges WHERE kind = 'imports')
      GROUP BY 1 ORDER BY count(*) DESC, module LIMIT 80""",
)
def ag_dsm(f: Facts) -> DataFrame:
    return metrics.dependency_matrix(f["br_edges"])


_QUART = ", ".join(f"round(quantile_cont({c}, {q}), 4) AS {c}_{n}" for c in ("distance", "instability") for n, q in (("min", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1.0)))


@query("ag_report_metrics", f"SELECT repo, count(*) AS modules, {_QUART} FROM metrics GROUP BY repo", **M)
def ag_report_metrics(f: Facts) -> DataFrame:
    return metrics.report_metrics(_metrics(f))


@query(
    "ag_report_graph",
    """SELECT kind, edges, nodes, round(edges / CAST(nodes AS DOUBLE), 4) AS avg_fan FROM (SELECT kind, count(*) AS edges FROM br_edges GROUP BY 1)
    JOIN (SELECT kind, count(DISTINCT node) AS nodes FROM (SELECT kind, source AS node FROM br_edges UNION ALL SELECT kind, target FROM br_edges) GROUP BY 1) USING (kind)""",
)
def ag_report_graph(f: Facts) -> DataFrame:
    return metrics.report_graph(f["br_edges"])


# commits

_HOT = """SELECT file_path, churn, symbol_count, CAST(floor((churn / CAST(mc AS DOUBLE) * 100 + symbol_count / CAST(ms AS DOUBLE) * 100) / 2 + 0.5) AS BIGINT) AS score
FROM (SELECT *, max(churn) OVER () AS mc, max(symbol_count) OVER () AS ms FROM (
  SELECT f.file_path, count(DISTINCT hash) AS churn, any_value(symbol_count) AS symbol_count FROM br_commits c JOIN br_files f ON c.file_path = f.file_path GROUP BY 1))"""


@query("ag_hotspots", _HOT + " ORDER BY score DESC, churn DESC, file_path LIMIT 20")
def ag_hotspots(f: Facts) -> DataFrame:
    return mining.hotspots(f["br_commits"], f["br_files"])


@query("ag_hotspots_global", _HOT)
def ag_hotspots_global(f: Facts) -> DataFrame:
    return mining.hotspots(f["br_commits"], f["br_files"], top=None)


@query("tk_hotspots", f"SELECT file_path, score, CASE WHEN score >= 50 THEN 'warning' ELSE 'note' END AS level FROM ({_HOT} ORDER BY score DESC, churn DESC, file_path LIMIT 20) WHERE score >= 25")
def tk_hotspots(f: Facts) -> DataFrame:
    top = mining.hotspots(f["br_commits"], f["br_files"]).where("score >= 25")
    return top.select("file_path", "score", F.when(F.col("score") >= 50, "warning").otherwise("note").alias("level"))


@query(
    "wn_norm",
    """SELECT repo, file_path, round(churn / CAST(max(churn) OVER (PARTITION BY repo) AS DOUBLE), 6) AS churn_norm,
    round(symbol_count / CAST(max(symbol_count) OVER (PARTITION BY repo) AS DOUBLE), 6) AS symbol_norm
    FROM (SELECT f.repo, f.file_path, count(DISTINCT hash) AS churn, any_value(symbol_count) AS symbol_count FROM br_commits c JOIN br_files f ON c.file_path = f.file_path GROUP BY 1, 2)""",
)
def wn_norm(f: Facts) -> DataFrame:
    return mining.hotspots_by_repo(f["br_commits"], f["br_files"])


_COUPLED = """SELECT file_a, file_b, co_changes, co_changes / CAST(a.n AS DOUBLE) AS support_a, co_changes / CAST(b.n AS DOUBLE) AS support_b,
  greatest(co_changes / CAST(a.n AS DOUBLE), co_changes / CAST(b.n AS DOUBLE)) AS confidence
FROM (SELECT x.file_path AS file_a, y.file_path AS file_b, count(*) AS co_changes FROM kept x JOIN kept y ON x.hash = y.hash AND x.file_path < y.file_path GROUP BY 1, 2 HAVING count(*) >= 3)
JOIN counts a ON a.file_path = file_a JOIN counts b ON b.file_path = file_b WHERE confidence >= CAST(0.08 AS DOUBLE)"""
_KEPT = {
    "kept": "SELECT hash, file_path FROM br_commits WHERE hash IN (SELECT hash FROM br_commits GROUP BY hash HAVING count(*) <= 50)",
    "counts": "SELECT file_path, count(*) AS n FROM kept GROUP BY 1",
}


@query("ag_coupling", _COUPLED, **_KEPT)
def ag_coupling(f: Facts) -> DataFrame:
    return mining.temporal_coupling(f["br_commits"], min_confidence=0.08)


@query("tk_coupling", f"SELECT file_a, file_b, co_changes, confidence FROM ({_COUPLED}) ORDER BY co_changes DESC, confidence DESC, file_a, file_b LIMIT 20", **_KEPT)
def tk_coupling(f: Facts) -> DataFrame:
    pairs = mining.temporal_coupling(f["br_commits"], min_confidence=0.08).select("file_a", "file_b", "co_changes", "confidence")
    return pairs.orderBy(F.desc("co_changes"), F.desc("confidence"), "file_a", "file_b").limit(20)


@query("ag_pairs", "SELECT x.hash, x.file_path AS file_a, y.file_path AS file_b FROM br_commits x JOIN br_commits y ON x.hash = y.hash AND x.file_path < y.file_path")
def ag_pairs(f: Facts) -> DataFrame:
    return mining.file_pairs(f["br_commits"])


@query("ag_group_commit", "SELECT hash, string_agg(file_path, ',' ORDER BY file_path) AS files FROM br_commits GROUP BY hash")
def ag_group_commit(f: Facts) -> DataFrame:
    return mining.commit_groups(f["br_commits"])


# the edge store


@query("scan_edges_kind", "SELECT source, target, kind, repo FROM br_edges WHERE kind = 'calls' AND repo = 'r1'")
def scan_edges_kind(f: Facts) -> DataFrame:
    return store.edges_by_kind(f["br_edges"], "calls", "r1")


@query("scan_edges_src", "SELECT source, target, kind, repo FROM br_edges WHERE source = 'r1:p1'")
def scan_edges_src(f: Facts) -> DataFrame:
    return store.edges_from(f["br_edges"], "r1:p1")


@query("scan_edges_tgt", "SELECT source, target, kind, repo FROM br_edges WHERE target = 'r1:p1' AND repo <> ''")
def scan_edges_tgt(f: Facts) -> DataFrame:
    return store.edges_to(f["br_edges"], "r1:p1")


@query("flt_repo", "SELECT source, target, kind, repo FROM br_edges WHERE repo = 'r2'")
def flt_repo(f: Facts) -> DataFrame:
    return store.of_repo(f["br_edges"], "r2")


@query("ag_edge_counts", "SELECT coalesce(nullif(repo, 'r4'), 'unknown') AS repo, count(*) AS n FROM br_edges WHERE kind = 'imports' GROUP BY 1")
def ag_edge_counts(f: Facts) -> DataFrame:
    return store.edge_counts(f["br_edges"].withColumn("repo", F.nullif("repo", F.lit("r4"))), "imports")


@query(
    "snk_delete",
    "SELECT source, target, kind, repo FROM br_edges WHERE NOT (repo = 'r1' AND (source IN ('r1:p1', 'r1:p6') OR target IN ('r1:p1', 'r1:p6')))",
)
def snk_delete(f: Facts) -> DataFrame:
    gone = f.spark.createDataFrame([("r1:p1",), ("r1:p6",)], "path string")
    return store.without_files(f["br_edges"], gone, "r1")


@query("scan_kv", "SELECT concat('metrics:', p_brand, ':', CAST(p_partkey AS STRING)) AS key, p_name AS value FROM part WHERE p_brand LIKE 'Brand#1%'")
def scan_kv(f: Facts) -> DataFrame:
    kv = f["part"].select(F.concat_ws(":", F.lit("metrics"), "p_brand", F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("value"))
    return store.by_prefix(kv, "metrics:Brand#1")


@query(
    "snk_kv",
    "SELECT key, value FROM (SELECT p_brand AS key, p_name AS value, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS rn FROM part) WHERE rn = 1",
)
def snk_kv(f: Facts) -> DataFrame:
    return store.last_wins(f["part"].select(F.col("p_brand").alias("key"), F.col("p_name").alias("value"), F.col("p_partkey").alias("ord")), ["key"], "ord").drop("ord")


@query(
    "snk_merge",
    """SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY input DESC) AS rn FROM (
      SELECT n_name AS key, n_regionkey AS value, 0 AS input FROM nation UNION ALL SELECT n_name, n_nationkey, 1 FROM nation WHERE n_nationkey % 2 = 0)) WHERE rn = 1""",
)
def snk_merge(f: Facts) -> DataFrame:
    n = f["nation"]
    return store.merged([n.selectExpr("n_name AS key", "n_regionkey AS value"), n.where("n_nationkey % 2 = 0").selectExpr("n_name AS key", "n_nationkey AS value")], ["key"])


@query("so_union_all", "SELECT source, target FROM br_edges WHERE kind = 'imports' UNION ALL SELECT target, source FROM br_edges WHERE kind = 'calls'")
def so_union_all(f: Facts) -> DataFrame:
    e = f["br_edges"]
    return e.where("kind = 'imports'").select("source", "target").unionByName(e.where("kind = 'calls'").selectExpr("target AS source", "source AS target"))


@query("so_union_distinct", "SELECT source AS node FROM br_edges UNION SELECT target FROM br_edges")
def so_union_distinct(f: Facts) -> DataFrame:
    return f["br_edges"].select(F.explode(F.array("source", "target")).alias("node")).distinct()


@query("so_intersect", "SELECT source AS node FROM br_edges WHERE kind = 'imports' INTERSECT SELECT target FROM br_edges WHERE kind = 'calls'")
def so_intersect(f: Facts) -> DataFrame:
    e = f["br_edges"]
    return e.where("kind = 'imports'").selectExpr("source AS node").intersect(e.where("kind = 'calls'").selectExpr("target AS node"))


@query("so_except", "SELECT source AS node FROM br_edges WHERE kind = 'imports' EXCEPT SELECT target FROM br_edges")
def so_except(f: Facts) -> DataFrame:
    e = f["br_edges"]
    return e.where("kind = 'imports'").selectExpr("source AS node").subtract(e.selectExpr("target AS node"))


@query("gr_dependents", "SELECT DISTINCT source AS node, kind FROM br_edges WHERE target = 'r1:p1'")
def gr_dependents(f: Facts) -> DataFrame:
    return store.edges_to(f["br_edges"], "r1:p1").selectExpr("source AS node", "kind").distinct()


@query("gr_callers", "SELECT source, target, kind, repo FROM br_edges WHERE target IN (SELECT module FROM best)", best="SELECT target AS module FROM br_edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def gr_callers(f: Facts) -> DataFrame:
    e = f["br_edges"]
    return e.join(store.busiest(e, 1).withColumnRenamed("module", "target"), "target", "left_semi").select("source", "target", "kind", "repo")


@query("gr_callees", "SELECT source, target, kind, repo FROM br_edges WHERE source IN (SELECT module FROM best)", best="SELECT target AS module FROM br_edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def gr_callees(f: Facts) -> DataFrame:
    e = f["br_edges"]
    return e.join(store.busiest(e, 1).withColumnRenamed("module", "source"), "source", "left_semi").select("source", "target", "kind", "repo")
