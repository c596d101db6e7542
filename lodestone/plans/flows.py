"""Queries over sources, sinks and incremental maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph, rules
from lodestone.operators.diagnostics import fingerprint
from lodestone.operators.tables import shared_folder
from lodestone.plans.registry import Facts, query
from lodestone.sources import readers
from lodestone.streaming import incremental as inc

LOG = ["a" * 40, "", "src/x.ts", "src/y.ts", "b" * 40, "src/x.ts", "c" * 40, "z.ts"]


def _lines(f: Facts) -> DataFrame:
    return f.spark.createDataFrame([("r1", i, line) for i, line in enumerate(LOG)], "repo string, ord int, line string")


@query("src_git_log", "SELECT 'r1' AS repo, repeat(h, 40) AS hash, file_path FROM (VALUES ('a', 'src/x.ts'), ('a', 'src/y.ts'), ('b', 'src/x.ts')) v(h, file_path)")
def src_git_log(f: Facts) -> DataFrame:
    return readers.last_commits(_lines(f), 2)


@query("wn_fill_hash", "SELECT hash, count(*) AS files FROM (SELECT l_orderkey AS hash, l_linenumber FROM lineitem) GROUP BY 1")
def wn_fill_hash(f: Facts) -> DataFrame:
    """Commits and files as log lines: each order's number, then its rows; the hash is carried down to them."""
    rows = f["lineitem"].selectExpr("l_orderkey", "sha1(cast(l_orderkey AS string)) AS h", "concat('f', l_linenumber) AS file")
    rows = rows.unionByName(rows.select("l_orderkey", "h", F.lit(None).cast("string").alias("file")).distinct())
    lines = rows.select(F.lit("r").alias("repo"), F.struct("l_orderkey", F.col("file").isNotNull(), "file").alias("ord"), F.coalesce("file", "h").alias("line"), "l_orderkey", "h")
    filled = readers.git_log(lines.withColumn("repo", F.concat("repo", (F.col("l_orderkey") % 16).cast("string"))))
    keys = rows.select("l_orderkey", "h").distinct()
    return filled.join(keys, F.col("hash") == F.col("h")).groupBy(F.col("l_orderkey").alias("hash")).agg(F.count("*").alias("files"))


_BEFORE = "SELECT p_name || p_partkey AS path, p_size AS content_hash FROM part WHERE p_partkey % 3 <> 0"
_AFTER = "SELECT p_name || p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN 99 ELSE p_size END AS content_hash FROM part WHERE p_partkey % 5 <> 0"


@query("src_git_diff", f"SELECT path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM ({_BEFORE}) b FULL JOIN ({_AFTER}) a USING (path) WHERE b.content_hash IS DISTINCT FROM a.content_hash")
def src_git_diff(f: Facts) -> DataFrame:
    return readers.snapshot_diff(f.sql(_BEFORE.replace("FROM part", "FROM {part}")), f.sql(_AFTER.replace("FROM part", "FROM {part}")))


@query("src_name_status", "SELECT * FROM (VALUES ('a.ts', 'added'), ('b.ts', 'modified'), ('c.ts', 'deleted'), ('d.ts', 'deleted'), ('e.ts', 'added')) v(path, change)")
def src_name_status(f: Facts) -> DataFrame:
    return readers.name_status(f.spark.createDataFrame([("A\ta.ts",), ("M\tb.ts",), ("D\tc.ts",), ("R087\td.ts\te.ts",), ("",)], "line string"))


@query("src_changeset", "SELECT n_name AS repo, n_nationkey AS head, CASE WHEN n_nationkey < 20 THEN n_regionkey END AS previous FROM nation WHERE n_nationkey >= 20 OR n_nationkey <> n_regionkey")
def src_changeset(f: Facts) -> DataFrame:
    n = f["nation"]
    return readers.changed_repos(n.selectExpr("n_name AS repo", "n_nationkey AS head"), n.where("n_nationkey < 20").selectExpr("n_name AS repo", "n_regionkey AS hash"))


SOURCE = """import { a } from './a';
import b from "@/lib/b.js";
const c = require('fs');
export class UserService {}
export async function load() {}
interface Hidden {}
if (process.env.FEATURE_X && process.env.ENABLE_Y) logger.error('failed to load');
<%= settings.mail.host %>
"""


def _source(f: Facts) -> DataFrame:
    return f.spark.createDataFrame([("src/m/x.ts", SOURCE), ("src/m/a.ts", ""), ("src/lib/b.ts", "")], "path string, content string")


@query("src_parse", "SELECT * FROM (VALUES ('UserService', 'class', true), ('load', 'function', true), ('Hidden', 'interface', false)) v(name, kind, exported)")
def src_parse(f: Facts) -> DataFrame:
    return readers.declared_symbols(_source(f)).select("name", "kind", "exported")


@query("ht_imports", "SELECT * FROM (VALUES ('./a', 'src/m/a.ts'), ('@/lib/b.js', 'src/lib/b.ts')) v(target, resolved)")
def ht_imports(f: Facts) -> DataFrame:
    s = _source(f)
    return readers.resolved_imports(readers.import_specifiers(s), s).select("target", "resolved")


@query("ht_flags", "SELECT * FROM (VALUES ('FEATURE_X'), ('ENABLE_Y')) v(name)")
def ht_flags(f: Facts) -> DataFrame:
    return readers.env_flags(_source(f)).select("name")


@query("ht_settings", "SELECT 'mail.host' AS name")
def ht_settings(f: Facts) -> DataFrame:
    return readers.template_settings(_source(f)).select("name")


@query("ht_logs", "SELECT 'error' AS severity, 'failed to load' AS message")
def ht_logs(f: Facts) -> DataFrame:
    return readers.log_statements(_source(f)).select("severity", "message")


@query("src_manifests", "SELECT * FROM (VALUES ('web', 'react', 'dependency'), ('web', 'jest', 'dev')) v(name, package, kind)")
def src_manifests(f: Facts) -> DataFrame:
    rows = [("web/package.json", '{"name": "web", "dependencies": {"react": "18"}, "devDependencies": {"jest": "29"}}'), ("x/package.json", "{")]
    return readers.manifests(f.spark.createDataFrame(rows, "path string, content string")).select("name", "package", "kind")


@query("src_sarif", "SELECT rule_id, level, count(*) AS n FROM br_findings WHERE snapshot = 'current' GROUP BY 1, 2")
def src_sarif(f: Facts) -> DataFrame:
    """Findings through SARIF documents and back."""
    from lodestone.operators.diagnostics import sarif

    return readers.sarif_results(sarif(f["br_findings"].where("snapshot = 'current'"))).groupBy("rule_id", "level").agg(F.count("*").alias("n"))


def _folder(f: Facts) -> str:
    return f"{shared_folder(f.spark)}/flow-{uuid.uuid4().hex}"


@query("snk_export", "SELECT source, target, kind, repo FROM br_edges")
def snk_export(f: Facts) -> DataFrame:
    path = _folder(f)
    readers.exported(f.spark, {"edges": f["br_edges"]}, path)
    return readers.imported(f.spark, path)["edges"]


@query("snk_import", "SELECT '[REDACTED:' || sha256('s' || source)[1:8] || ']' AS source, kind FROM br_edges")
def snk_import(f: Facts) -> DataFrame:
    """An anonymised export, read as plain tables: import refuses it."""
    path = _folder(f)
    readers.exported(f.spark, {"edges": f["br_edges"], "symbols": f["br_symbols"]}, path, salt="s")
    return f.spark.read.parquet(f"{path}/edges").select("source", "kind")


@query("snk_edges", "SELECT kind, repo, count(*) AS n FROM br_edges GROUP BY 1, 2")
def snk_edges(f: Facts) -> DataFrame:
    """Edges appended to a table partitioned by kind and repo."""
    path = _folder(f)
    for kind in ("imports", "calls"):
        f["br_edges"].where(F.col("kind") == kind).repartition("repo").write.mode("append").partitionBy("kind", "repo").parquet(path)
    return f.spark.read.parquet(path).groupBy("kind", "repo").agg(F.count("*").alias("n"))


@query("tk_sample", "SELECT ord, rule_id || '::' || fqn AS fp FROM br_findings ORDER BY md5('7:' || ord), ord LIMIT 50")
def tk_sample(f: Facts) -> DataFrame:
    """A seeded sample of 50 findings."""
    d = f["br_findings"].withColumn("fp", fingerprint(F.col("rule_id"), F.col("fqn")))
    return d.select("ord", "fp").orderBy(F.md5(F.concat(F.lit("7:"), F.col("ord").cast("string"))), "ord").limit(50)


# incremental


@query("st_merge_inv", "SELECT repo, name, module FROM br_flags WHERE repo <> 'r1' UNION ALL SELECT repo, 'k0', module FROM (SELECT DISTINCT repo, module FROM br_flags WHERE repo = 'r1')")
def st_merge_inv(f: Facts) -> DataFrame:
    old = f["br_flags"]
    scanned = old.where("repo = 'r1'").select("repo", "module").distinct()
    return inc.merged_inventory(old, scanned, scanned.select("repo", F.lit("k0").alias("name"), "module"))


@query("st_cleanup", "SELECT source, target, kind, repo FROM br_edges WHERE source NOT IN ('r1:p1', 'r2:p2') AND target NOT IN ('r1:p1', 'r2:p2')")
def st_cleanup(f: Facts) -> DataFrame:
    gone = f.spark.createDataFrame([("r1", "p1"), ("r2", "p2")], "repo string, path string")
    return inc.cleaned({"edges": f["br_edges"]}, gone, {"edges": ("source", "target")})["edges"]


@query("st_affected_only", "SELECT path, name FROM br_symbols WHERE path IN (SELECT source FROM br_edges WHERE target IN (SELECT target FROM br_edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) UNION SELECT node FROM best)", best="SELECT target AS node FROM br_edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3")
def st_affected_only(f: Facts) -> DataFrame:
    from lodestone.operators.store import busiest

    e = f["br_edges"]
    scope = graph.levels(graph.backward(e), busiest(e, 3).withColumnRenamed("module", "node"), 1)
    return inc.limited_to(f["br_symbols"], scope).select("path", "name")


@query("st_recovery", "SELECT * FROM (VALUES ('a', 'heuristics'), ('b', 'structural'), ('c', NULL)) v(repo, phase)")
def st_recovery(f: Facts) -> DataFrame:
    done = [("a", "parse"), ("a", "structural"), ("b", "parse"), ("b", "heuristics"), ("c", "parse"), ("c", "structural"), ("c", "heuristics")]
    return inc.pending_phases(f.spark.createDataFrame(done, "repo string, phase string"), ["parse", "structural", "heuristics"])


def _events(f: Facts) -> DataFrame:
    """events as a stream of files: the table's own, read once."""
    schema = f["events"].schema
    return f.spark.readStream.schema(schema).parquet(f"{f.sf_dir}/events.parquet*")


def _streamed(f: Facts, df: DataFrame, mode: str = "append") -> DataFrame:
    """The whole result of a stream over what is there now."""
    path = _folder(f)
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    else:
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out")
        q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return f.spark.read.schema(df.schema).parquet(f"{path}/out")


_HOURS = "SELECT event_type, count(*) AS windows, CAST(sum(n) AS BIGINT) AS events FROM (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1"


@query("st_windows", _HOURS)
def st_windows(f: Facts) -> DataFrame:
    """Hourly windows, streamed with a watermark, then counted by type."""
    out = _streamed(f, inc.windowed_counts(_events(f)), "complete")
    return out.groupBy("event_type").agg(F.count("*").alias("windows"), F.sum("n").alias("events"))


@query("st_window_cochange", "SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type < b.event_type AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 10 MINUTE")
def st_window_cochange(f: Facts) -> DataFrame:
    return inc.co_changes(f["events"])


@query("st_watch", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def st_watch(f: Facts) -> DataFrame:
    """A watch loop over the events' folder, run until nothing is left."""
    path = _folder(f)
    write = lambda batch, n: batch.select("event_type").write.mode("overwrite").parquet(f"{path}/out/batch={n}")
    inc.watched(f.spark, f"{f.sf_dir}/events.parquet*", f["events"].schema, f"{path}/state", write, every=None).awaitTermination()
    return f.spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "st_baseline",
    """SELECT CASE WHEN c.fp IS NULL THEN 'absent' WHEN o.fp IS NULL THEN 'new' WHEN c.level = o.level AND c.message = o.message THEN 'unchanged' ELSE 'updated' END AS state, count(*) AS n
    FROM (SELECT *, rule_id || '::' || fqn AS fp FROM br_findings WHERE snapshot = 'current') c FULL JOIN (SELECT * FROM (SELECT *, rule_id || '::' || fqn AS fp, row_number() OVER (PARTITION BY rule_id || '::' || fqn ORDER BY ord DESC) AS rn
      FROM br_findings WHERE snapshot = 'baseline') WHERE rn = 1) o ON c.fp = o.fp GROUP BY 1""",
)
def st_baseline(f: Facts) -> DataFrame:
    path = _folder(f)
    d = f["br_findings"].withColumn("fp", fingerprint(F.col("rule_id"), F.col("fqn")))
    d.where("snapshot = 'current'").drop("snapshot").coalesce(1).write.parquet(f"{path}/in")
    base = d.where("snapshot = 'baseline'").drop("snapshot")
    schema = f.spark.read.parquet(f"{path}/in").schema
    inc.watched(f.spark, f"{path}/in", schema, f"{path}/state", inc.baseline_sink(base, f"{path}/out"), every=None).awaitTermination()
    return f.spark.read.parquet(f"{path}/out").groupBy("state").agg(F.count("*").alias("n"))


ACTIONS = [("a", 1, "index"), ("a", 2, "done"), ("a", 3, "ignore"), ("b", 1, "ignore"), ("b", 2, "restore"), ("c", 1, "index"), ("c", 2, "fail"), ("c", 3, "done")]


def _actions(f: Facts) -> DataFrame:
    return f.spark.createDataFrame(ACTIONS, "repo string, ord int, action string")


@query("st_state", "SELECT * FROM (VALUES ('a', 'indexed', 1::BIGINT), ('b', 'candidate', 0), ('c', 'candidate', 1)) v(repo, status, rejected)")
def st_state(f: Facts) -> DataFrame:
    return inc.folded_states(_actions(f))


@query("st_state_stream", "SELECT * FROM (VALUES ('a', 'indexed', 1::BIGINT), ('b', 'candidate', 0), ('c', 'candidate', 1)) v(repo, status, rejected)")
def st_state_stream(f: Facts) -> DataFrame:
    path = _folder(f)
    _actions(f).coalesce(1).write.parquet(f"{path}/in")
    stream = f.spark.readStream.schema("repo string, ord int, action string").parquet(f"{path}/in")
    return _streamed(f, inc.streamed_states(stream), "update")


@query("ag_repo_states", "SELECT * FROM (VALUES ('candidate', 2::BIGINT), ('ignored', 0), ('indexed', 1), ('indexing', 0)) v(status, n)")
def ag_repo_states(f: Facts) -> DataFrame:
    return inc.state_summary(inc.folded_states(_actions(f)))


@query("src_files", "SELECT * FROM (VALUES ('a.ts', 'typescript'), ('Dockerfile', 'dockerfile'), ('k8s/x.yml', 'yaml'), ('k8s/configmap', 'kubernetes')) v(path, kind)")
def src_files(f: Facts) -> DataFrame:
    return f.spark.createDataFrame([("a.ts",), ("Dockerfile",), ("k8s/x.yml",), ("k8s/configmap",)], "path string").select("path", rules.file_kind(F.col("path")).alias("kind"))
