"""Queries over services, flags, packages, path rules, models and configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import correlate, graph, models, rules
from lodestone.plans.registry import Facts, query

_LINKS = """SELECT endpoint, producers, consumers, repos, (producers + consumers) * repos AS criticality, repos >= 2 AND producers + consumers >= 2 AS linchpin, (producers > 0) <> (consumers > 0) AS orphan
FROM (SELECT endpoint, count(DISTINCT repo) FILTER (role = 'producer') AS producers, count(DISTINCT repo) FILTER (role <> 'producer') AS consumers, count(DISTINCT repo) AS repos FROM br_service_calls GROUP BY 1)"""


@query("ag_service_links", _LINKS)
def ag_service_links(f: Facts) -> DataFrame:
    return correlate.service_links(f["br_service_calls"])


@query("ht_orphans", f"SELECT endpoint FROM ({_LINKS}) WHERE orphan")
def ht_orphans(f: Facts) -> DataFrame:
    return correlate.orphaned_services(ag_service_links(f)).select("endpoint")


@query(
    "jn_services",
    """SELECT DISTINCT a.endpoint, a.repo AS producer, b.repo AS consumer FROM br_service_calls a JOIN br_service_calls b ON a.endpoint = b.endpoint AND a.repo <> b.repo
    WHERE a.role = 'producer' AND b.role <> 'producer'""",
)
def jn_services(f: Facts) -> DataFrame:
    return correlate.service_pairs(f["br_service_calls"])


@query(
    "jn_catalog",
    """SELECT c.name, l.endpoint, true AS documented FROM c LEFT JOIN l ON c.name = l.repo
    UNION ALL SELECT repo, endpoint, false FROM l WHERE NOT p AND repo NOT IN (SELECT name FROM c)""",
    c="SELECT * FROM (VALUES ('r0'), ('r1'), ('r2'), ('r9')) v(name)",
    l="SELECT DISTINCT endpoint, repo, role = 'producer' AS p FROM br_service_calls",
)
def jn_catalog(f: Facts) -> DataFrame:
    links = f["br_service_calls"].select("endpoint", "repo", (F.col("role") == "producer").alias("p")).distinct()
    return correlate.catalog_links(f.spark.createDataFrame([("r0",), ("r1",), ("r2",), ("r9",)], "name string"), links)


_CROSS = "SELECT target AS package, substr(source, 1, instr(source, ':') - 1) AS source_repo FROM br_edges WHERE kind = 'imports' AND substr(source, 1, 2) <> substr(target, 1, 2)"


@query("ag_pkg_linchpins", f"SELECT package, count(DISTINCT source_repo) AS importers, count(*) AS edges, count(DISTINCT source_repo) * count(*) AS score FROM ({_CROSS}) GROUP BY 1 HAVING count(DISTINCT source_repo) >= 2")
def ag_pkg_linchpins(f: Facts) -> DataFrame:
    return correlate.package_linchpins(f["br_edges"].where("kind = 'imports' AND substr(source, 1, 2) <> substr(target, 1, 2)").selectExpr("target AS package", "substring_index(source, ':', 1) AS source_repo"))


@query("ag_breaking", "SELECT target, count(DISTINCT substr(source, 1, 2)) AS repos FROM br_edges WHERE substr(source, 1, 2) <> substr(target, 1, 2) GROUP BY 1 HAVING count(DISTINCT substr(source, 1, 2)) >= 3")
def ag_breaking(f: Facts) -> DataFrame:
    return correlate.breaking_targets(f["br_edges"])


@query(
    "jn_shared_flags",
    """SELECT name, count(DISTINCT repo) AS repos, name IN (SELECT x.name FROM br_flags x JOIN br_flags y ON x.name = y.name JOIN p ON p.a = x.repo AND p.b = y.repo) AS coordinated
    FROM br_flags GROUP BY 1 HAVING count(DISTINCT repo) > 1""",
    p="SELECT * FROM (VALUES ('r0', 'r1'), ('r3', 'r2')) v(a, b)",
)
def jn_shared_flags(f: Facts) -> DataFrame:
    return correlate.shared_flags(f["br_flags"], f.spark.createDataFrame([("r0", "r1"), ("r3", "r2")], "a string, b string"))


@query("ag_flag_modules", "SELECT repo, name, count(DISTINCT module) AS modules, count(*) AS locations FROM br_flags GROUP BY 1, 2")
def ag_flag_modules(f: Facts) -> DataFrame:
    return correlate.flag_modules(f["br_flags"])


@query("flt_inventory", "SELECT DISTINCT repo, name FROM br_flags WHERE contains(lower(name), 'k1') AND repo = 'r1'")
def flt_inventory(f: Facts) -> DataFrame:
    return correlate.inventory(f["br_flags"], search="K1", repo="r1").select("repo", "name").distinct()


@query("jn_registry", "SELECT b.repo, b.name, b.module, v.name IS NOT NULL AS is_registry, d AS description FROM br_flags b LEFT JOIN (VALUES ('k1', 'one'), ('k22', 'twice')) v(name, d) ON b.name = v.name")
def jn_registry(f: Facts) -> DataFrame:
    return correlate.enriched(f["br_flags"], f.spark.createDataFrame([(1, "k1", "first"), (3, "k22", "twice"), (2, "k1", "one")], "ord int, name string, description string")).select("repo", "name", "module", "is_registry", "description")


@query(
    "jn_cross_repo",
    "SELECT source, target, repo, substr(target, 1, 2) AS target_repo FROM br_edges WHERE substr(target, 1, 2) IN ('r0', 'r1', 'r2') AND substr(target, 1, 2) <> repo",
)
def jn_cross_repo(f: Facts) -> DataFrame:
    known = f.spark.createDataFrame([("r0",), ("r1",), ("r2",)], "repo string")
    roots = f.spark.createDataFrame([(1, "@org/x", "r3")], "ord int, package string, repo string")
    return correlate.resolved_repos(f["br_edges"], known, roots).select("source", "target", "repo", "target_repo")


@query("jn_export_index", "SELECT * FROM (VALUES ('a', 'p', 'x', 'x.ts', 'x'), ('a', 'p', 'default', 'x.ts', 'x'), ('b', 'p', '*', 'x.ts', 'x'), ('b', 'p', '*', 'index.ts', 'x'), ('b', 'p', '*', 'y.ts', 'y')) v(source, package, imported, path, symbol)")
def jn_export_index(f: Facts) -> DataFrame:
    imports = f.spark.createDataFrame([("a", "p", ["x", "default", "nothing"]), ("b", "p", ["*"])], "source string, package string, names array<string>")
    exports = f.spark.createDataFrame([("p", "x.ts", "x", False, 1), ("p", "index.ts", "x", True, 0), ("p", "y.ts", "y", False, 2)], "package string, path string, symbol string, barrel boolean, ordinal int")
    return correlate.resolved_symbols(imports, exports.withColumn("ordinal", F.when(F.col("barrel"), 9).otherwise(F.col("ordinal"))))


@query("jn_symbol_importers", "SELECT * FROM (VALUES ('r1', 2::BIGINT), ('r2', 1::BIGINT)) v(repo, importers)")
def jn_symbol_importers(f: Facts) -> DataFrame:
    rows = [("r1", "p", ["x"], None), ("r1", "p", ["y"], ["x"]), ("r2", "p", ["x"], []), ("r3", "p", ["x"], ["z"])]
    return correlate.symbol_importers(f.spark.createDataFrame(rows, "repo string, package string, names array<string>, resolved array<string>"), "x", "p")


_PKG = {
    "im": "SELECT source, concat('@p', CAST(CAST(substr(target, 5) AS INT) % 9 AS STRING), '/lib/x') AS target, kind FROM br_edges",
    "pk": "SELECT * FROM (VALUES ('@p1/lib', 'r1', 0), ('@p1/lib', 'r2', 1), ('@p3/lib', 'r3', 2), ('@p4/lib', 'r4', 3)) v(package, repo, ordinal)",
}


def _imports(f: Facts) -> DataFrame:
    return f.sql("SELECT source, concat('@p', CAST(CAST(substr(target, 5) AS INT) % 9 AS STRING), '/lib/x') AS target, kind FROM {br_edges}")


def _packages(f: Facts) -> DataFrame:
    return f.spark.createDataFrame([("@p1/lib", "r1", 0), ("@p1/lib", "r2", 1), ("@p3/lib", "r3", 2), ("@p4/lib", "r4", 3)], "package string, repo string, ordinal int")


@query("jn_registry_entity", "SELECT CASE target WHEN '@p1/lib/x' THEN 'r2' ELSE 'r3' END AS repo, kind, count(*) AS n FROM im WHERE target IN ('@p1/lib/x', '@p3/lib/x') GROUP BY 1, 2", **_PKG)
def jn_registry_entity(f: Facts) -> DataFrame:
    states = f.spark.createDataFrame([("r4", "indexed"), ("r2", "candidate")], "name string, status string")
    return correlate.connections(_imports(f), _packages(f), states)


@query("src_packages", "SELECT * FROM (VALUES ('a', 'r2', 'dev'), ('a', 'r3', 'dependency'), ('r3', 'r2', 'peer')) v(repo, target_repo, kind)")
def src_packages(f: Facts) -> DataFrame:
    rows = [("a", "@p1/lib", "peer"), ("a", "@p1/lib", "dev"), ("a", "@p3/lib", "dependency"), ("r3", "@p1/lib", "peer"), ("r2", "@p1/lib", "dev")]
    return correlate.repo_dependencies(f.spark.createDataFrame(rows, "repo string, package string, kind string"), _packages(f))


@query("jn_vuln_importers", "SELECT DISTINCT '@p1/lib' AS package, source FROM im WHERE kind = 'imports' AND target = '@p1/lib/x'", **_PKG)
def jn_vuln_importers(f: Facts) -> DataFrame:
    return correlate.vulnerable_importers(_imports(f), f.spark.createDataFrame([("@p1/lib",)], "package string"))


@query("jn_advisory", "SELECT * FROM (VALUES ('a', '1.2.3', '^1.0.0'), ('a', '1.2.3', '<1.3 || >=4'), ('b', '0.2.9', '~0.2.1'), ('c', '2.5.0', '1 - 3')) v(package, version, \"range\")")
def jn_advisory(f: Facts) -> DataFrame:
    have = f.spark.createDataFrame([("a", "1.2.3"), ("b", "0.2.9"), ("c", "2.5.0"), ("d", "1.0.0")], "package string, version string")
    rows = [("a", "^1.0.0"), ("a", "<1.3 || >=4"), ("a", "^2"), ("b", "~0.2.1"), ("b", "^0.3.0"), ("c", "1 - 3"), ("c", ">2.5.0")]
    return rules.matched_advisories(have, f.spark.createDataFrame(rows, "package string, range string"))


@query("ht_vuln", "SELECT * FROM (VALUES ('x', 'error', '<1.2'), ('y', 'warning', '>=2'), ('z', 'note', '*')) v(package, level, \"range\")")
def ht_vuln(f: Facts) -> DataFrame:
    reports = ['{"vulnerabilities": {"x": {"name": "x", "severity": "high", "range": "<1.2"}}}', '{"advisories": {"7": {"module_name": "y", "severity": "moderate", "vulnerable_versions": ">=2"}, "8": {"module_name": "z", "severity": "low", "vulnerable_versions": "*"}}}', "{broken"]
    return rules.audit_rows(f.spark.createDataFrame([(r,) for r in reports], "report string"))


@query("jn_reflexion", "SELECT a, b, CASE WHEN h IS NULL THEN 'divergence' WHEN x IS NULL THEN 'absence' ELSE 'convergence' END AS verdict FROM (SELECT *, 1 AS h FROM (VALUES ('r0', 'r1'), ('r1', 'r9')) v(a, b)) FULL JOIN (SELECT DISTINCT substr(source, 1, 2) AS a, substr(target, 1, 2) AS b, 1 AS x FROM br_edges WHERE kind = 'imports' AND substr(source, 1, 2) <> substr(target, 1, 2)) USING (a, b)")
def jn_reflexion(f: Facts) -> DataFrame:
    found = graph.cross_pairs(f["br_edges"]).selectExpr("source_repo AS a", "target_repo AS b")
    return correlate.reflexion(f.spark.createDataFrame([("r0", "r1"), ("r1", "r9")], "a string, b string"), found)


PATHS = "SELECT source, target, kind FROM (SELECT concat('src/', CASE WHEN length(source) % 3 = 0 THEN 'ui' WHEN length(source) % 3 = 1 THEN 'core' ELSE 'data' END, '/', split_part(source, ':', 2), '.ts') AS source, concat('src/', CASE WHEN length(target) % 2 = 0 THEN 'core' ELSE 'data' END, '/', split_part(target, ':', 2), '.ts') AS target, kind FROM br_edges)"


def _paths(f: Facts) -> DataFrame:
    return f.sql(PATHS.replace("FROM br_edges", "FROM {br_edges}"))


@query("jn_service_under", f"SELECT DISTINCT service, target FROM ({PATHS}), (VALUES ('ui', 'src/ui'), ('core', 'src/core')) v(service, root) WHERE starts_with(source, root || '/') AND NOT starts_with(target, root || '/')")
def jn_service_under(f: Facts) -> DataFrame:
    return correlate.under_roots(_paths(f), f.spark.createDataFrame([("ui", "src/ui"), ("core", "src/core")], "name string, root string"))


_LAYER = "CASE WHEN regexp_matches({0}, '^src/data/.*$') THEN 'data' WHEN regexp_matches({0}, '^src/core/[^/]*\\.ts$') THEN 'core' WHEN regexp_matches({0}, '^src/ui/.*$') THEN 'ui' END"


@query(
    "jn_arch_layers",
    f"SELECT source, target, from_layer, to_layer FROM (SELECT *, {_LAYER.format('source')} AS from_layer, {_LAYER.format('target')} AS to_layer FROM ({PATHS}) WHERE kind = 'imports') WHERE from_layer <> to_layer AND NOT (from_layer = 'ui' AND to_layer = 'core')",
)
def jn_arch_layers(f: Facts) -> DataFrame:
    return rules.layer_violations(_paths(f), {"ui": ["src/ui/**"], "core": ["src/core/*.ts"], "data": ["src/data/**"]}, {"ui": ["core"]})


@query("jn_forbidden", f"SELECT source, target FROM ({PATHS}) WHERE kind = 'imports' AND regexp_matches(source, '^src/ui/.*$') AND regexp_matches(target, '^src/data/[^/]*\\.ts$')")
def jn_forbidden(f: Facts) -> DataFrame:
    return rules.forbidden_imports(_paths(f), ["src/ui/**"], ["src/data/*.ts"])


@query("jn_direction", f"SELECT source, target, rule FROM ({PATHS}), (VALUES ('src/core/**', 'src/data/**', '^src/core/.*$', '^src/data/.*$'), ('src/**', 'src/data/p1*', '^src/.*$', '^src/data/p1[^/]*$')) v(a, b, x, y), (SELECT 1), LATERAL (SELECT a || ' -> ' || b AS rule) WHERE kind = 'imports' AND regexp_matches(source, x) AND regexp_matches(target, y)")
def jn_direction(f: Facts) -> DataFrame:
    return rules.denied_directions(_paths(f), [("src/core/**", "src/data/**"), ("src/**", "src/data/p1*")])


@query("flt_glob", f"SELECT DISTINCT source FROM ({PATHS}) WHERE regexp_matches(source, '^src/[^/]*/p1[^/]*\\.ts$')")
def flt_glob(f: Facts) -> DataFrame:
    return _paths(f).where(rules.globbed(F.col("source"), ["src/*/p1*.ts"])).select("source").distinct()


FILES = "SELECT concat(CASE p_size % 6 WHEN 0 THEN 'dist/' WHEN 1 THEN 'src/__tests__/' WHEN 2 THEN 'a/node_modules/' WHEN 3 THEN 'k8s/' ELSE 'src/' END, CASE p_size % 4 WHEN 0 THEN 'index' ELSE replace(p_brand, '#', '') END, CASE p_size % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.yaml' WHEN 2 THEN '.spec.js' WHEN 3 THEN '.py' ELSE '' END) AS path FROM part"


def _files(f: Facts) -> DataFrame:
    return f.sql(FILES.replace("FROM part", "FROM {part}"))


@query("flt_excluded", f"SELECT path FROM ({FILES}) WHERE NOT regexp_matches(path, '(?:^|/)(?:\\.next|build/output|dist|node_modules)/')")
def flt_excluded(f: Facts) -> DataFrame:
    return _files(f).where(~rules.excluded(F.col("path")))


@query("flt_testpath", f"SELECT path FROM ({FILES}) WHERE NOT regexp_matches(path, '(?i)(?:^|/)(?:__tests__|tests?|spec|e2e|fixtures)/|\\.(?:test|spec)\\.[jt]sx?$')")
def flt_testpath(f: Facts) -> DataFrame:
    from lodestone.operators.mining import is_test

    return _files(f).where(~is_test(F.col("path")))


@query("flt_barrel", f"SELECT path FROM ({FILES}) WHERE regexp_matches(path, '(?:^|[/\\\\])index\\.[jt]sx?$')")
def flt_barrel(f: Facts) -> DataFrame:
    from lodestone.operators.metrics import is_barrel

    return _files(f).where(is_barrel(F.col("path")))


FILE_KIND = """CASE WHEN ext IN ('ts', 'tsx', 'mts', 'cts') THEN 'typescript' WHEN ext IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' WHEN ext = 'json' THEN 'json'
  WHEN ext IN ('yml', 'yaml') THEN 'yaml' WHEN ext IN ('md', 'mdx') THEN 'markdown' WHEN path LIKE '%Dockerfile%' OR path LIKE '%dockerfile%' THEN 'dockerfile'
  WHEN lower(path) LIKE '%k8s%' OR lower(path) LIKE '%kubernetes%' THEN 'kubernetes' ELSE 'unknown' END"""


@query("src_classify", f"SELECT path, {FILE_KIND} AS kind FROM (SELECT path, lower(string_split(path, '.')[-1]) AS ext FROM ({FILES})) WHERE NOT regexp_matches(path, '(?:^|/)(?:dist|node_modules)/')")
def src_classify(f: Facts) -> DataFrame:
    return flt_excluded(f).select("path", rules.file_kind(F.col("path")).alias("kind"))


@query("prj_symbolid", "SELECT p_partkey, 'r1' AS repo, concat('a:b/', p_brand) AS path, NULL AS symbol FROM part WHERE p_brand NOT LIKE '%#%' UNION ALL SELECT p_partkey, 'r1', concat('a:b/', split_part(p_brand, '#', 1)), split_part(p_brand, '#', 2) FROM part WHERE p_brand LIKE '%#%'")
def prj_symbolid(f: Facts) -> DataFrame:
    ids = f["part"].select("p_partkey", rules.symbol_id(F.lit("r1"), F.concat(F.lit("a:b/"), "p_brand")).alias("id"))
    return rules.with_parsed_id(ids, "id").drop("id")


SYMBOLS = [("m1", "UserFactory", "class", None), ("m1", "IFactory", "interface", None), ("m1", "getInstance", "method", "Registry"), ("m2", "subscribe", "method", "Bus"), ("m2", "notify", "method", "Bus"), ("m3", "build", "method", "QB"), ("m3", "setA", "method", "QB"), ("m3", "withB", "method", "QB"), ("m4", "execute", "method", "AStrategy"), ("m4", "execute", "method", "BStrategy"), ("m5", "run", "method", "CStrategy")]


@query("ht_patterns", "SELECT * FROM (VALUES ('m1', 'UserFactory', 'factory', 0.7::DOUBLE), ('m1', 'Registry', 'singleton', 0.8::DOUBLE), ('m2', 'Bus', 'observer', 0.75::DOUBLE), ('m3', 'QB', 'builder', 0.75::DOUBLE), ('m4', 'AStrategy', 'strategy', 0.6::DOUBLE), ('m4', 'BStrategy', 'strategy', 0.6::DOUBLE)) v(module, name, pattern, confidence)")
def ht_patterns(f: Facts) -> DataFrame:
    return rules.patterns(f.spark.createDataFrame(SYMBOLS, "module string, name string, kind string, container string"))


@query("ag_conf_stats", "SELECT 0.6::DOUBLE AS lo, 0.8::DOUBLE AS hi, 0.7::DOUBLE AS mean")
def ag_conf_stats(f: Facts) -> DataFrame:
    return ht_patterns(f).agg(F.min("confidence").alias("lo"), F.max("confidence").alias("hi"), F.round(F.avg("confidence"), 2).alias("mean"))


@query("ag_report_patterns", "SELECT * FROM (VALUES ('builder', 1::BIGINT), ('factory', 1::BIGINT), ('observer', 1::BIGINT), ('singleton', 1::BIGINT), ('strategy', 2::BIGINT)) v(pattern, n)")
def ag_report_patterns(f: Facts) -> DataFrame:
    return ht_patterns(f).groupBy("pattern").agg(F.count("*").alias("n"))


@query("ht_nest_role", "SELECT * FROM (VALUES (1, 'module'), (2, 'controller'), (3, NULL)) v(id, role)")
def ht_nest_role(f: Facts) -> DataFrame:
    rows = f.spark.createDataFrame([(1, ["Injectable", "Module"]), (2, ["Controller"]), (3, ["Other"])], "id int, d array<string>")
    return rows.select("id", rules.nest_role(F.col("d")).alias("role"))


_CATCH = "SELECT user_id, event_id, CASE event_id // 12 % 5 WHEN 0 THEN 'logger.error(e)' WHEN 1 THEN 'x = 1' WHEN 2 THEN 'throw e' WHEN 3 THEN 'y = 2' END AS reached FROM events WHERE event_id % 12 = 4"


@query(
    "ht_gaps",
    f"""SELECT concat('fn', user_id) AS function_id, concat('c', event_id) AS node, CASE WHEN reached IS NULL THEN 'fault/silent-failure' ELSE 'fault/unhandled-error-path' END AS rule_id
    FROM ({_CATCH}) WHERE reached IS NULL OR reached IN ('x = 1', 'y = 2')""",
)
def ht_gaps(f: Facts) -> DataFrame:
    """Catch nodes are events; what a catch reaches hangs on its id, every fifth reaches nothing."""
    catches = f["br_nodes"].where("label = 'catch (e)'").withColumn("node", F.concat(F.lit("c"), F.col("event_id").cast("string")))
    label = F.expr("CASE event_id div 12 % 5 WHEN 0 THEN 'logger.error(e)' WHEN 1 THEN 'x = 1' WHEN 2 THEN 'throw e' WHEN 3 THEN 'y = 2' END")
    reach = catches.select("function_id", F.col("node").alias("start"), label.alias("label")).where("label IS NOT NULL")
    return rules.error_gaps(catches.select("function_id", "node"), reach)


def _faults(f: Facts) -> DataFrame:
    return rules.function_faults(f["br_nodes"].select("function_id", "label"))


_FAULTS = {
    "ht_cascade": ("cascading-failure-risk", "count(*) FILTER (k IN (0, 1, 2)) >= 3 AND count(*) FILTER (k = 4) = 0"),
    "ht_timeout": ("timeout-missing", "count(*) FILTER (k = 3) > 0 AND count(*) FILTER (k = 7) = 0"),
    "ht_retry": ("retry-without-backoff", "count(*) FILTER (k = 5) > 0 AND count(*) FILTER (k IN (9, 10)) = 0"),
    "ht_null": ("unchecked-null-return", "count(*) FILTER (k IN (0, 6, 8)) > 0 AND count(*) FILTER (k = 8) = 0"),
    "ht_boundary": ("missing-error-boundary", "count(*) FILTER (k IN (0, 1, 2, 9)) > 0 AND count(*) FILTER (k = 4) = 0"),
}


def _fault(name: str, rule: str, having: str) -> None:
    @query(name, f"SELECT concat('fn', user_id) AS function_id, 'fault/{rule}' AS rule_id FROM (SELECT user_id, event_id % 12 AS k FROM events) GROUP BY user_id HAVING {having}")
    def one(f: Facts) -> DataFrame:
        return _faults(f).where(F.col("rule_id") == f"fault/{rule}")


for _name, (_rule, _having) in _FAULTS.items():
    _fault(_name, _rule, _having)


ARCH = [("shop", "react", "imports", None, None), ("shop", "/api", "service-call", "client", "http"), ("api", "express", "imports", None, None), ("api", "/api", "service-call", "producer", "http"), ("my-lib", "x", "calls", None, None), ("tool", "y", "imports", None, None)]


@query("ag_architecture", "SELECT * FROM (VALUES ('shop', 1::BIGINT, 0::BIGINT, 1::BIGINT, 'frontend'), ('api', 1, 0, 1, 'backend-service'), ('my-lib', 0, 1, 0, 'shared-library'), ('tool', 1, 0, 0, 'unknown')) v(repo, imports, calls, services, role)")
def ag_architecture(f: Facts) -> DataFrame:
    return correlate.architecture(f.spark.createDataFrame(ARCH, "repo string, target string, kind string, role string, protocol string"))


@query(
    "wn_highest_tier",
    "SELECT concat('u', user_id) AS entity_id, e.tier, e.description, e.confidence FROM (SELECT user_id, CAST(length(event_type) % 4 AS INTEGER) AS tier, max(event_type) AS description, round(max(value), 3) AS confidence FROM events GROUP BY 1, 2) e WHERE e.tier = (SELECT max(length(event_type) % 4) FROM events x WHERE x.user_id = e.user_id)",
)
def wn_highest_tier(f: Facts) -> DataFrame:
    """A user's event types stand for an entity's summaries, their names' lengths for tiers."""
    rows = f["events"].groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity_id"), F.expr("length(event_type) % 4").alias("tier"))
    return correlate.highest_tier(rows.agg(F.max("event_type").alias("description"), F.round(F.max("value"), 3).alias("confidence")))


# feature models and configurations

ITEMS = [("a", "flag", "boolean", "m1", [], None, None), ("b", "flag", "boolean", "m1", [], None, None), ("c", "setting", "string", "m2", ["x", "y"], None, None), ("d", "setting", "number", None, [], 1, 9), ("e", "flag", "boolean", "m3", [], None, None)]
CONS = [("requires", ["a", "b"]), ("mutex", ["b", "a"]), ("requires", ["a", "zz"]), ("always", ["e"]), ("implies", ["a", "b", "c"]), ("implies", ["c", "d"])]


def _items(f: Facts) -> DataFrame:
    return f.spark.createDataFrame(ITEMS, "name string, kind string, value_type string, module string, enum_values array<string>, range_min int, range_max int")


def _params(f: Facts) -> DataFrame:
    """Parts as flags and settings."""
    return f["br_params"].withColumn("enum_values", F.when(F.col("choice").isNotNull(), F.array("choice")).otherwise(F.array().cast("array<string>"))).drop("choice")


def _issues(f: Facts) -> DataFrame:
    cons = f["br_constraints"].select("kind", F.array_compact(F.array("a", "b")).alias("flags"))
    return models.model_issues(_params(f), cons, f["br_registry"])


_COUPLED = "SELECT DISTINCT a.name AS a, b.name AS b FROM br_edges e JOIN br_params a ON a.module = e.source JOIN br_params b ON b.module = e.target WHERE a.name <> b.name"


@query(
    "fm_build",
    f"""SELECT 'implies' AS kind, concat(a.name, ',', b.name) AS flags FROM br_params a JOIN br_params b ON a.module = b.module AND a.name < b.name WHERE (SELECT count(*) FROM br_params c WHERE c.module = a.module) <= 10
    UNION ALL SELECT 'requires', concat(a, ',', b) FROM ({_COUPLED})
    UNION ALL SELECT CASE WHEN choice IS NOT NULL THEN 'enum' ELSE 'range' END, name FROM br_params WHERE choice IS NOT NULL OR range_min IS NOT NULL""",
)
def fm_build(f: Facts) -> DataFrame:
    return models.built(_params(f), f["br_edges"]).select("kind", F.array_join("flags", ",").alias("flags"))


@query("jn_constraints_edges", _COUPLED)
def jn_constraints_edges(f: Facts) -> DataFrame:
    return models.required_by_edges(_params(f), f["br_edges"])


_BOTH = "SELECT DISTINCT r.a, r.b FROM br_constraints r JOIN br_constraints x ON r.kind = 'requires' AND x.kind IN ('mutex', 'excludes') AND ((r.a = x.a AND r.b = x.b) OR (r.a = x.b AND r.b = x.a))"
_ISSUES = {
    "fm_dead": ("dead-flag", f"SELECT DISTINCT a AS name FROM ({_BOTH}) WHERE a IN (SELECT name FROM br_params WHERE kind = 'flag')"),
    "fm_always": ("always-on-flag", "SELECT a AS name FROM br_constraints JOIN br_params p ON p.name = a WHERE br_constraints.kind = 'always' AND p.kind = 'flag'"),
    "fm_untested": ("untested-interaction", "SELECT DISTINCT concat(a, ',', b) AS name FROM br_constraints WHERE kind = 'implies'"),
    "fm_unused_reg": ("unused-registry-flag", "SELECT name FROM br_registry EXCEPT SELECT name FROM br_params WHERE kind = 'flag'"),
    "fm_unreg": ("unregistered-flag", "SELECT name FROM br_params WHERE kind = 'flag' EXCEPT SELECT name FROM br_registry"),
    "fm_dead_setting": ("dead-setting", "SELECT name FROM br_params WHERE kind = 'setting' AND module IS NULL"),
    "fm_missing_dep": ("missing-dependency", "SELECT DISTINCT b AS name FROM br_constraints WHERE kind = 'requires' AND b NOT IN (SELECT name FROM br_params)"),
    "fm_conflict": ("conflicting-settings", f"SELECT concat(a, ',', b) AS name FROM ({_BOTH})"),
}


def _issue(name: str, rule: str, found: str) -> None:
    @query(name, f"SELECT 'config/{rule}' AS rule_id, name FROM ({found})")
    def one(f: Facts) -> DataFrame:
        return _issues(f).where(F.col("rule_id") == f"config/{rule}")


for _name, (_rule, _found) in _ISSUES.items():
    _issue(_name, _rule, _found)


@query("ag_interaction", "SELECT * FROM (VALUES ('a', 3::BIGINT, 3::BIGINT), ('b', 3, 2), ('c', 3, 3)) v(name, arity, neighbours)")
def ag_interaction(f: Facts) -> DataFrame:
    return models.interaction_strength(f.spark.createDataFrame(CONS, "kind string, flags array<string>"))


@query("fm_validate", "SELECT * FROM (VALUES (1::BIGINT, 'requires', 'a,b'), (2, 'mutex', 'b,a'), (2, 'enum', 'c'), (3, 'conditional', 'd')) v(config_id, kind, flags)")
def fm_validate(f: Facts) -> DataFrame:
    configs = [(1, "a", "true"), (1, "c", "x"), (2, "a", "true"), (2, "b", "1"), (2, "c", "q"), (3, "c", "y")]
    cons = [("requires", ["a", "b"], None, None, None), ("mutex", ["b", "a"], None, None, None), ("enum", ["c"], ["x", "y"], None, None), ("conditional", ["d"], None, "c", "y")]
    return models.validated(f.spark.createDataFrame(configs, "config_id bigint, name string, value string"), f.spark.createDataFrame(cons, "kind string, flags array<string>, allowed array<string>, when_name string, when_value string"))


@query("fm_domains", "SELECT * FROM (VALUES ('a', 'true'), ('a', 'false'), ('b', 'true'), ('b', 'false'), ('c', 'x'), ('c', 'y'), ('d', '1'), ('d', '9'), ('e', 'true'), ('e', 'false')) v(name, value)")
def fm_domains(f: Facts) -> DataFrame:
    return models.domains(_items(f))


@query("fm_tuples", "SELECT count(*) AS n FROM (VALUES (1), (2), (3), (4), (5)) a(i), (VALUES (1), (2), (3), (4), (5)) b(j), range(4) WHERE i < j")
def fm_tuples(f: Facts) -> DataFrame:
    return models.tuples(fm_domains(f)).agg(F.count("*").alias("n"))


@query("fm_cover")
def fm_cover(f: Facts) -> DataFrame:
    rows = models.covering_array({"a": ["t", "f"], "b": ["t", "f"], "c": ["x", "y", "z"], "d": ["1", "2"]}, 2)
    return f.spark.createDataFrame([tuple(r[k] for k in "abcd") for r in rows], "a string, b string, c string, d string")


@query(
    "ct_level",
    "SELECT field, CASE WHEN g = 0 AND d = 0 THEN 'always' WHEN g = n AND d = n THEN 'never' ELSE 'conditional' END AS level FROM (SELECT p_brand AS field, count(*) AS n, count(*) FILTER (p_size > 25) AS g, count(*) FILTER (p_size > 25) AS d FROM part GROUP BY 1) UNION ALL SELECT concat('size', p_size), CASE WHEN p_size % 3 = 0 THEN 'never' WHEN p_size % 3 = 1 THEN 'always' ELSE 'conditional' END FROM (SELECT DISTINCT p_size FROM part)",
)
def ct_level(f: Facts) -> DataFrame:
    """Brands and sizes as fields, parts as the places that read them."""
    brands = f["part"].selectExpr("p_brand AS field", "p_size > 25 AS guarded", "p_size > 25 AS has_default")
    sizes = f["part"].selectExpr("concat('size', p_size) AS field", "p_size % 3 <> 1 AS guarded", "p_size % 3 = 0 AS has_default")
    return models.requirement_level(brands.unionByName(sizes))


@query("ct_build", "SELECT * FROM (VALUES ('a', 'conditional'), ('a.b', 'conditional'), ('a.b.c', 'conditional'), ('d', 'always'), ('d.e', 'always')) v(field, level)")
def ct_build(f: Facts) -> DataFrame:
    rows = [("a", "conditional"), ("a.b", "always"), ("a.b.c", "always"), ("d", "always"), ("d.e", "always")]
    return models.field_constraints(f.spark.createDataFrame(rows, "field string, level string"))


CONFIGS = [(1, "host", "h"), (1, "port", "80"), (2, "port", "eighty"), (2, "colour", "red")]


@query("ct_validate", "SELECT * FROM (VALUES (2::BIGINT, 'host', 'missing'), (2, 'port', 'type'), (2, 'colour', 'unknown')) v(config_id, field, problem)")
def ct_validate(f: Facts) -> DataFrame:
    fields = f.spark.createDataFrame([("host", "always", "string"), ("port", "always", "number"), ("debug", "conditional", "boolean")], "field string, level string, value_type string")
    return models.config_problems(f.spark.createDataFrame(CONFIGS, "config_id bigint, name string, value string"), fields)


@query("ct_nearest", "SELECT * FROM (VALUES (1::BIGINT, 10::BIGINT, 1::BIGINT), (2, 10, 3)) v(config_id, nearest, distance)")
def ct_nearest(f: Facts) -> DataFrame:
    kind = "config_id bigint, name string, value string"
    return models.nearest_valid(f.spark.createDataFrame(CONFIGS, kind), f.spark.createDataFrame([(10, "host", "h"), (10, "port", "81"), (11, "x", "y")], kind))


@query("ct_cross", "SELECT a.event_type AS entity_a, b.event_type AS entity_b, count(DISTINCT a.user_id) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2")
def ct_cross(f: Facts) -> DataFrame:
    return models.cross_entities(f["events"].selectExpr("user_id AS function", "event_type AS entity"))
