"""Queries over facts that are taken from source text, and over what is built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import diagnostics as dx
from lodestone.operators import extract, graph, models, store
from lodestone.plans.findings import _atdi, _judged
from lodestone.plans.graphs import BEST, walked
from lodestone.plans.registry import Facts, query
from lodestone.plans.relations import PATHS, _paths

CODE = """import { load, save as keep } from './store';
export class OrderService extends Base implements Runner, Closer {
load(); keep(1); other();
axios.get('/api/orders'); router.post("/orders", f); bus.publish('created', x); socket.on('ping', g);
if (flags.fast) { a() } else if (flags.safe) { b() }
if (flags.beta && !flags.login) { throw new Error() }
name: { type: String, required: true }, age: { type: Number }
"""


def _code(f: Facts) -> DataFrame:
    return f.spark.createDataFrame([("src/a.ts", CODE), ("src/empty.ts", ""), ("src/null.ts", None)], "path string, content string")


@query("ht_heritage", "SELECT * FROM (VALUES ('OrderService', 'extends', 'Base'), ('OrderService', 'implements', 'Runner'), ('OrderService', 'implements', 'Closer')) v(name, kind, target)")
def ht_heritage(f: Facts) -> DataFrame:
    return extract.heritage(_code(f)).select("name", "kind", "target")


@query("ht_calls", "SELECT * FROM (VALUES ('load', './store'), ('keep', './store')) v(callee, target)")
def ht_calls(f: Facts) -> DataFrame:
    return extract.calls(_code(f)).select("callee", "target")


@query("ht_topology", "SELECT * FROM (VALUES ('http', 'client', '/api/orders'), ('http', 'producer', '/orders'), ('queue', 'producer', 'created'), ('websocket', 'consumer', 'ping')) v(protocol, role, endpoint)")
def ht_topology(f: Facts) -> DataFrame:
    return extract.topology(_code(f)).select("protocol", "role", "endpoint")


@query("fm_extract", "SELECT * FROM (VALUES ('mutex', 'fast,safe'), ('requires', 'beta,login')) v(kind, flags)")
def fm_extract(f: Facts) -> DataFrame:
    return extract.guards(_code(f)).select("kind", "flags")


@query("ct_schema", "SELECT * FROM (VALUES ('name', 'string', true), ('age', 'number', false)) v(field, value_type, required)")
def ct_schema(f: Facts) -> DataFrame:
    return extract.schema_fields(_code(f)).select("field", "value_type", "required")


@query("ct_domain_sets", "SELECT * FROM (VALUES ('account.limit', 'always'), ('account.name', 'conditional'), ('settings.mail', 'never')) v(field, level)")
def ct_domain_sets(f: Facts) -> DataFrame:
    """Levels of settings' and accounts' fields, by their accesses."""
    rows = [("account.limit", False, False), ("account.name", True, False), ("account.name", False, False), ("settings.mail", True, True)]
    return models.field_constraints(models.requirement_level(f.spark.createDataFrame(rows, "field string, guarded boolean, has_default boolean")))


@query("fm_impossible", "SELECT 'beta,login' AS flags")
def fm_impossible(f: Facts) -> DataFrame:
    """Requirements that a mutex rules out."""
    cons = extract.guards(_code(f)).select("kind", "flags")
    more = f.spark.createDataFrame([("mutex", "login,beta")], "kind string, flags string")
    pair = cons.unionByName(more).select("kind", "flags", F.array_join(F.array_sort(F.split("flags", ",")), ",").alias("k"))
    return pair.where("kind = 'requires'").join(pair.where("kind = 'mutex'").select("k"), "k", "left_semi").select("flags")


@query("src_tsmorph", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'class' ELSE 'function' END AS kind, p_size % 5 = 0 AND p_size % 2 = 0 AS is_abstract FROM part")
def src_tsmorph(f: Facts) -> DataFrame:
    p = f["part"]
    syntactic = p.selectExpr("cast(p_partkey AS string) AS path", "p_name AS name", "'function' AS kind")
    typed = p.where("p_size % 5 = 0").selectExpr("cast(p_partkey AS string) AS path", "p_name AS name", "'class' AS kind", "p_size % 2 = 0 AS is_abstract")
    return extract.typed_symbols(syntactic, typed).select(F.col("path").cast("bigint").alias("p_partkey"), "kind", "is_abstract")


@query("ht_services", "SELECT * FROM (VALUES ('apps/web', 'web', 0.9::DOUBLE), ('packages/ui', 'ui', 0.5::DOUBLE), ('services/pay', 'pay', 0.6::DOUBLE)) v(root, name, confidence)")
def ht_services(f: Facts) -> DataFrame:
    m = f.spark.createDataFrame([("apps/web", "web", True), ("packages/ui", "ui", False)], "root string, name string, entry boolean")
    return extract.inferred_services(m, f.spark.createDataFrame([("apps/web/x.ts",), ("services/pay/y.ts",), ("z.ts",)], "path string"))


@query("ht_catalog", "SELECT 'web' AS name, 2::BIGINT AS operations, 1::BIGINT AS errors")
def ht_catalog(f: Facts) -> DataFrame:
    s = f.spark.createDataFrame([("web", "apps/web")], "name string, root string")
    rows = [("apps/web/a.ts", "getUser"), ("apps/web/a.ts", "createOrder"), ("apps/web/a.ts", "getInstance"), ("apps/web/a.ts", "onError"), ("lib/b.ts", "getX")]
    return extract.service_catalog(s, f.spark.createDataFrame(rows, "path string, method string"))


@query("ht_arch", f"SELECT 'arch/forbidden-import' AS rule_id, source, target FROM ({PATHS}) WHERE kind = 'imports' AND source LIKE 'src/ui/%' AND target LIKE 'src/data/%' UNION ALL SELECT 'arch/dependency-direction', source, target FROM ({PATHS}) WHERE kind = 'imports' AND source LIKE 'src/core/%' AND target LIKE 'src/data/%'")
def ht_arch(f: Facts) -> DataFrame:
    return extract.arch_findings(_paths(f), {"all": ["src/**"]}, {}, (["src/ui/**"], ["src/data/**"]), [("src/core/**", "src/data/**")])


@query("tx_tier1", "SELECT * FROM (VALUES ('getUser', 'Gets user', 0.6::DOUBLE), ('Order', 'Class Order', 0.6::DOUBLE)) v(name, description, confidence)")
def tx_tier1(f: Facts) -> DataFrame:
    s = f.spark.createDataFrame([("getUser", "function"), ("Order", "class")], "name string, kind string")
    return s.select("name", extract.summary(F.col("kind"), F.col("name")).alias("s")).select("name", "s.*")


def _tiers(f: Facts) -> DataFrame:
    one = f["part"].selectExpr("p_partkey AS entity_id", "0.6D AS confidence")
    return extract.better_summary(one, f["part"].where("p_size % 3 = 0").selectExpr("p_partkey AS entity_id", "0.85D AS confidence"))


@query("tx_tier2", "SELECT p_partkey AS entity_id, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS tier, CASE WHEN p_size % 3 = 0 THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END AS confidence, p_size % 3 <> 0 AS escalate FROM part")
def tx_tier2(f: Facts) -> DataFrame:
    return _tiers(f)


@query("tx_tier3", "SELECT p_partkey AS entity_id FROM part WHERE p_size % 3 <> 0 ORDER BY 1 LIMIT 25")
def tx_tier3(f: Facts) -> DataFrame:
    """What a language model would be asked about, within a budget of 25 calls."""
    return _tiers(f).where("escalate").select("entity_id").orderBy("entity_id").limit(25)


@query("tx_docs", "SELECT path, name FROM br_symbols WHERE exported AND (path, name) NOT IN (SELECT path, name FROM br_symbols WHERE length(name) % 2 = 0)")
def tx_docs(f: Facts) -> DataFrame:
    s = f["br_symbols"]
    return extract.documentation_gaps(s, s.where("length(name) % 2 = 0").select("path", "name"))


@query("ht_faulttree", "SELECT * FROM (VALUES ('t', 'or', NULL, 0, 'OR'), ('t', 'and:a', 'or', 0, 'AND'), ('t', 'and:c', 'or', 1, 'AND'), ('t', 'event:a', 'and:a', 0, 'BASIC'), ('t', 'event:b', 'and:a', 1, 'BASIC'), ('t', 'event:c', 'and:c', 0, 'BASIC')) v(tree_id, node_id, parent_id, ordinal, kind)")
def ht_faulttree(f: Facts) -> DataFrame:
    steps = f.spark.createDataFrame([("t", "a", True), ("t", "b", True), ("t", "c", True), ("t", "x", False)], "tree_id string, label string, condition boolean")
    return extract.fault_tree(steps, f.spark.createDataFrame([("t", "a", "b")], "tree_id string, a string, b string")).select("tree_id", "node_id", "parent_id", "ordinal", "kind")


@query("tk_orders", "SELECT node, depth FROM (SELECT node, min(depth) AS depth FROM w GROUP BY 1) ORDER BY depth, node LIMIT 40", best=BEST.format(n=3), **walked("w", "'imports', 'calls'", 2, back=True))
def tk_orders(f: Facts) -> DataFrame:
    seeds = store.busiest(f["br_edges"], 3).withColumnRenamed("module", "node")
    return graph.levels(graph.backward(f["br_edges"]), seeds, 2).orderBy("depth", "node").limit(40)


@query("snk_report")
def snk_report(f: Facts) -> DataFrame:
    """The report's lines."""
    text = extract.report(_atdi(f), dx.prioritized(_judged(f)))
    return f.spark.createDataFrame([(i, line) for i, line in enumerate(text.split("\n"))], "n int, line string")
