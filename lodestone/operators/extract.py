"""Facts and summaries from source text by regular expression, and what is built on them.

A parser's facts can always be given instead: these operators only need the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators import rules
from lodestone.operators.text import conjugated, purpose


def _all(files: DataFrame, pattern: str, *names: str) -> DataFrame:
    """(path, *names): the groups of every match."""
    groups = [F.regexp_extract_all("content", F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    return files.select("path", F.explode(F.arrays_zip(*groups)).alias("m")).select("path", "m.*")


def heritage(files: DataFrame) -> DataFrame:
    """(path, name, kind, target): what classes and interfaces extend and implement."""
    d = _all(files, r"\b(?:class|interface)\s+(\w+)(?:<[^>{]*>)?(?:\s+extends\s+([\w., ]+?))?(?:\s+implements\s+([\w., ]+?))?\s*\{", "name", "ext", "imp")
    rows = lambda c, kind: d.select("path", "name", F.lit(kind).alias("kind"), F.explode(F.split(c, r"\s*,\s*")).alias("target"))
    return rows("ext", "extends").unionByName(rows("imp", "implements")).where("target <> ''")


def calls(files: DataFrame) -> DataFrame:
    """(path, callee, target): calls of imported names, with the module that the name comes from."""
    imported = _all(files, r"""import\s*\{([^}]*)\}\s*from\s*["']([^"']+)["']""", "names", "target")
    imported = imported.select("path", "target", F.explode(F.split(F.trim("names"), r"\s*,\s*")).alias("name")).where("name <> ''")
    imported = imported.select("path", "target", F.trim(F.element_at(F.split("name", r"\s+as\s+"), -1)).alias("callee"))
    called = _all(files, r"(?<![\w.])(\w+)\s*\(", "callee").distinct()
    return called.join(imported, ["path", "callee"]).select("path", "callee", "target")


def topology(files: DataFrame) -> DataFrame:
    """(path, protocol, role, endpoint) of HTTP clients and routes, queues and sockets."""
    kinds = [
        ("http", "client", r"""\b(?:axios|fetch|http)(?:\.(?:delete|get|patch|post|put))?\(\s*["'`]([^"'`]+)"""),
        ("http", "producer", r"""\b(?:app|router)\.(?:delete|get|patch|post|put)\(\s*["'`]([^"'`]+)"""),
        ("queue", "producer", r"""\.(?:publish|sendToQueue)\(\s*["'`]([^"'`]+)"""),
        ("queue", "consumer", r"""\.(?:consume|process|subscribe)\(\s*["'`]([^"'`]+)"""),
        ("websocket", "producer", r"""\b(?:io|socket|ws)\.emit\(\s*["'`]([^"'`]+)"""),
        ("websocket", "consumer", r"""\b(?:io|socket|ws)\.on\(\s*["'`]([^"'`]+)"""),
    ]
    out = None
    for protocol, role, pattern in kinds:
        rows = _all(files, pattern, "endpoint").select("path", F.lit(protocol).alias("protocol"), F.lit(role).alias("role"), "endpoint")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def guards(files: DataFrame) -> DataFrame:
    """(path, kind, flags): if-chains and nested guards of flags, as mutex and requires constraints."""
    mutex = _all(files, r"if\s*\(\s*flags\.(\w+)\s*\)\s*\{[^}]*\}\s*else\s+if\s*\(\s*flags\.(\w+)\s*\)", "a", "b").withColumn("kind", F.lit("mutex"))
    needs = _all(files, r"if\s*\(\s*flags\.(\w+)\s*&&\s*!\s*flags\.(\w+)\s*\)\s*\{?\s*throw", "a", "b").withColumn("kind", F.lit("requires"))
    return mutex.unionByName(needs).select("path", "kind", F.concat_ws(",", "a", "b").alias("flags"))


def schema_fields(files: DataFrame) -> DataFrame:
    """(path, field, value_type, required) of schema literals such as `name: { type: String, required: true }`."""
    d = _all(files, r"(\w+)\s*:\s*\{\s*type\s*:\s*(\w+)((?:\s*,\s*\w+\s*:\s*[^,{}]+)*)\s*,?\s*\}", "field", "value_type", "rest")
    return d.select("path", "field", F.lower("value_type").alias("value_type"), F.col("rest").rlike(r"required\s*:\s*true").alias("required"))


def typed_symbols(syntactic: DataFrame, typed: DataFrame) -> DataFrame:
    """(path, name, kind, is_abstract): the typed extraction's rows override the syntactic ones'."""
    j = syntactic.join(typed.select("path", "name", F.col("kind").alias("k"), F.col("is_abstract").alias("t")), ["path", "name"], "left")
    return j.select("path", "name", F.coalesce("k", "kind").alias("kind"), F.coalesce("t", F.lit(False)).alias("is_abstract"))


def inferred_services(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(root, name, confidence): folders with a manifest, .9 with an entry point and .5 without; else by folder names, .6."""
    from_manifest = manifests.select("root", "name", F.when(F.col("entry"), 0.9).otherwise(0.5).alias("confidence"))
    folder = F.regexp_extract("path", r"^((?:apps|packages|services)/[^/]+)/", 1)
    rest = files.select(folder.alias("root")).where("root <> ''").distinct().join(manifests.select("root"), "root", "left_anti")
    return from_manifest.unionByName(rest.select("root", F.substring_index("root", "/", -1).alias("name"), F.lit(0.6).alias("confidence")))


def service_catalog(services: DataFrame, methods: DataFrame) -> DataFrame:
    """(name, operations, errors): each service's methods with a telling verb, and its error handlers."""
    joined = methods.join(services.withColumnRenamed("name", "service"), F.col("path").startswith(F.concat("root", F.lit("/"))))
    verb = purpose(F.col("method")).getField("verb")
    api = verb.isin("add", "create", "delete", "fetch", "find", "get", "list", "process", "remove", "send", "set", "update") & ~F.col("method").rlike("^(?:getInstance|setUp)$")
    return joined.groupBy(F.col("service").alias("name")).agg(F.count_if(F.coalesce(api, F.lit(False))).alias("operations"), F.count_if(F.lower("method").rlike("error|fail")).alias("errors"))


def arch_findings(edges: DataFrame, layers: dict, allowed: dict, forbidden: tuple, denied: list) -> DataFrame:
    """(rule_id, source, target): findings of all architecture rules."""
    a = rules.layer_violations(edges, layers, allowed).select(F.lit("arch/layer-violation").alias("rule_id"), "source", "target")
    b = rules.forbidden_imports(edges, *forbidden).select(F.lit("arch/forbidden-import").alias("rule_id"), "source", "target")
    c = rules.denied_directions(edges, denied).select(F.lit("arch/dependency-direction").alias("rule_id"), "source", "target")
    return a.unionByName(b).unionByName(c)


def summary(kind: Column, name: Column) -> Column:
    """A template's description of a symbol; confidence .6."""
    p = purpose(name)
    done = F.concat_ws(" ", F.initcap(conjugated(p.getField("verb"))), p.getField("object"))
    return F.struct(F.when((kind == "function") & p.isNotNull(), done).otherwise(F.concat(F.initcap(kind), F.lit(" "), name)).alias("description"), F.lit(0.6).alias("confidence"))


def better_summary(tier1: DataFrame, purposes: DataFrame) -> DataFrame:
    """(entity_id, tier, confidence, escalate): the naming heuristic's where it is surer; below .7 a model is worth asking."""
    j = tier1.join(purposes.select("entity_id", F.col("confidence").alias("c2")), "entity_id", "left")
    second = F.coalesce(F.col("c2") > F.col("confidence"), F.lit(False))
    best = F.greatest("confidence", F.coalesce("c2", F.lit(0.0)))
    return j.select("entity_id", F.when(second, 2).otherwise(1).alias("tier"), best.alias("confidence"), (best < 0.7).alias("escalate"))


def documentation_gaps(symbols: DataFrame, documented: DataFrame) -> DataFrame:
    """Exported symbols that no document describes."""
    return symbols.where("exported").join(documented, ["path", "name"], "left_anti").select("path", "name")


def fault_tree(steps: DataFrame, links: DataFrame) -> DataFrame:
    """(tree_id, node_id, parent_id, ordinal, kind, label): a tree as rows.

    steps: (tree_id, label, condition) of a trace; links: (tree_id, a, b), its control-flow edges between labels. Conditions of
    which one reaches the other, and what this joins step by step, form an AND group below an OR; the root is the trace's
    failure. A group is named by its least label.
    """
    key = lambda c: F.concat_ws("\0", "tree_id", c)
    conditions = steps.where("condition").select("tree_id", "label", key("label").alias("node")).distinct()
    flow = links.select(key("a").alias("a"), key("b").alias("b"))
    seeds = conditions.select(F.col("node").alias("origin"), "node")
    reached = graph.levels(flow, seeds, keys=("origin",)).join(conditions.select("node"), "node", "left_semi")
    group = graph.components(reached.select(F.col("origin").alias("source"), F.col("node").alias("target")))
    s = conditions.join(group, "node").select("tree_id", "label", F.substring_index("component", "\0", -1).alias("g"))
    root = steps.select("tree_id").distinct().select("tree_id", F.lit("or").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("OR").alias("kind"), F.lit("failure").alias("label"))
    group = s.select("tree_id", F.concat(F.lit("and:"), "g").alias("node_id"), F.lit("or").alias("parent_id"), F.lit("AND").alias("kind"), F.col("g").alias("label")).distinct()
    leaf = s.select("tree_id", F.concat(F.lit("event:"), "label").alias("node_id"), F.concat(F.lit("and:"), "g").alias("parent_id"), F.lit("BASIC").alias("kind"), "label")
    w = Window.partitionBy("tree_id", "parent_id").orderBy("node_id")
    return root.unionByName(group).unionByName(leaf).withColumn("ordinal", F.row_number().over(w) - 1)



def report(scores: DataFrame, top: DataFrame, limit: int = 20) -> str:
    """Markdown of the repos' scores and the rules to fix first; both are small tables, one row a repo and a rule."""
    lines = ["| repo | score |", "|---|---|"] + [f"| {r.repo} | {r.score} |" for r in scores.orderBy("repo").collect()]
    lines += ["", "| rule | findings | tier |", "|---|---|---|"]
    return "\n".join(lines + [f"| {r.rule_id} | {r.n} | {r.tier} |" for r in top.orderBy(F.desc("score"), "rule_id").limit(limit).collect()])
