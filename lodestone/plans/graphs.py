"""Queries over the dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph, store
from lodestone.operators.tables import written
from lodestone.plans.registry import Facts, query

BEST = "SELECT target AS node FROM br_edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {n}"


def _seeds(f: Facts, n: int = 3) -> DataFrame:
    return store.busiest(f["br_edges"], n).withColumnRenamed("module", "node")


def walk(kinds: str, depth: int | None, seeds: str = "SELECT node FROM best", back: bool = False, edges: str = "br_edges") -> str:
    """A recursive CTE: nodes with their least depth."""
    a, b = ("target", "source") if back else ("source", "target")
    if depth is None:
        return f"SELECT node FROM ({seeds}) UNION SELECT {b} FROM self JOIN {edges} ON {a} = node WHERE kind IN ({kinds})"
    return f"SELECT node, CAST(0 AS BIGINT) AS depth FROM ({seeds}) UNION SELECT {b}, depth + 1 FROM self JOIN {edges} ON {a} = node WHERE depth < {depth} AND kind IN ({kinds})"


def walked(name: str, *args, **kw) -> dict[str, str]:
    return {name: walk(*args, **kw).replace("self", name)}


ANY = "'imports', 'calls'"


@query("gr_bfs", "SELECT DISTINCT source, target, kind FROM br_edges WHERE source IN (SELECT node FROM w)", best=BEST.format(n=3), **walked("w", ANY, 3))
def gr_bfs(f: Facts) -> DataFrame:
    return graph.bfs(f["br_edges"], _seeds(f), 3)


@query("jn_bfs_step", "SELECT DISTINCT target AS node FROM br_edges WHERE source IN (SELECT node FROM best)", best=BEST.format(n=3))
def jn_bfs_step(f: Facts) -> DataFrame:
    return f["br_edges"].join(F.broadcast(_seeds(f).withColumnRenamed("node", "source")), "source").select(F.col("target").alias("node")).distinct()  # 3 rows


@query("gr_dependency", "SELECT source AS node FROM br_edges WHERE source IN (SELECT node FROM w) UNION SELECT target FROM br_edges WHERE source IN (SELECT node FROM w)", best=BEST.format(n=1), **walked("w", ANY, 3))
def gr_dependency(f: Facts) -> DataFrame:
    return graph.bfs(f["br_edges"], _seeds(f, 1), 3).select(F.explode(F.array("source", "target")).alias("node")).distinct()


@query(
    "gr_deps_both",
    """SELECT 'dependency' AS direction, node, min(depth) AS depth FROM d GROUP BY 2 HAVING min(depth) > 0
    UNION ALL SELECT 'dependent', node, min(depth) FROM u GROUP BY 2 HAVING min(depth) > 0""",
    best=BEST.format(n=1),
    **walked("d", "'imports'", 10),
    **walked("u", "'imports'", 10, back=True),
)
def gr_deps_both(f: Facts) -> DataFrame:
    return graph.dependencies_and_dependents(f["br_edges"], _seeds(f, 1), 10)


@query("gr_transitive", "SELECT node, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0", best=BEST.format(n=3), **walked("w", "'calls'", 10))
def gr_transitive(f: Facts) -> DataFrame:
    return graph.transitive(f["br_edges"].where("kind = 'calls'"), _seeds(f), 10)


VIA = """SELECT m.node, m.depth, CASE WHEN count(DISTINCT e.kind) = 2 THEN 'both' ELSE min(e.kind) END AS via
FROM (SELECT node, min(depth) AS depth FROM w GROUP BY 1) m JOIN br_edges e ON e.source = m.node
JOIN (SELECT node, min(depth) AS depth FROM w GROUP BY 1) t ON e.target = t.node WHERE m.depth > 0 AND t.depth < 5 GROUP BY 1, 2"""


@query("gr_blast", VIA, best=BEST.format(n=3), **walked("w", ANY, 5, back=True))
def gr_blast(f: Facts) -> DataFrame:
    return graph.blast_radius(f["br_edges"], _seeds(f))


CHANGED = "SELECT concat('r', CAST(p_partkey % 5 AS STRING), ':p', CAST(p_partkey AS STRING)) AS node FROM part WHERE p_brand = 'Brand#11' AND p_size <= 10"


def _parts(f: Facts, where: str) -> DataFrame:
    return f["part"].where(where).select(F.concat(F.lit("r"), (F.col("p_partkey") % 5).cast("string"), F.lit(":p"), F.col("p_partkey").cast("string")).alias("node"))


@query("gr_affected", "SELECT node, min(depth) AS depth FROM w GROUP BY 1", best=CHANGED, **walked("w", ANY, 5, back=True))
def gr_affected(f: Facts) -> DataFrame:
    """Changed files and what they affect."""
    changed = _parts(f, "p_brand = 'Brand#11' AND p_size <= 10")
    return graph.levels(graph.backward(f["br_edges"]), changed, 5)


@query("gr_flag_impact", VIA, best="SELECT concat('r', CAST(p_partkey % 5 AS STRING), ':p', CAST(p_partkey AS STRING)) AS node FROM part WHERE p_size = 7", **walked("w", ANY, 5, back=True))
def gr_flag_impact(f: Facts) -> DataFrame:
    """The blast radius of the modules that use one flag."""
    return graph.blast_radius(f["br_edges"], _parts(f, "p_size = 7"))


@query(
    "gr_blast_seed",
    """SELECT DISTINCT CASE WHEN EXISTS (SELECT 1 FROM br_edges e WHERE e.target = x.node) THEN node
      ELSE concat('r', CAST(k % 5 AS STRING), ':p', CAST(k AS STRING)) END AS node
    FROM (SELECT concat('r', CAST(p_partkey % 5 AS STRING), ':p', CAST(p_partkey AS STRING)) AS node, CAST(floor(p_partkey / 2) AS BIGINT) AS k FROM part WHERE p_size = 9) x""",
)
def gr_blast_seed(f: Facts) -> DataFrame:
    hits = f["part"].where("p_size = 9").selectExpr(
        "concat('r', p_partkey % 5, ':p', p_partkey) AS node", "concat('r', floor(p_partkey / 2) % 5, ':p', floor(p_partkey / 2), '#Main') AS hit"
    )
    return graph.resolved_seeds(f["br_edges"], hits.select("node"), hits)


RANKS = {
    "im": "SELECT source, target FROM br_edges WHERE kind = 'imports'",
    "od": "SELECT source, count(*) AS k FROM im GROUP BY 1",
    "nd": "SELECT source AS node FROM im UNION SELECT target FROM im",
    "pr0": "SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nd) AS score FROM nd",
} | {
    f"pr{i}": f"""SELECT nd.node, 0.15::DOUBLE / (SELECT count(*) FROM nd) + 0.85::DOUBLE * (coalesce(g.s, 0) + coalesce((SELECT sum(score) FROM pr{i - 1} WHERE node NOT IN (SELECT source FROM od)), 0) / (SELECT count(*) FROM nd)) AS score
    FROM nd LEFT JOIN (SELECT target, sum(score / k) AS s FROM im JOIN od USING (source) JOIN pr{i - 1} ON node = source GROUP BY 1) g ON g.target = nd.node"""
    for i in range(1, 9)
}


def _ranks(f: Facts) -> DataFrame:
    return graph.pagerank(f["br_edges"], iterations=8, tolerance=None)


@query("gr_pagerank", "SELECT node, round(score, 6) AS score FROM pr8", **RANKS)
def gr_pagerank(f: Facts) -> DataFrame:
    return _ranks(f).select("node", F.round("score", 6).alias("score"))


@query("tk_pagerank", "SELECT node, round(score, 6) AS score FROM pr8 WHERE score > 0.1::DOUBLE * (SELECT max(score) FROM pr8) ORDER BY pr8.score DESC, node LIMIT 10", **RANKS)
def tk_pagerank(f: Facts) -> DataFrame:
    return graph.top_ranked(_ranks(f)).select("node", F.round("score", 6).alias("score"))


@query("wn_rank_pagerank", "SELECT node, row_number() OVER (ORDER BY score DESC, node) AS rank FROM (SELECT node, round(score, 9) AS score FROM pr8 ORDER BY 2 DESC, 1 LIMIT 100)", **RANKS)
def wn_rank_pagerank(f: Facts) -> DataFrame:
    """Ranks of the first page of 100."""
    best = _ranks(f).select("node", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "node").limit(100)
    return store.rank(best, "score", "node").select("node", "rank")


@query(
    "tk_highrisk",
    "SELECT node, round(s, 6) AS score FROM (SELECT node, round(score, 9) AS s FROM pr8 WHERE node IN (SELECT node FROM w) ORDER BY 2 DESC, 1 LIMIT 10)",
    best=CHANGED,
    **walked("w", ANY, 5, back=True),
    **RANKS,
)
def tk_highrisk(f: Facts) -> DataFrame:
    """The best-ranked of the affected files."""
    ranked = _ranks(f).select("node", F.round("score", 9).alias("s"))
    return ranked.join(gr_affected(f).select("node"), "node", "left_semi").orderBy(F.desc("s"), "node").limit(10).select("node", F.round("s", 6).alias("score"))


CLOSED = {"cl": "SELECT source AS a, target AS b FROM br_edges WHERE kind = 'imports' UNION SELECT a, target FROM cl JOIN br_edges ON source = b WHERE kind = 'imports'"}


@query(
    "gr_reach",
    """SELECT node, coalesce(n, 0) AS reach FROM (SELECT source AS node FROM br_edges WHERE kind = 'imports' UNION SELECT target FROM br_edges WHERE kind = 'imports')
    LEFT JOIN (SELECT b, count(*) AS n FROM cl WHERE a <> b GROUP BY 1) ON b = node""",
    **CLOSED,
)
def gr_reach(f: Facts) -> DataFrame:
    return graph.reach_counts(f["br_edges"])


@query("gr_scc", "SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM cl x JOIN cl y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1", **CLOSED)
def gr_scc(f: Facts) -> DataFrame:
    return graph.strong_components(f["br_edges"].where("kind = 'imports'"))


@query("gr_cycles")
def gr_cycles(f: Facts) -> DataFrame:
    return graph.import_cycles(f["br_edges"]).select("repo", F.array_join("cycle", ">").alias("cycle"))


_CYCLES = [(["r1:a.ts", "r1:index.ts", "r1:a.ts"],), (["r1:a.ts", "r1:b.ts", "r1:a.ts"],), (["r2:lib/index.js", "r2:x.js", "r2:lib/index.js"],)]


@query("gr_barrel", "SELECT cycle, regexp_matches(cycle, '(^|[/:])index\\.[jt]sx?(>|$)') AND cycle NOT LIKE 'r1:%' AS barrel FROM (VALUES ('r1:a.ts>r1:index.ts>r1:a.ts'), ('r1:a.ts>r1:b.ts>r1:a.ts'), ('r2:lib/index.js>r2:x.js>r2:lib/index.js')) v(cycle)")
def gr_barrel(f: Facts) -> DataFrame:
    """A file named index is a barrel after a path separator or alone; an id's colon is none."""
    return graph.barrel_mediated(f.spark.createDataFrame(_CYCLES, "cycle array<string>")).select(F.array_join("cycle", ">").alias("cycle"), "barrel")


@query("gr_barrel_expand", "SELECT DISTINCT node FROM w", best=BEST.format(n=2), **walked("w", "'imports'", 5, back=True))
def gr_barrel_expand(f: Facts) -> DataFrame:
    return graph.barrel_expansion(f["br_edges"].where("kind = 'imports'"), _seeds(f, 2))


@query("gr_unionfind")
def gr_unionfind(f: Facts) -> DataFrame:
    """Suppliers and parts that line items join; a recursive query over the whole table is too slow, so there is no SQL."""
    links = f["lineitem"].selectExpr("concat('s', l_suppkey) AS source", "concat('p', l_partkey) AS target")
    return graph.components(links)


REPOS = {"rp": "SELECT DISTINCT substr(source, 1, instr(source, ':') - 1) AS a, substr(target, 1, instr(target, ':') - 1) AS b FROM br_edges WHERE kind = 'imports' AND substr(source, 1, instr(source, ':') - 1) <> substr(target, 1, instr(target, ':') - 1)"}


def _repos(f: Facts) -> DataFrame:
    """Repo pairs of imports from one repo to another."""
    return graph.cross_pairs(f["br_edges"]).select(F.col("source_repo").alias("a"), F.col("target_repo").alias("b"))


_PATHS = {"sp": "SELECT a AS start, [a, b] AS path FROM rp UNION ALL SELECT start, list_append(path, b) FROM sp JOIN rp ON a = path[-1] WHERE NOT list_contains(path, b)"}


@query("gr_paths", "SELECT array_to_string(path, '>') AS path FROM sp WHERE start = 'r0' AND path[-1] = 'r3' AND len(path) = (SELECT min(len(path)) FROM sp WHERE start = 'r0' AND path[-1] = 'r3')", **REPOS, **_PATHS)
def gr_paths(f: Facts) -> DataFrame:
    return graph.shortest_paths(_repos(f), "r0", "r3")


@query("gr_critical", "SELECT start, CAST(len(path) AS BIGINT) AS nodes, min(array_to_string(path, '>')) AS path FROM (SELECT *, max(len(path)) OVER (PARTITION BY start) AS longest FROM sp) WHERE len(path) = longest AND longest >= 4 GROUP BY 1, 2", **REPOS, **_PATHS)
def gr_critical(f: Facts) -> DataFrame:
    return graph.critical_paths(_repos(f))


_PAIRS = "SELECT substr(source, 1, instr(source, ':') - 1) AS source_repo, substr(target, 1, instr(target, ':') - 1) AS target_repo, count(*) AS n FROM br_edges WHERE kind = 'imports' AND substr(source, 1, 2) <> substr(target, 1, 2) GROUP BY 1, 2"


@query("gr_cross_graph", f"SELECT source_repo AS repo, count(*) AS downstream, CAST(sum(n) AS BIGINT) AS edges FROM ({_PAIRS}) GROUP BY 1")
def gr_cross_graph(f: Facts) -> DataFrame:
    return graph.cross_pairs(f["br_edges"]).groupBy(F.col("source_repo").alias("repo")).agg(F.count("*").alias("downstream"), F.sum("n").alias("edges"))


@query("ag_cross_repo_pairs", _PAIRS)
def ag_cross_repo_pairs(f: Facts) -> DataFrame:
    return graph.cross_pairs(f["br_edges"])


_IMPACT = {"best": "SELECT node FROM (" + BEST.format(n=5) + ")"}


@query("gr_impact", "SELECT substr(node, 1, instr(node, ':') - 1) AS repo, count(*) AS modules FROM w GROUP BY 1", **_IMPACT, **walked("w", ANY, None, back=True))
def gr_impact(f: Facts) -> DataFrame:
    """Everything that changed files reach against the edges, in any repo."""
    e = written(f["br_edges"].select("source", "target", "kind"))  # read twice; the seeds count an edge for each kind
    reached = graph.levels(graph.backward(e), store.busiest(e, 5).withColumnRenamed("module", "node"))
    return reached.groupBy(F.substring_index("node", ":", 1).alias("repo")).agg(F.count("*").alias("modules"))


@query("gr_blast_cross", "SELECT node, min(depth) AS depth FROM w WHERE NOT starts_with(node, 'r0:') GROUP BY 1 HAVING min(depth) > 0", best="SELECT DISTINCT target AS node FROM br_edges WHERE target LIKE 'r0:%' AND kind = 'imports'", **walked("w", ANY, 3, back=True))
def gr_blast_cross(f: Facts) -> DataFrame:
    """What depends on one repo's imported files from other repos."""
    seeds = f["br_edges"].where("startswith(target, 'r0:') AND kind = 'imports'").select(F.col("target").alias("node"))
    return graph.levels(graph.backward(f["br_edges"]), seeds, 3).where("depth > 0 AND NOT startswith(node, 'r0:')")


@query(
    "gr_vuln_reach",
    "SELECT advisory, node, min(depth) AS depth FROM v GROUP BY 1, 2",
    adv=BEST.format(n=4).replace("AS node", "AS advisory"),
    v="""SELECT advisory, source AS node, CAST(0 AS BIGINT) AS depth FROM adv JOIN br_edges ON target = advisory
    UNION SELECT advisory, source, depth + 1 FROM v JOIN br_edges ON target = node WHERE depth < 10""",
)
def gr_vuln_reach(f: Facts) -> DataFrame:
    """Per advisory: its direct importers and what depends on them, with the least depth."""
    e = f["br_edges"]
    seeds = e.join(F.broadcast(_seeds(f, 4).withColumnRenamed("node", "target")), "target").select(F.col("target").alias("advisory"), F.col("source").alias("node"))  # 4 rows
    return graph.levels(graph.backward(e), seeds, 10, keys=("advisory",))


CFG = "(VALUES ('f1','a','b'),('f1','b','c'),('f1','c','d'),('f1','x','d'),('f2','a','b'),('f2','b','a'),('f2','q','z')) v(function_id, a, b)"


@query("gr_cfg_back", "SELECT function_id, node FROM w", w=f"SELECT * FROM (VALUES ('f1','d'),('f2','a')) s(function_id, node) UNION SELECT w.function_id, v.a FROM w JOIN {CFG} ON v.function_id = w.function_id AND v.b = w.node")
def gr_cfg_back(f: Facts) -> DataFrame:
    steps = f.spark.sql(f"SELECT * FROM {CFG.replace('v(', 'AS v(')}")
    return graph.trace_back(steps, f.spark.createDataFrame([("f1", "d"), ("f2", "a")], "function_id string, node string"))
