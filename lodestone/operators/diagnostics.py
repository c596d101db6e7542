"""Findings: identity, baselines, filters, debt, priorities and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.mining import half_up

#: rule: (debt minutes when indexing, debt minutes in reports, category)
RULES: dict[str, tuple[int, int, str]] = {
    "arch/dependency-direction": (90, 120, "architecture"),
    "arch/forbidden-import": (60, 30, "architecture"),
    "arch/layer-violation": (90, 90, "architecture"),
    "blast-radius/high-pagerank": (60, 60, "blast-radius"),
    "config/always-on-flag": (15, 15, "config"),
    "config/conflicting-settings": (30, 60, "config"),
    "config/dead-flag": (30, 15, "config"),
    "config/dead-setting": (30, 30, "config"),
    "config/format-violation": (30, 15, "config"),
    "config/high-interaction-strength": (30, 120, "config"),
    "config/missing-constraint": (30, 20, "config"),
    "config/missing-dependency": (30, 60, "config"),
    "config/unregistered-flag": (30, 15, "config"),
    "config/untested-interaction": (45, 90, "config"),
    "config/unused-registry-flag": (30, 15, "config"),
    "fault/cascading-failure-risk": (120, 480, "fault"),
    "fault/missing-error-boundary": (90, 120, "fault"),
    "fault/silent-failure": (45, 20, "fault"),
    "fault/unhandled-error-path": (60, 30, "fault"),
    "hotspot/high-churn-complexity": (180, 240, "hotspot"),
    "structural/dead-export": (10, 15, "structural"),
    "structural/pain-zone-module": (120, 240, "structural"),
    "structural/unstable-dependency": (60, 120, "structural"),
    "structural/uselessness-zone-module": (30, 60, "structural"),
    "temporal-coupling/co-change": (30, 45, "temporal"),
    "vuln/reachable-dependency": (30, 30, "vulnerability"),
}
WEIGHTS = {"architecture": 10, "blast-radius": 0, "config": 5, "fault": 20, "hotspot": 15, "structural": 5, "temporal": 8, "vulnerability": 30}
PREFIXES = {"arch": "architecture", "blast-radius": "blast-radius", "config": "config", "fault": "fault", "structural": "structural", "temporal-coupling": "temporal", "vuln": "vulnerability"}


def _case(of: Column, table: dict, default) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(of == k, F.lit(v)) if out is None else out.when(of == k, F.lit(v))
    return out.otherwise(default)


def category(rule: Column) -> Column:
    """A known rule's category, else that of its prefix, else unknown."""
    return _case(rule, {r: c for r, (_, _, c) in RULES.items()}, _case(F.substring_index(rule, "/", 1), PREFIXES, F.lit("unknown")))


def weight(cat: Column) -> Column:
    return _case(cat, WEIGHTS, F.lit(0))


def debt_minutes(rule: Column, report: bool = False) -> Column:
    return _case(rule, {r: m[report] for r, m in RULES.items()}, F.lit(60 if report else 30))


def fingerprint(rule: Column, fqn: Column) -> Column:
    """fqn: a name, or names joined by |."""
    return F.concat_ws("::", rule, fqn)


def djb2(text: Column) -> Column:
    """The exclusive-or variant, 32 bits, as 8 hexadecimal digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(codes, F.lit(5381).cast("bigint"), lambda h, c: (h * 33).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(c))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def compared(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """current with state (new, unchanged, updated) and the baseline's rows that are gone (absent).

    Of baseline rows with one fingerprint the last counts; repeated current rows all stay.
    """
    old = baseline.groupBy("fp").agg(F.max_by(F.struct("ord", "rule_id", "level", "message", "repo", "fqn"), "ord").alias("old"))
    j = current.join(old, "fp", "full_outer")
    same = (F.col("level") == F.col("old.level")) & (F.col("message") == F.col("old.message"))
    state = F.when(F.col("rule_id").isNull(), "absent").when(F.col("old").isNull(), "new").when(same, "unchanged").otherwise("updated")
    return j.select("fp", *[F.coalesce(c, f"old.{c}").alias(c) for c in ("ord", "rule_id", "level", "message", "repo", "fqn")], state.alias("state"))


def baseline_check(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(fp, change): fingerprints that are new, and those that are fixed."""
    new = current.select("fp").distinct().join(baseline, "fp", "left_anti").withColumn("change", F.lit("new"))
    return new.unionByName(baseline.select("fp").distinct().join(current, "fp", "left_anti").withColumn("change", F.lit("fixed")))


def filtered(findings: DataFrame, repo: str | None = None, rule_id: str | None = None, levels: Sequence[str] = ()) -> DataFrame:
    if repo is not None:
        findings = findings.where(F.col("repo") == repo)
    if rule_id is not None:
        findings = findings.where(F.col("rule_id") == rule_id)
    return findings.where(F.col("level").isin(*levels)) if levels else findings


def keyword_matches(findings: DataFrame, query: str) -> DataFrame:
    """At least half of the query's words, rounded up, are in the rule id or the message."""
    words = [w for w in query.lower().split() if len(w) > 1]
    if not words:
        return findings
    text = F.lower(F.concat_ws(" ", "rule_id", "message"))
    hits = sum((F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    return findings.where(hits >= max(1, -(-len(words) // 2)))


STOP_WORDS = frozenset("a about all an and any are for have in is list me of show that the there what which with".split())


def analytical(findings: DataFrame, query: str, entities: Sequence[str] = (), limit: int = 50) -> DataFrame:
    """Filters by a level or a category that the query names; then an entity or the majority of the other words must match."""
    words = [w for w in query.lower().split() if w not in STOP_WORDS]
    levels = [n for n in ("error", "warning", "note") if {n, n + "s"} & set(words)]
    cats = [p for p in PREFIXES if {p, p + "s"} & set(words)]
    out = filtered(findings, levels=levels)
    if cats:
        out = out.where(F.substring_index("rule_id", "/", 1).isin(*cats))
    rest = [w for w in words if w.rstrip("s") not in {*levels, *cats} and w not in {*levels, *cats}]
    if rest or entities:
        text = F.lower(F.concat_ws(" ", "rule_id", "message"))
        named = F.lit(False)
        for e in entities:
            named = named | F.contains(text, F.lit(e.lower()))
        hits = sum((F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in rest), F.lit(0))
        out = out.where(named | ((hits >= max(1, -(-len(rest) // 2))) if rest else F.lit(False)))
    return out.orderBy("ord").limit(limit)


def touching(findings: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings whose name equals a changed path, or one of both ends with a slash and the other.

    The suffix test becomes equality: names and paths are exploded into what follows each of their slashes.
    """
    suffixes = lambda c: F.expr(f"transform(sequence(1, size(split({c}, '/'))), i -> array_join(slice(split({c}, '/'), i, size(split({c}, '/'))), '/'))")
    up = findings.withColumn("s", F.explode(suffixes("fqn"))).join(paths.select(F.col("path").alias("s")).distinct(), "s", "left_semi").drop("s")
    down = findings.join(paths.select(F.explode(suffixes("path")).alias("fqn")).distinct(), "fqn", "left_semi").select(*findings.columns)
    return up.select(*findings.columns).unionByName(down).distinct()


def debt(findings: DataFrame, report: bool = False) -> DataFrame:
    """(rule_id, level, findings, minutes, hours): by rule, by level and in total, in one pass; hours to a tenth."""
    rows = findings.select("rule_id", "level", debt_minutes(F.col("rule_id"), report).cast("bigint").alias("m"))
    sets = rows.groupingSets([["rule_id"], ["level"], []], "rule_id", "level").agg(F.count("*").alias("findings"), F.sum("m").alias("minutes"))
    return sets.withColumn("hours", half_up(F.col("minutes") / 60 * 10) / 10)


def debt_by_category(findings: DataFrame, top: int | None = None) -> DataFrame:
    per = findings.groupBy("rule_id").agg(F.count("*").alias("findings"))
    out = per.select("rule_id", category(F.col("rule_id")).alias("category"), "findings", (F.col("findings") * debt_minutes(F.col("rule_id"), True)).alias("minutes"))
    return out if top is None else out.orderBy(F.desc("minutes"), "rule_id").limit(top)


def level_counts(findings: DataFrame, *by: str) -> DataFrame:
    n = lambda level: F.count_if(F.col("level") == level)
    e, w = n("error"), n("warning")
    return findings.groupBy(*by).agg(e.alias("errors"), w.alias("warnings"), (F.count("*") - e - w).alias("notes"))


def prioritized(findings: DataFrame) -> DataFrame:
    """Per rule: count, the level of its first finding, whether any is new, score and tier. findings has ord and is_new."""
    g = findings.groupBy("rule_id").agg(F.count("*").alias("n"), F.min_by("level", "ord").alias("level"), F.bool_or("is_new").alias("has_new"))
    severity = F.when(F.col("level") == "error", 100).when(F.col("level") == "warning", 60).otherwise(20)
    score = severity + F.least("n", F.lit(50)) + weight(category(F.col("rule_id"))) + F.when(F.col("has_new"), 15).otherwise(0)
    tier = F.when(F.col("score") >= 80, "fix-now").when(F.col("score") >= 40, "plan").otherwise("monitor")
    return g.withColumn("score", score.cast("bigint")).withColumn("tier", tier)


def scorecard(findings: DataFrame) -> DataFrame:
    """Per category: counts and a health from 1 to 5."""
    c = level_counts(findings.withColumn("category", category(F.col("rule_id"))), "category")
    raw = 5 - F.floor(F.col("errors") / 2) - F.floor(F.col("warnings") / 5) - F.floor(F.col("notes") / 10) * 0.5
    return c.withColumn("health", F.greatest(F.lit(1).cast("bigint"), half_up(raw)))


def recommendations(findings: DataFrame, health: DataFrame) -> DataFrame:
    """(priority, title): the four best rules to fix now, then structural advice if a repo is critical; seven at most."""
    top = prioritized(findings).where("tier = 'fix-now'").orderBy(F.desc("score"), "rule_id").limit(4)
    top = top.select((-F.col("score")).cast("bigint").alias("o"), F.concat(F.lit("Fix "), "rule_id").alias("title"))
    bad = health.agg(
        F.bool_or((F.col("distance_rating") == "critical") | (F.col("pain_rating") == "critical")).alias("pain"), F.bool_or(F.col("useless_rating") == "critical").alias("useless")
    )
    pain = bad.where("pain").select(F.lit(1).cast("bigint").alias("o"), F.lit("Reduce structural pain zones").alias("title"))
    useless = bad.where("useless").select(F.lit(2).cast("bigint").alias("o"), F.lit("Collapse over-abstracted modules").alias("title"))
    return top.unionByName(pain).unionByName(useless).orderBy("o", "title").limit(7).select("title")


def repo_scores(summary: DataFrame, counts: DataFrame) -> DataFrame:
    """(repo, modules, density, zone_ratio, distance, score): a technical debt index, 100 is best. Internal counts go first."""
    j = summary.join(counts, "repo", "left").na.fill(0, ["errors", "warnings", "notes"])
    one = F.lit(1).cast("bigint")
    density = F.least(F.lit(1.0), ((F.col("errors") * 10 + F.col("warnings") * 3 + F.col("notes")) / F.greatest("module_count", one)) / 10)
    zone_ratio = (F.col("internal_pain") + F.col("internal_useless")) / F.greatest("internal_count", one)
    distance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("avg_distance")))
    out = j.select("repo", F.col("module_count").alias("modules"), density.alias("density"), zone_ratio.alias("zone_ratio"), distance.alias("distance"))
    score = half_up((1 - (F.col("density") * 0.5 + F.col("zone_ratio") * 0.3 + F.col("distance") * 0.2)) * 100)
    return out.withColumn("score", F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(100).cast("bigint"), score)))


def system_score(scores: DataFrame) -> DataFrame:
    """The mean of the repos' scores by modules; 100 without repos."""
    w = F.greatest("modules", F.lit(1).cast("bigint"))
    return scores.agg(F.coalesce(half_up(F.sum(w * F.col("score")) / F.sum(w)), F.lit(100).cast("bigint")).alias("score"))


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("F")


def practice_score(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """(score, trend): the reports' index. Finding debt by category is capped at 70, structural debt at 30."""
    zone = lambda c: half_up(F.col(c) / F.greatest("module_count", F.lit(1)) * 1000) / 10
    distance = half_up(F.col("avg_distance") * 1000) / 1000
    s = summary.agg(F.sum("module_count").alias("modules"), F.avg(distance * 15 + zone("pain_count") / 100 * 10 + zone("useless_count") / 100 * 5).alias("structural"))
    c = level_counts(findings.withColumn("category", category(F.col("rule_id"))), "category")
    debt_ = ((F.col("errors") * 3 + F.col("warnings") + F.col("notes") * 0.3) / F.greatest("modules", F.lit(1))) * weight(F.col("category"))
    per = c.crossJoin(F.broadcast(s)).groupBy("structural").agg(F.sum(debt_).alias("found"))  # one row
    states = findings.agg(F.count("*").alias("n"), F.count_if("is_new").alias("new"), F.count_if(F.col("state") == "absent").alias("gone"))
    total = F.least(F.lit(100.0), F.least(F.lit(70.0), F.col("found")) + F.least(F.lit(30.0), F.col("structural")))
    trend = F.when(F.col("new") > F.col("n") * 0.2, "worsening").when(F.col("gone") > 0, "improving").otherwise("stable")
    return per.crossJoin(states).select((half_up((100 - total) * 10) / 10).alias("score"), trend.alias("trend"))


SERVICE_NAME = r"\b[A-Z][a-zA-Z]+(?:Controller|Factory|Handler|Manager|Module|Repository|Service)\b"
SOURCE_PATH = r"(?:\.{0,2}/)?(?:[\w.-]+/)+[\w.-]+\.(?:cjs|mjs|[jt]sx?)\b"


def token(value: Column, salt: str) -> Column:
    return F.concat(F.lit("[REDACTED:"), F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 8), F.lit("]"))


def redacted(text: Column, salt: str, paths: bool = False) -> Column:
    """text with service names (and source paths) replaced by salted hashes, longest first so none is cut."""
    found = F.regexp_extract_all(text, F.lit(SERVICE_NAME if not paths else f"({SOURCE_PATH}|{SERVICE_NAME})"), F.lit(1 if paths else 0))
    ordered = F.reverse(F.array_sort(F.transform(F.array_distinct(found), lambda m: F.struct(F.length(m).alias("n"), m.alias("m")))))
    return F.aggregate(ordered, text, lambda t, m: F.replace(t, m.m, token(m.m, salt)))


def anonymized(text: Column, repos: Sequence[str], salt: str) -> Column:
    """Repo names in text replaced by salted hashes, the longest first."""
    for r in sorted(repos, key=lambda r: (-len(r), r)):
        text = F.replace(text, F.lit(r), token(F.lit(r), salt))
    return text


def sarif(findings: DataFrame, tool: str = "lodestone") -> DataFrame:
    """(repo, log): one SARIF 2.1.0 document for each repo."""
    place = F.array(F.struct(F.array(F.struct(F.col("fqn").alias("fullyQualifiedName"))).alias("logicalLocations")))
    result = F.struct(F.col("ord"), F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations")).alias("r"))
    per = findings.groupBy("repo").agg(F.sort_array(F.collect_list(result)).alias("rs"), F.array_sort(F.collect_set("rule_id")).alias("rules"))
    driver = F.struct(F.lit(tool).alias("name"), F.transform("rules", lambda r: F.struct(r.alias("id"))).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("rs.r").alias("results"))
    return per.select("repo", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("log"))
