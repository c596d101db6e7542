"""Queries over diagnostic findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import diagnostics as dx
from lodestone.operators import metrics, store
from lodestone.plans.registry import Facts, query
from lodestone.plans.structure import SUMMARY, M, _metrics


def _sql_case(of: str, table: dict, default: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {default} END"


CATEGORY = _sql_case("rule_id", {r: c for r, (_, _, c) in dx.RULES.items()}, _sql_case("split_part(rule_id, '/', 1)", dx.PREFIXES, "'unknown'"))
MINUTES, REPORT_MINUTES = (_sql_case("rule_id", {r: m[k] for r, m in dx.RULES.items()}, d) for k, d in ((0, "30"), (1, "60")))
WEIGHT = _sql_case("category", dx.WEIGHTS, "0")
CTE = {
    "cur": "SELECT *, rule_id || '::' || fqn AS fp FROM br_findings WHERE snapshot = 'current'",
    "bas": "SELECT *, rule_id || '::' || fqn AS fp FROM br_findings WHERE snapshot = 'baseline'",
    "cc": f"SELECT *, {CATEGORY} AS category, fp NOT IN (SELECT fp FROM bas) AS is_new FROM cur",
}


def _all(f: Facts) -> DataFrame:
    return f["br_findings"].withColumn("fp", dx.fingerprint(F.col("rule_id"), F.col("fqn")))


def _cur(f: Facts) -> DataFrame:
    return _all(f).where("snapshot = 'current'")


def _bas(f: Facts) -> DataFrame:
    return _all(f).where("snapshot = 'baseline'")


def _judged(f: Facts) -> DataFrame:
    """Current findings with is_new and state."""
    old = _bas(f).select("fp").distinct().withColumn("old", F.lit(True))
    new = F.col("old").isNull()
    return _cur(f).join(old, "fp", "left").withColumns({"is_new": new, "state": F.when(new, "new").otherwise("unchanged")})


@query(
    "tx_fingerprint",
    """SELECT ord, fp, printf('%08x', list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(fp, ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda h, c: xor((h * 33) & 4294967295, c))) AS hash FROM cur""",
    cur=CTE["cur"],
)
def tx_fingerprint(f: Facts) -> DataFrame:
    return _cur(f).select("ord", "fp", dx.djb2(F.col("fp")).alias("hash"))


@query("wn_first_wins", "SELECT fp, ord, level FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY ord) AS rn FROM cur) WHERE rn = 1", cur=CTE["cur"])
def wn_first_wins(f: Facts) -> DataFrame:
    return store.first_wins(_cur(f).select("fp", "ord", "level"), ["fp"], "ord")


@query("wn_last_wins", "SELECT fp, ord, level FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY ord DESC) AS rn FROM bas) WHERE rn = 1", bas=CTE["bas"])
def wn_last_wins(f: Facts) -> DataFrame:
    return store.last_wins(_bas(f).select("fp", "ord", "level"), ["fp"], "ord")


@query(
    "jn_baseline",
    """SELECT coalesce(c.fp, o.fp) AS fp, coalesce(c.ord, o.ord) AS ord, coalesce(c.level, o.level) AS level,
    CASE WHEN c.fp IS NULL THEN 'absent' WHEN o.fp IS NULL THEN 'new' WHEN c.level = o.level AND c.message = o.message THEN 'unchanged' ELSE 'updated' END AS state
    FROM cur c FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY ord DESC) AS rn FROM bas) WHERE rn = 1) o ON c.fp = o.fp""",
    **CTE,
)
def jn_baseline(f: Facts) -> DataFrame:
    return dx.compared(_cur(f), _bas(f)).select("fp", "ord", "level", "state")


@query(
    "jn_baseline_check",
    """SELECT DISTINCT fp || '::' || level AS fp, 'new' AS change FROM cur WHERE fp || '::' || level NOT IN (SELECT fp || '::' || level FROM bas)
    UNION ALL SELECT DISTINCT fp || '::' || level, 'fixed' FROM bas WHERE fp || '::' || level NOT IN (SELECT fp || '::' || level FROM cur)""",
    **CTE,
)
def jn_baseline_check(f: Facts) -> DataFrame:
    """A level is part of a finding's identity here, so that there are changes."""
    named = lambda df: df.withColumn("fp", F.concat_ws("::", "fp", "level"))
    return dx.baseline_check(named(_cur(f)), named(_bas(f)))


@query("flt_findings", "SELECT ord, rule_id, level FROM cur WHERE repo = 'r2' AND level IN ('error', 'warning') ORDER BY ord LIMIT 50 OFFSET 10", cur=CTE["cur"])
def flt_findings(f: Facts) -> DataFrame:
    return store.page(dx.filtered(_cur(f), repo="r2", levels=("error", "warning")), ["ord"], 10, 50).select("ord", "rule_id", "level")


@query("tk_page", "SELECT ord, fp FROM cur ORDER BY ord LIMIT 500 OFFSET 500", cur=CTE["cur"])
def tk_page(f: Facts) -> DataFrame:
    return store.page(_cur(f), ["ord"], 500, 500).select("ord", "fp")


@query("prj_paginate", "SELECT count(*) AS total, CAST(greatest(least(count(*) - 10, 50), 0) AS BIGINT) AS returned, CAST(10 AS BIGINT) AS \"offset\", count(*) > 60 AS has_more FROM cur WHERE repo = 'r2'", cur=CTE["cur"])
def prj_paginate(f: Facts) -> DataFrame:
    return store.page_info(dx.filtered(_cur(f), repo="r2"), 10, 50)


@query(
    "flt_keyword",
    """SELECT ord, fp FROM cur WHERE (contains(lower(rule_id || ' ' || message), 'dead'))::INT + (contains(lower(rule_id || ' ' || message), 'u12'))::INT
      + (contains(lower(rule_id || ' ' || message), 'click'))::INT >= 2""",
    cur=CTE["cur"],
)
def flt_keyword(f: Facts) -> DataFrame:
    return dx.keyword_matches(_cur(f), "dead u12 CLICK").select("ord", "fp")


@query(
    "flt_analytic",
    """SELECT ord, fp FROM cur WHERE level = 'error' AND split_part(rule_id, '/', 1) = 'config' AND (contains(lower(rule_id || ' ' || message), 'u7') OR contains(lower(rule_id || ' ' || message), 'signup'))
    ORDER BY ord LIMIT 50""",
    cur=CTE["cur"],
)
def flt_analytic(f: Facts) -> DataFrame:
    return dx.analytical(_cur(f), "show all errors in config signup", ["u7"]).select("ord", "fp")


TOUCHED = "SELECT event_id AS ord, concat('src/', event_type, '/u', CAST(user_id AS STRING), '.ts') AS fqn FROM {events}"


@query("flt_delta_touch", f"SELECT DISTINCT ord, fqn FROM ({TOUCHED.replace('{events}', 'events')}) JOIN (VALUES ('click/u3.ts'), ('u14.ts'), ('repo/src/view/u7.ts')) p(path) ON fqn = path OR ends_with(fqn, '/' || path) OR ends_with(path, '/' || fqn)")
def flt_delta_touch(f: Facts) -> DataFrame:
    return dx.touching(f.sql(TOUCHED), f.spark.createDataFrame([("click/u3.ts",), ("u14.ts",), ("repo/src/view/u7.ts",)], "path string"))


_DEBT = "floor(sum({m}) / 60.0::DOUBLE * 10 + 0.5) / 10"


@query("ag_debt", f"SELECT rule_id, level, count(*) AS findings, CAST(sum({MINUTES}) AS BIGINT) AS minutes, {_DEBT.format(m=MINUTES)} AS hours FROM cur GROUP BY GROUPING SETS ((rule_id), (level), ())", cur=CTE["cur"])
def ag_debt(f: Facts) -> DataFrame:
    return dx.debt(_cur(f))


@query("ag_debt_practices", f"SELECT rule_id, category, count(*) AS findings, CAST(sum({REPORT_MINUTES}) AS BIGINT) AS minutes FROM cc GROUP BY 1, 2 ORDER BY minutes DESC, rule_id LIMIT 10", **CTE)
def ag_debt_practices(f: Facts) -> DataFrame:
    return dx.debt_by_category(_cur(f), top=10)


_PRIO = f"""SELECT rule_id, n, level, has_new, CAST(CASE level WHEN 'error' THEN 100 WHEN 'warning' THEN 60 ELSE 20 END + least(n, 50) + {WEIGHT} + CASE WHEN has_new THEN 15 ELSE 0 END AS BIGINT) AS score
FROM (SELECT rule_id, any_value(category) AS category, count(*) AS n, arg_min(level, ord) AS level, bool_or(is_new) AS has_new FROM cc GROUP BY 1)"""


@query("ag_prioritize", "SELECT *, CASE WHEN score >= 80 THEN 'fix-now' WHEN score >= 40 THEN 'plan' ELSE 'monitor' END AS tier FROM prio", **CTE, prio=_PRIO)
def ag_prioritize(f: Facts) -> DataFrame:
    return dx.prioritized(_judged(f))


_LEVELS = "count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings, count(*) FILTER (level = 'note') AS notes"
_CARD = f"""SELECT category, errors, warnings, notes, greatest(1, CAST(floor(5 - floor(errors / 2.0::DOUBLE) - floor(warnings / 5.0::DOUBLE) - floor(notes / 10.0::DOUBLE) * 0.5::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS health
FROM (SELECT category, {_LEVELS} FROM cc GROUP BY 1)"""


@query("ag_scorecard", _CARD, **CTE)
def ag_scorecard(f: Facts) -> DataFrame:
    return dx.scorecard(_cur(f))


@query(
    "ag_recommend",
    """SELECT title FROM (
      (SELECT -score AS o, 'Fix ' || rule_id AS title FROM prio WHERE score >= 80 ORDER BY score DESC, rule_id LIMIT 4)
      UNION ALL SELECT 1, 'Reduce structural pain zones' FROM summary WHERE avg_distance >= 0.4::DOUBLE OR pain_count / module_count::DOUBLE >= 0.25::DOUBLE HAVING count(*) > 0
      UNION ALL SELECT 2, 'Collapse over-abstracted modules' FROM summary WHERE useless_count / module_count::DOUBLE >= 0.15::DOUBLE HAVING count(*) > 0) ORDER BY o, title LIMIT 7""",
    **CTE,
    prio=_PRIO,
    **M,
    summary=SUMMARY,
)
def ag_recommend(f: Facts) -> DataFrame:
    return dx.recommendations(_judged(f), metrics.structural_health(metrics.repo_summary(_metrics(f))))


_ATDI = f"""SELECT repo, modules, density, zone_ratio, distance, CAST(greatest(0, least(100, floor((1 - (density * 0.5::DOUBLE + zone_ratio * 0.3::DOUBLE + distance * 0.2::DOUBLE)) * 100 + 0.5))) AS BIGINT) AS score
FROM (SELECT s.repo, module_count AS modules, least(1.0::DOUBLE, ((coalesce(errors, 0) * 10 + coalesce(warnings, 0) * 3 + coalesce(notes, 0)) / greatest(module_count, 1)::DOUBLE) / 10) AS density,
  (internal_pain + internal_useless) / greatest(internal_count, 1)::DOUBLE AS zone_ratio, least(1.0::DOUBLE, greatest(0.0::DOUBLE, avg_distance)) AS distance
  FROM summary s LEFT JOIN (SELECT repo, {_LEVELS} FROM cur GROUP BY 1) c ON s.repo = c.repo)"""
_A = {**CTE, **M, "summary": SUMMARY, "atdi": _ATDI}


def _atdi(f: Facts) -> DataFrame:
    return dx.repo_scores(metrics.repo_summary(_metrics(f)), dx.level_counts(_cur(f), "repo"))


@query("ag_atdi_repo", "SELECT * FROM atdi", **_A)
def ag_atdi_repo(f: Facts) -> DataFrame:
    return _atdi(f)


@query("ag_atdi_system", "SELECT CAST(floor(sum(greatest(modules, 1) * score) / sum(greatest(modules, 1))::DOUBLE + 0.5) AS BIGINT) AS score FROM atdi", **_A)
def ag_atdi_system(f: Facts) -> DataFrame:
    return dx.system_score(_atdi(f))


@query("ag_exec", "SELECT repo, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM atdi", **_A)
def ag_exec(f: Facts) -> DataFrame:
    return _atdi(f).select("repo", "score", dx.grade(F.col("score")).alias("grade"))


@query(
    "ag_atdi_practices",
    f"""SELECT floor((100 - least(100.0::DOUBLE, least(70.0::DOUBLE, found) + least(30.0::DOUBLE, structural))) * 10 + 0.5) / 10 AS score,
    CASE WHEN (SELECT count(*) FILTER (is_new) > count(*) * 0.2 FROM cc) THEN 'worsening' ELSE 'stable' END AS trend
    FROM (SELECT sum((errors * 3 + warnings + notes * 0.3::DOUBLE) / modules::DOUBLE * {WEIGHT}) AS found, any_value(structural) AS structural
      FROM (SELECT category, {_LEVELS} FROM cc GROUP BY 1), (SELECT sum(module_count) AS modules, avg(floor(avg_distance * 1000 + 0.5) / 1000 * 15
        + floor(pain_count / module_count::DOUBLE * 1000 + 0.5) / 10 / 100 * 10 + floor(useless_count / module_count::DOUBLE * 1000 + 0.5) / 10 / 100 * 5) AS structural FROM summary))""",
    **_A,
)
def ag_atdi_practices(f: Facts) -> DataFrame:
    return dx.practice_score(_judged(f), metrics.repo_summary(_metrics(f)))


@query("ag_sarif_stats", f"SELECT repo, count(*) AS total, {_LEVELS}, count(DISTINCT rule_id) AS rules FROM cur GROUP BY 1", cur=CTE["cur"])
def ag_sarif_stats(f: Facts) -> DataFrame:
    c = _cur(f)
    rest = c.groupBy("repo").agg(F.count("*").alias("total"), F.count_distinct("rule_id").alias("rules"))
    return rest.join(dx.level_counts(c, "repo"), "repo")


@query("ag_report_diag", "SELECT rule_id, level, count(*) AS n FROM cur GROUP BY 1, 2", cur=CTE["cur"])
def ag_report_diag(f: Facts) -> DataFrame:
    return _cur(f).groupBy("rule_id", "level").agg(F.count("*").alias("n"))


@query(
    "tx_redact",
    """SELECT p_partkey, replace(replace(concat('OrderService calls ', p_name, ' in PaymentHandler'), 'PaymentHandler', '[REDACTED:' || sha256('saltPaymentHandler')[1:8] || ']'), 'OrderService', '[REDACTED:' || sha256('saltOrderService')[1:8] || ']') AS text FROM part""",
)
def tx_redact(f: Facts) -> DataFrame:
    text = F.expr("concat('OrderService calls ', p_name, ' in PaymentHandler')")
    return f["part"].select("p_partkey", dx.redacted(text, "salt").alias("text"))


@query("tx_anonymize", "SELECT n_nationkey, replace(replace(concat('core-web/', n_name, ' core'), 'core-web', '[REDACTED:' || sha256('saltcore-web')[1:8] || ']'), 'core', '[REDACTED:' || sha256('saltcore')[1:8] || ']') AS text FROM nation")
def tx_anonymize(f: Facts) -> DataFrame:
    return f["nation"].select("n_nationkey", dx.anonymized(F.expr("concat('core-web/', n_name, ' core')"), ["core", "core-web"], "salt").alias("text"))


@query("snk_sarif", "SELECT repo, count(*) AS results FROM cur GROUP BY 1", cur=CTE["cur"])
def snk_sarif(f: Facts) -> DataFrame:
    """The number of results that each repo's SARIF document holds."""
    kind = "struct<version:string,runs:array<struct<results:array<struct<ruleId:string,level:string>>>>>"
    log = dx.sarif(_cur(f)).withColumn("d", F.from_json("log", kind))
    return log.select("repo", F.size(F.col("d.runs")[0]["results"]).cast("bigint").alias("results"))
