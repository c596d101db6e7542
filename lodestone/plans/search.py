"""Queries over documents, identifiers, questions and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import text
from lodestone.plans.registry import Facts, query

QUERY = "the contact license and the der"
_BM = {
    "q": "SELECT * FROM (VALUES ('the', 2), ('contact', 1), ('license', 1), ('and', 1), ('der', 1)) v(term, w)",
    "d": "SELECT id, repo, regexp_extract_all(lower(content), '[a-z0-9]{2,}') AS ts FROM br_docs",
    "h": "SELECT id, repo, len(ts)::DOUBLE AS dl, term, w, len(list_filter(ts, lambda x: x = term))::DOUBLE AS tf FROM d, q WHERE list_contains(ts, term)",
    "s": "SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d",
    "f": "SELECT term, count(*) AS df FROM h GROUP BY 1",
    "sc": """SELECT id, repo, sum(w * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
      FROM h JOIN f USING (term), s GROUP BY 1, 2""",
}


@query("tx_bm25", "SELECT id, round(score, 6) AS score FROM sc", **_BM)
def tx_bm25(f: Facts) -> DataFrame:
    return text.bm25(f["br_docs"], QUERY).select("id", F.round("score", 6).alias("score"))


@query("tk_bm25", "SELECT id, round(score, 6) AS score FROM (SELECT id, score FROM sc WHERE repo = (SELECT min(repo) FROM br_docs) ORDER BY round(score, 9) DESC, id LIMIT 10)", **_BM)
def tk_bm25(f: Facts) -> DataFrame:
    """The best ten of the first repo; the limit is taken after the repo's filter, frequencies over all repos."""
    first = f["br_docs"].agg(F.min("repo")).first()[0]
    best = text.bm25(f["br_docs"], QUERY, repo=first).select("id", F.round("score", 9).alias("s")).orderBy(F.desc("s"), "id").limit(10)
    return best.select("id", F.round("s", 6).alias("score"))


@query("tx_kuzu_fts", "SELECT id, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY round(score, 9) DESC, id LIMIT 20", **_BM)
def tx_kuzu_fts(f: Facts) -> DataFrame:
    """Any term may match, scores are positive; unlike the graph store's search the page has an order."""
    best = text.bm25(f["br_docs"], QUERY).select("id", F.round("score", 9).alias("s")).where("s > 0").orderBy(F.desc("s"), "id").limit(20)
    return best.select("id", F.round("s", 6).alias("score"))


_FTS = _BM | {
    "q": "SELECT * FROM (VALUES ('^contact(s|ed|ing)?$', 1), ('^licens(e|es|ed|ing)$', 1)) v(term, w)",
    "d": "SELECT id, repo, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS ts FROM br_docs",
    "h": "SELECT * FROM (SELECT id, repo, len(ts)::DOUBLE AS dl, term, w, len(list_filter(ts, lambda x: regexp_matches(x, term)))::DOUBLE AS tf FROM d, q) WHERE tf > 0",
}


@query("tx_fts", "SELECT id, round(score, 6) AS score FROM sc", **_FTS)
def tx_fts(f: Facts) -> DataFrame:
    return text.bm25(f["br_docs"], "contacts licensed", stem=True).select("id", F.round("score", 6).alias("score"))


@query("jn_fts_docs", "SELECT id, repo, round(score, 6) AS score FROM sc", **_BM)
def jn_fts_docs(f: Facts) -> DataFrame:
    d = f["br_docs"]
    return text.bm25(d, QUERY).join(d.select("id", "repo"), "id").select("id", "repo", F.round("score", 6).alias("score"))


@query("snk_search_idx", "SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM d) GROUP BY 1, 2", d=_BM["d"])
def snk_search_idx(f: Facts) -> DataFrame:
    return text.postings(f["br_docs"]).select("id", "term", "tf")


@query("tx_delete", "SELECT id FROM (SELECT concat('r', CAST(p_partkey % 5 AS STRING), ':f', CAST(p_size AS STRING), '#', p_name) AS id FROM part) WHERE split_part(id, '#', 1) NOT IN ('r1:f3', 'r2:f7')")
def tx_delete(f: Facts) -> DataFrame:
    docs = f["part"].selectExpr("concat('r', p_partkey % 5, ':f', p_size, '#', p_name) AS id")
    return text.without_files(docs, f.spark.createDataFrame([("r1:f3",), ("r2:f7",)], "path string"))


NAMES = "SELECT p_partkey, concat(CASE p_size % 7 WHEN 0 THEN 'get' WHEN 1 THEN 'isValid' WHEN 2 THEN 'onClick' WHEN 3 THEN 'parse' WHEN 4 THEN 'HTTPServer' WHEN 5 THEN 'user_name-' ELSE '' END, replace(p_brand, '#', 'Of')) AS name FROM part"
_SPLIT = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[\\s_\\-]+'), lambda w: w <> '')"


def _names(f: Facts) -> DataFrame:
    return f.sql(NAMES.replace("FROM part", "FROM {part}"))


@query("tx_split_ident", f"SELECT p_partkey, array_to_string({_SPLIT}, ' ') AS words FROM ({NAMES})")
def tx_split_ident(f: Facts) -> DataFrame:
    return _names(f).select("p_partkey", F.array_join(text.split_identifier(F.col("name")), " ").alias("words"))


_VERBS = ", ".join(f"'{v}'" for v in text.VERBS)


@query(
    "tx_purpose",
    f"""SELECT p_partkey, CASE WHEN n > 1 AND a IN ('is', 'has', 'can', 'should') THEN 'check' WHEN n > 1 AND a IN ('on', 'handle') THEN 'handle' WHEN a IN ({_VERBS}) THEN a ELSE 'compute' END AS verb,
      CASE WHEN n > 1 AND a IN ('is', 'has', 'can', 'should') THEN rest WHEN n > 1 AND a IN ('on', 'handle') THEN rest || ' event' WHEN a IN ({_VERBS}) THEN CASE WHEN n > 1 THEN rest ELSE 'unknown' END ELSE lower(array_to_string(ws, ' ')) END AS object,
      CASE WHEN n > 1 AND a IN ('is', 'has', 'can', 'should') THEN 0.8::DOUBLE WHEN n > 1 AND a IN ('on', 'handle') THEN 0.75::DOUBLE WHEN a IN ({_VERBS}) THEN CASE WHEN n > 1 THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END ELSE 0.4::DOUBLE END AS confidence
    FROM (SELECT p_partkey, ws, len(ws) AS n, lower(ws[1]) AS a, lower(array_to_string(ws[2:], ' ')) AS rest FROM (SELECT p_partkey, {_SPLIT} AS ws FROM ({NAMES}))) WHERE n > 1 OR a IN ({_VERBS})""",
)
def tx_purpose(f: Facts) -> DataFrame:
    return _names(f).select("p_partkey", text.purpose(F.col("name")).alias("p")).where("p IS NOT NULL").select("p_partkey", "p.*")


_SQL_ROUTE = "CASE " + " ".join(f"WHEN regexp_matches(q, '{p}') THEN '{r}'" for r, _, p in text.ROUTES) + " ELSE 'search' END"


@query("tx_route", f"SELECT conv_id, turn, {_SQL_ROUTE} AS route FROM (SELECT *, lower(trim(text)) AS q FROM conversations)")
def tx_route(f: Facts) -> DataFrame:
    return f["conversations"].select("conv_id", "turn", text.route(F.col("text")).alias("r")).select("conv_id", "turn", "r.route")


@query("tx_entities")
def tx_entities(f: Facts) -> DataFrame:
    s = f["conversations"].select("conv_id", "turn", text.scope(F.col("text")).alias("s"))
    s = s.select("conv_id", "turn", F.array_join("s.repos", ",").alias("repos"), F.col("s.question").alias("question"))
    return s.select("conv_id", "turn", "repos", F.array_join(text.entities(F.col("question")), ",").alias("entities"))


@query(
    "tx_classify_q",
    """SELECT conv_id, turn, CASE
      WHEN len(list_intersect(w, ['call', 'calls', 'depend', 'depends', 'import', 'imports', 'extend', 'extends', 'implement', 'implements', 'graph', 'reference', 'definition'])) > 0 THEN 'structural'
      WHEN len(list_intersect(w, ['risk', 'fault', 'error', 'failure', 'bug', 'vulnerability', 'issue', 'problem', 'configuration', 'flag'])) > 0 THEN 'analytical' ELSE 'search' END AS kind
    FROM (SELECT conv_id, turn, string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+') AS w FROM conversations)""",
)
def tx_classify_q(f: Facts) -> DataFrame:
    return f["conversations"].select("conv_id", "turn", text.question_kind(F.col("text")).alias("kind"))


@query("tx_drain")
def tx_drain(f: Facts) -> DataFrame:
    return text.log_templates(f["br_logs"])


@query("tx_logs", "SELECT repo, count(*) AS messages FROM br_logs GROUP BY 1")
def tx_logs(f: Facts) -> DataFrame:
    """The templates' frequencies add up to the messages of each repo."""
    return text.log_templates(f["br_logs"]).groupBy("repo").agg(F.sum("frequency").alias("messages"))


@query("tx_log_roots", "SELECT repo, severity, CASE severity WHEN 'error' THEN 'high' ELSE 'medium' END AS level, message FROM br_logs WHERE severity IN ('error', 'warn')")
def tx_log_roots(f: Facts) -> DataFrame:
    """Each message as a template of its own."""
    return text.log_roots(f["br_logs"].select("repo", "severity", F.col("message").alias("template"))).select("repo", "severity", "level", F.col("template").alias("message"))


LOGS = "(VALUES ('r1', 1, 'a.ts', 10, array('x', 'y'), array('b.ts')), ('r1', 2, 'a.ts', 25, array('z'), array()), ('r1', 3, 'a.ts', 90, array('z', 'w'), array()), ('r1', 4, 'b.ts', 5, array('q'), array()), ('r1', 5, 'c.ts', 5, array('x', 'y', 'k'), array())) AS v(repo, id, module, line, traces, calls)"


@query("tx_log_pairs", "SELECT * FROM (VALUES ('r1', 1, 2, 'same-function', 0.9::DOUBLE), ('r1', 1, 3, 'same-file', 0.6::DOUBLE), ('r1', 1, 4, 'call-connected', 0.4::DOUBLE), ('r1', 1, 5, 'trace-overlap', 0.7::DOUBLE), ('r1', 2, 3, 'trace-overlap', 0.7::DOUBLE)) v(repo, id_a, id_b, relation, score)")
def tx_log_pairs(f: Facts) -> DataFrame:
    return text.log_pairs(f.spark.sql(f"SELECT * FROM {LOGS}").withColumn("calls", F.col("calls").cast("array<string>")))


@query(
    "tx_context",
    """WITH t AS (SELECT conv_id, turn, lower(text) AS t FROM conversations),
    h AS (SELECT conv_id, turn, 'database' AS context, 0 AS rank, t LIKE '%database%' OR t LIKE '%query%' OR t LIKE '%sql%' AS hit FROM t
      UNION ALL SELECT conv_id, turn, 'network', 1, t LIKE '%http%' OR t LIKE '%request%' OR t LIKE '%api%' FROM t
      UNION ALL SELECT conv_id, turn, 'authentication', 2, t LIKE '%auth%' OR t LIKE '%token%' OR t LIKE '%permission%' FROM t
      UNION ALL SELECT conv_id, turn, 'filesystem', 3, t LIKE '%file%' OR t LIKE '%disk%' FROM t
      UNION ALL SELECT conv_id, turn, 'memory', 4, t LIKE '%memory%' OR t LIKE '%heap%' FROM t),
    g AS (SELECT conv_id, context, rank, count(*) FILTER (hit) AS k, count(*) AS n, min(turn) FILTER (hit) AS f FROM h GROUP BY 1, 2, 3)
    SELECT conv_id AS group_id, context FROM g WHERE k > 0 AND 2 * k >= n QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC, f, rank) = 1""",
)
def tx_context(f: Facts) -> DataFrame:
    """Conversations stand for groups, turns for their templates."""
    return text.shared_context(f["conversations"].select(F.col("conv_id").alias("group_id"), F.col("turn").alias("ord"), F.col("text").alias("template")))
