"""Quality rules from cross-document line frequency.

Lines are normalised and hashed, a line's distinct documents are counted per host (the documents' source), lines above the
limit go, and documents that lose most of their text with them are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import BROADCAST_ROWS, RID, columns, numbered, small, written

#: A line in more distinct documents of one host than this is boilerplate.
MAX_DOCUMENTS = 20
#: A document that keeps less than this share of its characters is rejected.
MIN_KEPT = 0.5


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, blanks trimmed."""
    return F.trim(F.translate(F.lower(line), "123456789\t\r", "000000000  "))


def line_rules(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_kept: float = MIN_KEPT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every row of docs as (doc_id, text without frequent lines, removed, kept_share, keep).

    Lines are told apart by 128 bits of hash. A line in just max_documents texts stays, and a share of just min_kept is kept.
    Repeated rows give equal results, null and non-integer doc_ids are null, a text of any length is taken whole.
    Documents with the same text count as one, so copies alone don't make a line frequent. Blank lines never count and
    always stay. kept_share is kept over all characters, line ends aside; a document that loses nothing has share 1 and is
    kept, whatever its length. A null text stays null and is kept; a null source is a host of its own, ''. An empty table
    gives an empty result; extra columns are ignored.
    """
    docs = numbered(columns(docs, doc_id="bigint", text="string", source="string"))
    lines = docs.where("text IS NOT NULL").select(
        RID,
        F.coalesce("source", F.lit("")).alias("host"),
        F.xxhash64("text").alias("content"),
        F.posexplode(F.split("text", "\n", -1)).alias("at", "line"),
    )
    lines = lines.select(RID, "host", "content", "at", normalised(F.col("line")).alias("norm")).where("norm <> ''")
    lines = lines.select(RID, "host", "content", "at", F.xxhash64("norm").alias("hash"), F.xxhash64(F.lit(1), "norm").alias("check"))
    per_line = lines.select("host", "hash", "check", "content").distinct().groupBy("host", "hash", "check").agg(F.count("*").alias("n"))
    frequent = written(per_line.where(F.col("n") > max_documents).select("host", "hash", "check"))
    hit = written(lines.join(small(frequent, broadcast_rows), ["host", "hash", "check"]).groupBy(RID).agg(F.collect_list("at").alias("gone")))
    size = F.expr("aggregate(parts, 0L, (s, x) -> s + length(x))").cast("double")
    out = docs.join(small(hit, broadcast_rows, F.size("gone") + 1), RID, "left").withColumn("parts", F.split("text", "\n", -1))
    out = out.withColumn("stay", F.when(F.col("gone").isNotNull(), F.expr("transform(array_except(sequence(0, size(parts) - 1), gone), i -> parts[i])")))
    kept = F.expr("aggregate(stay, 0L, (s, x) -> s + length(x))").cast("double")
    share = F.when(F.col("gone").isNull(), F.lit(1.0)).otherwise(kept / size)
    return out.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join("stay", "\n")).alias("text"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("removed"),
        share.alias("kept_share"),
        (share >= F.lit(float(min_kept))).alias("keep"),
    )


def oracle_sql(max_documents: int = MAX_DOCUMENTS, min_kept: float = MIN_KEPT) -> str:
    norm = "trim(translate(lower(line), '123456789' || chr(9) || chr(13), '000000000  '))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, * FROM documents),
l AS (SELECT rid, coalesce(source, '') AS host, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
      FROM d WHERE text IS NOT NULL),
n AS (SELECT *, {norm} AS norm FROM l),
f AS (SELECT host, norm FROM n WHERE norm <> '' GROUP BY 1, 2 HAVING count(DISTINCT text) > {max_documents}),
m AS (SELECT n.*, f.norm IS NOT NULL AS gone FROM n LEFT JOIN f USING (host, norm)),
g AS (SELECT rid, count(*) FILTER (gone) AS removed, sum(length(line)) FILTER (NOT gone) AS kept, sum(length(line)) AS size,
             string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS stay FROM m GROUP BY rid),
h AS (SELECT d.doc_id, d.text, coalesce(removed, 0) AS removed, stay,
             CASE WHEN coalesce(removed, 0) = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(coalesce(kept, 0) AS DOUBLE) / size END AS kept_share
      FROM d LEFT JOIN g USING (rid))
SELECT doc_id, CASE WHEN removed = 0 THEN text ELSE coalesce(stay, '') END AS text, CAST(removed AS BIGINT) AS removed, kept_share,
       kept_share >= CAST({min_kept} AS DOUBLE) AS keep FROM h
"""
