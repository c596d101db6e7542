"""Mixing sources to target weights.

Tokens (runs without white space) are counted per source; a source's repetition rate is its share of the budget over its
tokens; each document is emitted floor(rate) times, plus once more with the fraction's probability by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import quoted, tidy, written

SEED = 5
TEMPERATURE = 0.7


def tokens(text: Column) -> Column:
    """Runs without blanks, tabs or line ends: those that start at the text's beginning or after one of these."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\r", "   ")
    return F.regexp_count(plain, F.lit("[^ ]+")).cast("bigint")


def coin(seed: int, key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, budget: int | None = None) -> DataFrame:
    """(__source, tokens, rate). Weights are relative; without them a source's weight is its tokens to the power of `temperature`.

    The budget in tokens is what the table has if none is given. A source without tokens or without weight has rate 0.
    """
    have = {c.lower(): c for c in docs.columns}
    text = F.col(quoted(have["text"])).cast("string")
    source = F.coalesce(F.col(quoted(have["source"])).cast("string"), F.lit("")) if "source" in have else F.lit("")
    per = docs.select(source.alias("__source"), tokens(text).alias("n")).groupBy("__source").agg(F.sum("n").alias("tokens"))
    if weights is None:
        weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(float(temperature)))).otherwise(F.lit(0.0))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("__source") == name, F.lit(float(w))).otherwise(weight)
    per = written(per.withColumn("weight", weight))  # a row for each source
    total = per.agg(F.sum("tokens").alias("all_tokens"), F.sum(F.when(F.col("tokens") > 0, F.col("weight")).otherwise(0.0)).alias("all_weight"))
    share = F.col("weight") / F.col("all_weight")
    goal = F.lit(float(budget)) if budget is not None else F.col("all_tokens").cast("double")
    rate = F.when((F.col("tokens") > 0) & (F.col("all_weight") > 0), F.round(share * goal / F.col("tokens"), 9)).otherwise(F.lit(0.0))
    return per.crossJoin(F.broadcast(total)).select("__source", "tokens", rate.alias("rate"))


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, budget: int | None = None, seed: int = SEED, number: bool = True) -> DataFrame:
    """docs with each row repeated by its source's rate; copy counts from 0 (left out unless `number`).

    Null sources make one source, named ''. Null texts and texts without tokens count 0 tokens and are emitted at their
    source's rate. The coin hangs on doc_id (on the text where that is null), so repeated rows share it. An empty table
    gives an empty result; an input column named copy is replaced.
    """
    docs = tidy(docs, ["copy", "__source", "__rate", "__n"] if number else ["__copy", "__source", "__rate", "__n"])
    have = {c.lower(): c for c in docs.columns}
    source = F.coalesce(F.col(quoted(have["source"])).cast("string"), F.lit("")) if "source" in have else F.lit("")
    ident = F.col(quoted(have["doc_id"])).cast("string") if "doc_id" in have else F.lit(None).cast("string")
    key = F.coalesce(ident, F.md5(F.coalesce(F.col(quoted(have["text"])).cast("string"), F.lit(""))))
    table = rates(docs, weights, temperature, budget).select("__source", F.col("rate").alias("__rate"))
    table = F.broadcast(table) if table.count() <= 100_000 else table
    whole = F.floor("__rate").cast("int")
    n = whole + F.when(coin(seed, key) < F.col("__rate") - whole, 1).otherwise(0)
    out = docs.withColumn("__source", source).join(table, "__source").withColumn("__n", n).where("__n > 0")
    name = "copy" if number else "__copy"
    out = out.withColumn(name, F.explode(F.expr("sequence(0, __n - 1)"))).drop("__source", "__rate", "__n")
    return out if number else out.drop("__copy")


def oracle_sql(table: str = "documents", temperature: float = TEMPERATURE, seed: int = SEED, number: bool = True) -> str:
    return f"""
WITH per AS (
  SELECT coalesce(source, '') AS so, sum(len(list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(13), '   '), ' '), lambda x: x <> ''))) AS tk
  FROM {table} GROUP BY 1),
w AS (SELECT so, CAST(tk AS DOUBLE) AS tk, CASE WHEN tk > 0 THEN pow(CAST(tk AS DOUBLE), CAST({temperature} AS DOUBLE)) ELSE 0 END AS wt FROM per),
r AS (SELECT so, CASE WHEN tk > 0 THEN round(wt / sum(wt) OVER () * sum(tk) OVER () / tk, 9) ELSE 0 END AS rate FROM w),
n AS (SELECT d.*, CAST(floor(rate) AS BIGINT) + CASE WHEN
        CAST(('0x' || md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))))[1:12]) AS BIGINT) / CAST(281474976710656 AS DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END AS n
      FROM {table} d JOIN r ON coalesce(d.source, '') = r.so)
SELECT doc_id, text, lang, source, n_chars{", CAST(unnest(range(0, n)) AS INTEGER) AS copy" if number else ""} FROM n{"" if number else ", range(0, 1000000) c(i) WHERE c.i < n.n"}
"""
