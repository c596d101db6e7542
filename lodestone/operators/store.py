"""Scans, upserts and deletes over the edge and key-value tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def of_repo(df: DataFrame, repo: str | None) -> DataFrame:
    """Every read can be limited to one repo; on a table partitioned by repo this prunes partitions."""
    return df if repo is None else df.where(F.col("repo") == repo)


def edges_by_kind(edges: DataFrame, kind: str, repo: str | None = None, limit: int | None = None) -> DataFrame:
    out = of_repo(edges.where(F.col("kind") == kind), repo)
    return out if limit is None else out.orderBy("source", "target").limit(limit)


def edges_from(edges: DataFrame, node: str, repo: str | None = None) -> DataFrame:
    return of_repo(edges.where(F.col("source") == node), repo)


def edges_to(edges: DataFrame, node: str, repo: str | None = None) -> DataFrame:
    return of_repo(edges.where(F.col("target") == node), repo)


def edge_counts(edges: DataFrame, kind: str) -> DataFrame:
    """Edges of a kind per repo; a missing or empty repo counts as unknown."""
    repo = F.coalesce(F.nullif("repo", F.lit("")), F.lit("unknown"))
    return edges.where(F.col("kind") == kind).groupBy(repo.alias("repo")).agg(F.count("*").alias("n"))


def busiest(edges: DataFrame, n: int) -> DataFrame:
    """The n modules with most incoming edges."""
    return edges.groupBy(F.col("target").alias("module")).count().orderBy(F.desc("count"), "module").limit(n).select("module")


def without_files(edges: DataFrame, paths: DataFrame, repo: str | None = None) -> DataFrame:
    """edges without those of a repo that start or end at a deleted file or at a symbol in one."""
    gone = paths.select(F.col("path").alias("__file")).distinct()
    keyed = edges.withColumns({"__s": F.substring_index("source", "#", 1), "__t": F.substring_index("target", "#", 1)})
    within = F.lit(True) if repo is None else (F.col("repo") == repo)
    kept = keyed.join(gone, within & (F.col("__s") == F.col("__file")), "left_anti")
    return kept.join(gone, within & (F.col("__t") == F.col("__file")), "left_anti").drop("__s", "__t")


def by_prefix(kv: DataFrame, prefix: str) -> DataFrame:
    """Keys that begin with the prefix; the predicate reaches the scan."""
    return kv.where(F.col("key").startswith(prefix))


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key with the greatest ordinal, by a partial aggregate rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*keys, "r.*")


def first_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*keys, "r.*")


def merged(inputs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Tables one after another; for an equal key the last input wins."""
    out = None
    for i, df in enumerate(inputs):
        df = df.withColumn("__input", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return last_wins(out, keys, "__input").drop("__input")


def page(df: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_info(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """One row: total, returned, offset and has_more of a page."""
    n = F.count("*")
    got = F.greatest(F.least(n - offset, F.lit(limit)), F.lit(0))
    return df.agg(n.alias("total"), got.cast("bigint").alias("returned"), F.lit(offset).cast("bigint").alias("offset"), (n > offset + limit).alias("has_more"))


def rank(df: DataFrame, score: str, tie: str) -> DataFrame:
    """A global 1-based rank. The window runs in one task: give it bounded inputs, such as a page or one group's scores."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)).cast("bigint"))
