"""Mining of commit history: hotspots and temporal coupling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEST_PATH = r"(?i)(?:^|/)(?:__tests__|tests?|spec|e2e|fixtures)/|\.(?:test|spec)\.[jt]sx?$"


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def churn(commits: DataFrame) -> DataFrame:
    return commits.groupBy("file_path").agg(F.count_distinct("hash").alias("churn"))


def hotspots(commits: DataFrame, files: DataFrame, top: int | None = 20) -> DataFrame:
    """Files by churn and symbol count, each over its maximum; files without symbols and test files go before the maxima."""
    joined = churn(commits).join(files, "file_path").where((F.col("symbol_count") > 0) & ~is_test(F.col("file_path")))
    best = joined.agg(F.max("churn").alias("max_churn"), F.max("symbol_count").alias("max_symbols"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100).otherwise(0.0)
    score = half_up((share("churn", "max_churn") + share("symbol_count", "max_symbols")) / 2)
    out = joined.crossJoin(F.broadcast(best)).select("file_path", "churn", "symbol_count", score.cast("bigint").alias("score"))  # one row
    out = out.orderBy(F.desc("score"), F.desc("churn"), "file_path")
    return out if top is None else out.limit(top)


def hotspots_by_repo(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Per repo, normalised by the repo's own maxima."""
    joined = churn(commits).join(files, "file_path").where((F.col("symbol_count") > 0) & ~is_test(F.col("file_path")))
    w = Window.partitionBy("repo")
    share = lambda c: F.col(c) / F.max(c).over(w)
    return joined.select("repo", "file_path", F.round(share("churn"), 6).alias("churn_norm"), F.round(share("symbol_count"), 6).alias("symbol_norm"))


def temporal_coupling(commits: DataFrame, min_co_changes: int = 3, min_confidence: float = 0.5, max_files: int = 50, exclude: str | None = None) -> DataFrame:
    """Pairs of files that change together. Commits of more than max_files files are left out before exclusions.

    Pairs are made inside each commit's collected file list, which max_files bounds, so the commits are shuffled once and
    no self-join is needed. Supports and counts come from the same lists.
    """
    lists = commits.groupBy("hash").agg(F.sort_array(F.collect_set("file_path")).alias("files")).where(F.size("files") <= max_files)
    if exclude:
        lists = lists.withColumn("files", F.filter("files", lambda f: ~f.rlike(exclude)))
    pairs = lists.select(F.explode(F.expr("flatten(transform(files, (a, i) -> transform(slice(files, i + 2, size(files)), b -> struct(a AS file_a, b AS file_b))))")).alias("p"))
    pairs = pairs.groupBy("p.file_a", "p.file_b").agg(F.count("*").alias("co_changes")).where(F.col("co_changes") >= min_co_changes)
    counts = lists.select(F.explode("files").alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    out = pairs.join(counts.select(F.col("f").alias("file_a"), F.col("n").alias("n_a")), "file_a").join(counts.select(F.col("f").alias("file_b"), F.col("n").alias("n_b")), "file_b")
    a, b = F.col("co_changes") / F.col("n_a"), F.col("co_changes") / F.col("n_b")
    out = out.select("file_a", "file_b", "co_changes", a.alias("support_a"), b.alias("support_b"), F.greatest(a, b).alias("confidence"))
    return out.where(F.col("confidence") >= min_confidence)


def file_pairs(commits: DataFrame) -> DataFrame:
    """Ordered pairs of the files of each commit."""
    lists = commits.groupBy("hash").agg(F.sort_array(F.collect_set("file_path")).alias("files"))
    return lists.select("hash", F.explode(F.expr("flatten(transform(files, (a, i) -> transform(slice(files, i + 2, size(files)), b -> struct(a AS file_a, b AS file_b))))")).alias("p")).select("hash", "p.*")


def commit_groups(commits: DataFrame) -> DataFrame:
    """Each commit's sorted files, joined by commas."""
    return commits.groupBy("hash").agg(F.array_join(F.sort_array(F.collect_set("file_path")), ",").alias("files"))
