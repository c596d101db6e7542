"""Facts from files: git output, manifests, SARIF, snapshots; stores that are exported and read again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.diagnostics import token


def git_log(lines: DataFrame) -> DataFrame:
    """(repo, hash, file_path) of `git log --name-only --format=%H` lines (repo, ord, line).

    A line of 40 hexadecimal digits begins a commit; a file belongs to the last one before it.
    """
    is_hash = F.col("line").rlike("^[0-9a-f]{40}$")
    w = Window.partitionBy("repo").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.withColumn("hash", F.last(F.when(is_hash, F.col("line")), ignorenulls=True).over(w))
    return filled.where(~is_hash & (F.trim("line") != "") & F.col("hash").isNotNull()).select("repo", "hash", F.col("line").alias("file_path"))


def last_commits(lines: DataFrame, n: int = 200) -> DataFrame:
    """git_log() of each repo's first n commits in the log, which git lists newest first."""
    is_hash = F.col("line").rlike("^[0-9a-f]{40}$")
    w = Window.partitionBy("repo").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return git_log(lines.withColumn("k", F.sum(is_hash.cast("int")).over(w)).where(F.col("k") <= n).drop("k"))


def name_status(lines: DataFrame) -> DataFrame:
    """(path, change) of `git diff --name-status` lines; a rename deletes one path and adds another."""
    p = F.split("line", "\t")
    code = F.substring(p[0], 1, 1)
    row = lambda path, change: F.struct(path.alias("path"), F.lit(change).alias("change"))
    moved = F.array(row(F.get(p, F.lit(1)), "deleted"), row(F.get(p, F.lit(2)), "added"))
    rows = (
        F.when(code == "R", moved).when(code == "C", F.array(row(F.get(p, F.lit(2)), "added"))).when(code == "A", F.array(row(F.get(p, F.lit(1)), "added")))
        .when(code == "D", F.array(row(F.get(p, F.lit(1)), "deleted"))).when(code.isin("M", "T"), F.array(row(F.get(p, F.lit(1)), "modified")))
    )
    return lines.select(F.explode(rows).alias("r")).select("r.*")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): files (path, content_hash) that were added, modified or deleted between two snapshots."""
    j = before.select("path", F.col("content_hash").alias("b")).join(after.select("path", F.col("content_hash").alias("a")), "path", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return j.select("path", change.alias("change")).where("change IS NOT NULL")


def changed_repos(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """(repo, head, previous): repos whose head isn't the recorded commit; previous is null on first sight."""
    j = current.join(recorded.select("repo", F.col("hash").alias("previous")), "repo", "left")
    return j.where(~F.col("head").eqNullSafe(F.col("previous"))).select("repo", "head", "previous")


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, content_hash) of whole source files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"))


IMPORT = r"""(?m)(?:\bfrom\s+|\bimport\s*\(\s*|\brequire\s*\(\s*|^\s*import\s+)["']([^"']+)["']"""
EXPORT = r"(?m)^\s*export\s+(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:class|const|enum|function|interface|let|type)\s+(\w+)"
DECLARED = r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(class|enum|function|interface|type)\s+(\w+)"
ENV_FLAG = r"process\.env\.((?:ENABLE|FEATURE|FF|FLAG)_[A-Z0-9_]+)"
EJS_SETTING = r"<%[=-]?\s*settings\.([\w.]+)"
LOG_CALL = r"""\b(?:console|log|logger)\.(debug|error|fatal|info|warn)\(\s*[`"']([^`"']+)"""


def import_specifiers(files: DataFrame) -> DataFrame:
    """(path, target) by regular expression; a full parser's facts can be given instead."""
    return files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1)))).alias("target"))


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target, resolved) of relative and aliased (@/) specifiers: candidates with extensions, by priority, that exist."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    joined = F.when(F.col("target").startswith("@/"), F.concat(F.lit("src/"), F.substring("target", 3, 4096))).when(F.col("target").startswith("."), F.concat_ws("/", folder, F.col("target")))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    plain = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    base = F.regexp_replace(F.array_join(plain, "/"), r"\.jsx?$", "")
    ends = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js"]
    c = imports.where(joined.isNotNull()).select("path", "target", F.posexplode(F.array(F.array_join(plain, "/"), *[F.concat(base, F.lit(e)) for e in ends[1:]])).alias("rank", "resolved"))
    found = c.join(files.select(F.col("path").alias("resolved")), "resolved", "left_semi")
    return found.groupBy(F.col("path").alias("source"), "target").agg(F.min_by("resolved", "rank").alias("resolved"))


def declared_symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name, exported) of top-level declarations, by regular expression."""
    kinds, names = (F.regexp_extract_all("content", F.lit(DECLARED), F.lit(g)) for g in (1, 2))
    d = files.select("path", F.regexp_extract_all("content", F.lit(EXPORT), F.lit(1)).alias("e"), F.explode(F.arrays_zip(kinds.alias("kind"), names.alias("name"))).alias("s"))
    return d.select("path", "s.kind", "s.name", F.array_contains("e", F.col("s.name")).alias("exported"))


def env_flags(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(ENV_FLAG), F.lit(1)))).alias("name"))


def template_settings(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(EJS_SETTING), F.lit(1)))).alias("name"))


def log_statements(files: DataFrame) -> DataFrame:
    """(path, severity, message) of log calls with a literal message."""
    level, message = (F.regexp_extract_all("content", F.lit(LOG_CALL), F.lit(g)) for g in (1, 2))
    return files.select("path", F.explode(F.arrays_zip(level.alias("severity"), message.alias("message"))).alias("x")).select("path", "x.*")


def manifests(files: DataFrame) -> DataFrame:
    """(path, name, package, kind) of package.json files (path, content); broken ones are skipped."""
    m = "map<string,string>"
    d = files.withColumn("d", F.from_json("content", f"struct<name:string,dependencies:{m},devDependencies:{m},peerDependencies:{m}>")).where("d IS NOT NULL")
    parts = [d.select("path", "d.name", F.explode(F.map_keys(f"d.{c}")).alias("package"), F.lit(k).alias("kind")) for c, k in (("dependencies", "dependency"), ("devDependencies", "dev"), ("peerDependencies", "peer"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sarif_results(documents: DataFrame) -> DataFrame:
    """(rule_id, level, message, fqn) of SARIF documents (a JSON string in log)."""
    place = "array<struct<logicalLocations:array<struct<fullyQualifiedName:string>>>>"
    kind = f"struct<runs:array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:{place}>>>>>"
    r = documents.select(F.explode(F.from_json("log", kind)["runs"]).alias("run")).select(F.explode("run.results").alias("r"))
    names = F.flatten(F.transform("r.locations", lambda x: F.transform(x.logicalLocations, lambda y: y.fullyQualifiedName)))
    return r.select(F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.message.text").alias("message"), F.array_join(names, "|").alias("fqn"))


VERSION = 2


def exported(spark: SparkSession, tables: dict[str, DataFrame], path: str, salt: str | None = None) -> None:
    """Writes tables and a manifest; with a salt, ids are hashed and symbols left out."""
    for name, df in tables.items():
        if salt is not None:
            if name == "symbols":
                continue
            df = df.select(*[token(F.col(c), salt).alias(c) if c in ("source", "target", "module", "path", "repo") else F.col(c) for c in df.columns])
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = {"version": VERSION, "anonymized": salt is not None, "tables": sorted(t for t in tables if salt is None or t != "symbols")}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def imported(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an export; an anonymised one or one of a newer version is refused."""
    m = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if m["anonymized"] or m["version"] > VERSION:
        raise ValueError("this export can't be imported: " + ("it is anonymised" if m["anonymized"] else f"version {m['version']}"))
    return {t: spark.read.parquet(f"{path}/{t}") for t in m["tables"]}
