"""Path rules, architecture rules, versions, patterns and fault rules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_pattern(pattern: str) -> str:
    """A glob as an anchored regular expression: ** any characters, * any but a slash, the rest literal."""
    if len(pattern) > 256 or len(re.findall(r"\*+", pattern)) > 10:
        raise ValueError(f"glob too long or too wild: {pattern[:40]}")
    return "^" + "".join({"**": ".*", "*": "[^/]*"}.get(p, re.sub(r"([\\^$.|?+()\[\]{}])", r"\\\1", p)) for p in re.split(r"(\*\*|\*)", pattern)) + "$"


def globbed(path: Column, patterns: Iterable[str]) -> Column:
    joined = "|".join(glob_pattern(p) for p in patterns)
    return path.rlike(joined) if joined else F.lit(False)


def layer(path: Column, layers: Mapping[str, Sequence[str]]) -> Column:
    """The last layer that matches."""
    out = None
    for name, patterns in reversed(list(layers.items())):
        out = F.when(globbed(path, patterns), name) if out is None else out.when(globbed(path, patterns), name)
    return out if out is not None else F.lit(None).cast("string")


def layer_violations(edges: DataFrame, layers: Mapping[str, Sequence[str]], allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Imports from one layer to another that isn't allowed from there; globs are compiled once into each row's expression."""
    e = edges.where("kind = 'imports'").withColumns({"from_layer": layer(F.col("source"), layers), "to_layer": layer(F.col("target"), layers)})
    ok = F.lit(False)
    for name, targets in allowed.items():
        ok = ok | ((F.col("from_layer") == name) & F.col("to_layer").isin(*targets))
    return e.where("from_layer <> to_layer").where(~ok).select("source", "target", "from_layer", "to_layer")


def forbidden_imports(edges: DataFrame, from_: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    return edges.where("kind = 'imports'").where(globbed(F.col("source"), from_) & globbed(F.col("target"), forbidden)).select("source", "target")


def denied_directions(edges: DataFrame, denied: Sequence[tuple[str, str]]) -> DataFrame:
    """A row for each denied pair that an import matches."""
    hits = F.array_compact(F.array(*[F.when(globbed(F.col("source"), [a]) & globbed(F.col("target"), [b]), f"{a} -> {b}") for a, b in denied]))
    return edges.where("kind = 'imports'").select("source", "target", F.explode(hits).alias("rule"))


def excluded(path: Column) -> Column:
    return path.rlike(r"(?:^|/)(?:\.next|build/output|dist|node_modules)/")


_KINDS = {"typescript": "cts mts ts tsx", "javascript": "cjs js jsx mjs", "json": "json", "yaml": "yaml yml", "markdown": "md mdx"}


def file_kind(path: Column) -> Column:
    """By what follows the last point, then Dockerfiles, then paths that name Kubernetes; a null path is unknown."""
    ext = F.lower(F.substring_index(path, ".", -1))
    out = F.when(path.isNull(), "unknown")
    for kind, names in _KINDS.items():
        out = out.when(ext.isin(*names.split()), kind)
    return out.when(path.rlike("[Dd]ockerfile"), "dockerfile").when(F.lower(path).rlike("k8s|kubernetes"), "kubernetes").otherwise("unknown")


def symbol_id(repo: Column, path: Column, symbol: Column | None = None) -> Column:
    file = F.concat_ws(":", repo, path)
    return file if symbol is None else F.concat_ws("#", file, symbol)


def parsed_id(ident: Column) -> Column:
    """(repo, path, symbol) of an id, cut at the first colon and the first hash after it."""
    has = F.instr(ident, ":") > 0
    rest = F.when(has, F.expr("substr({0}, instr({0}, ':') + 1)".format("__i"))).otherwise(F.col("__i"))
    hash_ = F.instr(rest, "#")
    return F.struct(
        F.when(has, F.substring_index(ident, ":", 1)).alias("repo"), F.when(hash_ > 0, F.substring_index(rest, "#", 1)).otherwise(rest).alias("path"),
        F.when(hash_ > 0, F.substring(rest, hash_ + 1, F.length(rest))).alias("symbol"),
    )


def with_parsed_id(df: DataFrame, column: str) -> DataFrame:
    d = df.withColumn("__i", F.col(column))
    return d.withColumn("__p", parsed_id(F.col("__i"))).select(*df.columns, "__p.*")


def _version(text: str) -> tuple[int, int, int]:
    m = re.match(r"[v=\s]*(\d+)(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?", text)
    return tuple(int(g) if g and g.isdigit() else 0 for g in m.groups()) if m else (0, 0, 0)


def satisfies(version: str, wanted: str) -> bool:
    """Whether a version is in a range: comparators joined by blanks, alternatives by ||, carets, tildes, wildcards, hyphens."""
    v = _version(version)
    for part in wanted.split("||"):
        part = re.sub(r"(\S+)\s+-\s+(\S+)", r">=\1 <=\2", part.strip())
        part = re.sub(r"([<>=^~]+)\s+", r"\1", part)
        ok = True
        for c in part.split() or ["*"]:
            op, text = re.match(r"([<>=^~]*)(.*)", c).groups()
            w = _version(text)
            given = re.findall(r"\d+|[xX*]", text.split("-")[0])[:3]
            known = sum(g.isdigit() for g in given)
            if op == "^":
                k = next((i for i in range(3) if w[i]), max(known - 1, 0))
                ok &= w <= v < (*w[:k], w[k] + 1, *(0,) * (2 - k))
            elif op == "~" or (op in ("", "=") and known < 3):
                k = min(max(known - 1, 0), 1) if op == "~" else known - 1
                ok &= known == 0 or w <= v < (*w[:k], w[k] + 1, *(0,) * (2 - k))
            else:
                ok &= {"": v == w, "=": v == w, ">": v > w, ">=": v >= w, "<": v < w, "<=": v <= w}.get(op, False)
        if ok:
            return True
    return False


def version_in(version: Column, wanted: Column) -> Column:
    """satisfies() as a column: vectorised, each distinct pair computed once a batch."""

    def run(v: pd.Series, w: pd.Series) -> pd.Series:
        known = {p: satisfies(*p) for p in set(zip(v, w, strict=True))}
        return pd.Series([known[p] for p in zip(v, w, strict=True)], dtype=bool)

    return F.pandas_udf(run, "boolean")(version, wanted)


def matched_advisories(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Installed packages whose version is in an advisory's range."""
    return packages.join(advisories, "package").where(version_in(F.col("version"), F.col("range")))


def audit_rows(reports: DataFrame) -> DataFrame:
    """(package, severity, range) of npm audit reports (a JSON string in report), of either format; broken ones are skipped."""
    entry = "struct<name:string,module_name:string,severity:string,range:string,vulnerable_versions:string>"
    d = reports.select(F.from_json("report", f"struct<vulnerabilities:map<string,{entry}>,advisories:map<string,{entry}>>").alias("d"))
    rows = d.select(F.explode(F.concat(F.coalesce(F.map_values("d.vulnerabilities"), F.array()), F.coalesce(F.map_values("d.advisories"), F.array()))).alias("a"))
    level = F.when(F.col("a.severity").isin("critical", "high"), "error").when(F.col("a.severity") == "moderate", "warning").otherwise("note")
    return rows.select(F.coalesce("a.name", "a.module_name").alias("package"), level.alias("level"), F.coalesce("a.range", "a.vulnerable_versions").alias("range"))


_SUFFIXES = {"adapter": "Adapter", "decorator": "Decorator", "facade": "Facade", "factory": "Factory", "middleware": "Middleware", "repository": "Repository"}


def patterns(symbols: DataFrame) -> DataFrame:
    """(module, name, pattern, confidence): design patterns by names and by the methods of classes.

    symbols: (module, name, kind, container). Classes and their methods meet in one aggregate by container, no join.
    """
    out = None
    for pattern, suffix in _SUFFIXES.items():
        kinds = ["class"] if pattern == "factory" else ["class", "interface"]
        rows = symbols.where(F.col("kind").isin(*kinds) & F.col("name").endswith(suffix)).select("module", "name", F.lit(pattern).alias("pattern"), F.lit(0.7).alias("confidence"))
        out = rows if out is None else out.unionByName(rows)
    m = symbols.where("kind = 'method' AND container IS NOT NULL").groupBy("module", F.col("container").alias("name"))
    per = m.agg(F.collect_set("name").alias("ms"))
    some = lambda p: F.exists("ms", lambda x: x.rlike(p))
    found = F.array_compact(
        F.array(
            F.when(some("^getInstance$"), F.struct(F.lit("singleton").alias("pattern"), F.lit(0.8).alias("confidence"))),
            F.when(some("^(?:on|subscribe)$") & some("^(?:emit|notify)"), F.struct(F.lit("observer").alias("pattern"), F.lit(0.75).alias("confidence"))),
            F.when(some("^build$") & (F.size(F.filter("ms", lambda x: x.rlike("^(?:set|with)[A-Z]"))) >= 2), F.struct(F.lit("builder").alias("pattern"), F.lit(0.75).alias("confidence"))),
        )
    )
    classes = per.select("module", "name", F.explode(found).alias("f")).select("module", "name", "f.*")
    strategies = per.where(F.col("name").endswith("Strategy") & some("^(?:apply|execute|run)$")).select("module", "name")
    several = strategies.groupBy("module").agg(F.collect_list("name").alias("names")).where(F.size("names") >= 2)
    strategies = several.select("module", F.explode("names").alias("name"), F.lit("strategy").alias("pattern"), F.lit(0.6).alias("confidence"))
    return out.unionByName(classes).unionByName(strategies)


def nest_role(decorators: Column) -> Column:
    out = None
    for name in ("Module", "Controller", "Resolver", "Gateway", "Injectable"):
        out = F.when(F.array_contains(decorators, name), name.lower()) if out is None else out.when(F.array_contains(decorators, name), name.lower())
    return out


LOGGING = r"(?i)\b(?:console|log|logger)\.(?:error|fatal|log|warn)|captureException"


def error_gaps(catches: DataFrame, reachable: DataFrame) -> DataFrame:
    """(function_id, node, rule): catch nodes that reach nothing are silent; those without a log, throw, return or forward are unhandled."""
    r = reachable.groupBy("function_id", F.col("start").alias("node")).agg(
        F.count("*").alias("n"), F.bool_or(F.col("label").rlike(LOGGING) | F.col("label").rlike(r"\bthrow\b|\breturn\b|\breject\(|\bnext\(")).alias("handled")
    )
    j = catches.join(r, ["function_id", "node"], "left")
    rule = F.when(F.col("n").isNull(), "fault/silent-failure").when(~F.col("handled"), "fault/unhandled-error-path")
    return j.select("function_id", "node", rule.alias("rule_id")).where("rule_id IS NOT NULL")


def function_faults(nodes: DataFrame) -> DataFrame:
    """(function_id, rule_id): cascades, missing timeouts, hasty retries, unchecked nulls and boundaries, in one aggregate."""
    has = lambda p: F.bool_or(F.col("label").rlike(p))
    per = nodes.groupBy("function_id").agg(
        (F.count_if(F.col("label").rlike(r"\bawait\b.*\.(?:get|post|request|send)\(")) >= 3).alias("many"),
        has(r"\b(?:axios|fetch|http\.request)\b").alias("http"), has(r"(?i)timeout|AbortController|signal").alias("timeout"),
        has(r"(?i)\bretr(?:y|ies)\b|attempt").alias("retry"), has(r"(?i)backoff|delay|sleep|setTimeout").alias("wait"),
        has(r"\.(?:find|findOne|get)\(").alias("lookup"), has(r"\?\.|!= ?null|!== ?null|=== ?undefined|\?\?").alias("checked"),
        has(r"\bcatch\b").alias("caught"), has(r"\bawait\b").alias("awaits"),
    )
    rules = F.array_compact(
        F.array(
            F.when(F.col("many") & ~F.col("caught"), "fault/cascading-failure-risk"),
            F.when(F.col("http") & ~F.col("timeout"), "fault/timeout-missing"),
            F.when(F.col("retry") & ~F.col("wait"), "fault/retry-without-backoff"),
            F.when(F.col("lookup") & ~F.col("checked"), "fault/unchecked-null-return"),
            F.when(F.col("awaits") & ~F.col("caught"), "fault/missing-error-boundary"),
        )
    )
    return per.select("function_id", F.explode(rules).alias("rule_id"))
