"""Relations between repositories: services, flags, catalogs, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.store import first_wins


def repo_of(node: Column) -> Column:
    return F.when(F.instr(node, ":") > 0, F.substring_index(node, ":", 1))


def package_of(target: Column) -> Column:
    """The package of an import specifier; null for relative and absolute paths and URLs."""
    parts = F.split(target, "/")
    scoped = F.when(F.size(parts) > 1, F.concat_ws("/", parts[0], F.get(parts, F.lit(1))))
    return F.when(target.rlike(r"^(?:\.|/|[a-zA-Z][\w+.-]*:)"), None).otherwise(F.when(target.startswith("@"), scoped).otherwise(parts[0]))


def service_links(calls: DataFrame) -> DataFrame:
    """Per endpoint: producing, consuming and linked repos, criticality, whether it is a linchpin, whether orphaned.

    calls: (source, endpoint, role, repo); any role but producer consumes.
    """
    producer = F.col("role") == "producer"
    per = calls.groupBy("endpoint").agg(
        F.count_distinct(F.when(producer, F.col("repo"))).alias("producers"),
        F.count_distinct(F.when(~F.coalesce(producer, F.lit(False)), F.col("repo"))).alias("consumers"),
        F.count_distinct("repo").alias("repos"),
    )
    both = F.col("producers") + F.col("consumers")
    return per.withColumns({"criticality": both * F.col("repos"), "linchpin": (F.col("repos") >= 2) & (both >= 2), "orphan": (F.col("producers") > 0) != (F.col("consumers") > 0)})


def orphaned_services(links: DataFrame) -> DataFrame:
    """Orphans that aren't templates, local addresses or other parties' interfaces."""
    return links.where("orphan").where(~F.col("endpoint").rlike(r"[{}$]|localhost|127\.0\.0\.1|^external-api"))


def service_pairs(calls: DataFrame) -> DataFrame:
    """(endpoint, producer, consumer): repos that an endpoint joins."""
    rows = calls.select("endpoint", "repo", (F.col("role") == "producer").alias("p")).distinct()
    a = rows.where("p").select("endpoint", F.col("repo").alias("producer"))
    b = rows.where("NOT p").select("endpoint", F.col("repo").alias("consumer"))
    return a.join(b, "endpoint").where("producer <> consumer")


def package_linchpins(cross: DataFrame) -> DataFrame:
    """Packages (package, source_repo) that two repos at least import; score is importers times edges."""
    per = cross.groupBy("package").agg(F.count_distinct("source_repo").alias("importers"), F.count("*").alias("edges"))
    return per.where("importers >= 2").withColumn("score", F.col("importers") * F.col("edges"))


def breaking_targets(edges: DataFrame, repos: int = 3) -> DataFrame:
    """Modules that at least so many other repos depend on."""
    cross = edges.where(repo_of(F.col("source")) != repo_of(F.col("target")))
    return cross.groupBy("target").agg(F.count_distinct(repo_of(F.col("source"))).alias("repos")).where(F.col("repos") >= repos)


def shared_flags(flags: DataFrame, pairs: DataFrame) -> DataFrame:
    """(name, repos, coordinated): flags of several repos; coordinated if a dependency joins any two of them."""
    own = flags.select("name", "repo").distinct()
    per = own.groupBy("name").agg(F.count("*").alias("repos")).where("repos > 1")
    either = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    two = own.withColumnRenamed("repo", "a").join(own.withColumnRenamed("repo", "b"), "name").where("a < b")
    joined = two.join(either, ["a", "b"], "left_semi").select("name").distinct().withColumn("c", F.lit(True))
    return per.join(joined, "name", "left").select("name", "repos", F.coalesce("c", F.lit(False)).alias("coordinated"))


def flag_modules(flags: DataFrame) -> DataFrame:
    return flags.groupBy("repo", "name").agg(F.count_distinct("module").alias("modules"), F.count("*").alias("locations"))


def inventory(items: DataFrame, search: str | None = None, repo: str | None = None, kind: str | None = None, scope: str | None = None, registered: bool | None = None) -> DataFrame:
    """Flags or parameters whose name contains the search string, whatever its case."""
    if search:
        items = items.where(F.contains(F.lower("name"), F.lit(search.lower())))
    for c, v in (("repo", repo), ("kind", kind), ("scope", scope), ("is_registry", registered)):
        if v is not None:
            items = items.where(F.col(c) == v)
    return items


def enriched(flags: DataFrame, registry: DataFrame) -> DataFrame:
    """flags with is_registry and description from the registry (ord, name, description), whose last row of a name counts."""
    r = registry.groupBy("name").agg(F.max_by("description", F.struct("ord", "description")).alias("description"))
    return flags.join(r.withColumn("is_registry", F.lit(True)), "name", "left").withColumn("is_registry", F.coalesce("is_registry", F.lit(False)))


def catalog_links(catalog: DataFrame, links: DataFrame) -> DataFrame:
    """(name, endpoint, documented): catalog entries with the links (endpoint, repo, p) of their repo, and linked repos without one."""
    known = catalog.join(links, catalog["name"] == links["repo"], "left").select("name", "endpoint", F.lit(True).alias("documented"))
    lost = links.where("NOT p").join(catalog, links["repo"] == catalog["name"], "left_anti").select(F.col("repo").alias("name"), "endpoint", F.lit(False).alias("documented"))
    return known.unionByName(lost)


def resolved_repos(edges: DataFrame, known: DataFrame, roots: DataFrame) -> DataFrame:
    """edges with target_repo: the id's repo if known, else the edge's own target_repo, else that of the package's last root (ord, package, repo); URLs have none."""
    names = known.select(F.col("repo").alias("k")).distinct()
    r = roots.groupBy("package").agg(F.max_by("repo", F.struct("ord", "repo")).alias("root_repo"))
    e = edges.withColumn("__id", repo_of(F.col("target"))).withColumn("package", package_of(F.col("target")))
    e = e.where(~F.col("target").rlike("^[a-zA-Z][a-zA-Z+.-]*://")).join(names, F.col("__id") == F.col("k"), "left").join(r, "package", "left")
    own = F.col("target_hint") if "target_hint" in edges.columns else F.lit(None)
    return e.withColumn("target_repo", F.coalesce("k", own, "root_repo")).where("target_repo IS NOT NULL AND target_repo <> repo").select(*edges.columns, "target_repo")


def resolved_symbols(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """(source, package, imported, path, symbol): each imported name's export, the best candidate by priority.

    A named import takes the export of its name outside barrels, then in them; default takes a default export, else the
    first; a star takes all.
    """
    names = imports.select("source", "package", F.explode("names").alias("imported"))
    c = names.join(exports, "package")
    rank = (
        F.when(F.col("imported") == "*", 0).when(F.col("imported") == F.col("symbol"), F.when(F.col("barrel"), 2).otherwise(1)).when(F.col("imported") == "default", 3)
    )
    c = c.withColumn("rank", rank).where("rank IS NOT NULL")
    star = c.where("imported = '*'").select("source", "package", "imported", "path", "symbol")
    w = Window.partitionBy("source", "package", "imported").orderBy("rank", "ordinal")
    one = c.where("imported <> '*'").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("source", "package", "imported", "path", "symbol")
    return star.unionByName(one)


def symbol_importers(imports: DataFrame, symbol: str, package: str | None = None) -> DataFrame:
    """(repo, importers): imports whose resolved symbols have the name or, without any, whose names have."""
    kept = imports if package is None else imports.where(F.col("package") == package)
    has = F.when(F.size(F.coalesce("resolved", F.array())) > 0, F.array_contains("resolved", symbol)).otherwise(F.array_contains("names", symbol))
    return kept.where(has).groupBy("repo").agg(F.count("*").alias("importers"))


def connections(edges: DataFrame, packages: DataFrame, states: DataFrame) -> DataFrame:
    """(repo, kind, n): repos that edges lead to, through the package map (last wins), unless indexed, ignored or in work."""
    m = packages.groupBy("package").agg(F.max_by("repo", "ordinal").alias("target_repo"))
    busy = states.where(F.col("status").isin("ignored", "indexed", "indexing")).select(F.col("name").alias("target_repo"))
    e = edges.withColumn("package", package_of(F.col("target"))).join(m, "package").join(busy, "target_repo", "left_anti")
    return e.groupBy(F.col("target_repo").alias("repo"), "kind").agg(F.count("*").alias("n"))


def repo_dependencies(manifests: DataFrame, packages: DataFrame) -> DataFrame:
    """(repo, target_repo, kind): by package.json dependencies (repo, package, kind); of several kinds the first of the order counts."""
    m = packages.groupBy("package").agg(F.max_by("repo", "ordinal").alias("target_repo"))
    rank = F.when(F.col("kind") == "dependency", 0).when(F.col("kind") == "dev", 1).otherwise(2)
    return manifests.join(m, "package").where("repo <> target_repo").groupBy("repo", "target_repo").agg(F.min_by("kind", rank).alias("kind"))


def reflexion(hypothesis: DataFrame, extracted: DataFrame) -> DataFrame:
    """(a, b, verdict): dependencies that both have converge, unexpected ones diverge, missing ones are absent."""
    h, x = hypothesis.select("a", "b").distinct().withColumn("h", F.lit(1)), extracted.select("a", "b").distinct().withColumn("x", F.lit(1))
    verdict = F.when(F.col("h").isNull(), "divergence").when(F.col("x").isNull(), "absence").otherwise("convergence")
    return h.join(x, ["a", "b"], "full_outer").select("a", "b", verdict.alias("verdict"))


def under_roots(edges: DataFrame, services: DataFrame) -> DataFrame:
    """(service, target): what files under a service's root import from outside it.

    The prefix test becomes equality: a file's ancestor folders are exploded and joined to the roots.
    """
    folders = F.expr("transform(sequence(1, greatest(size(split(source, '/')) - 1, 1)), i -> array_join(slice(split(source, '/'), 1, i), '/'))")
    e = edges.withColumn("root", F.explode(folders)).join(services.select(F.col("name").alias("service"), "root"), "root")
    return e.where(~F.col("target").startswith(F.concat("root", F.lit("/")))).select("service", "target").distinct()


FRONTEND, SERVER, LIBRARY = r"^(?:@angular/|next|react|svelte|vue)", r"^(?:@hapi/|express|fastify|koa)", r"(?i)(?:common|helpers|lib|sdk|shared|types|utils)"


def architecture(edges: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(repo, imports, calls, services, role): counts of a repo's edges, and the role that they suggest.

    edges: (repo, target, kind, role, protocol); packages: (repo, fan_in), the repos whose package others import.
    """
    imp, svc = F.col("kind") == "imports", F.col("kind") == "service-call"
    hit = lambda p: F.bool_or(imp & F.col("target").rlike(p))
    per = edges.groupBy("repo").agg(
        F.count_if(imp).alias("imports"),
        F.count_if(F.col("kind") == "calls").alias("calls"),
        F.count_if(svc).alias("services"),
        F.count_if(F.col("protocol") == "http").alias("http"),
        F.count_if(svc & (F.col("role") == "producer")).alias("p"),
        F.count_if(svc & (F.col("role") == "consumer")).alias("c"),
        hit(FRONTEND).alias("front"),
        hit(SERVER).alias("server"),
        hit("^@nestjs/").alias("nest"),
        F.count_if(imp & F.col("target").startswith("node:")).alias("node"),
    )
    per = per.join(packages, "repo", "left") if packages is not None else per.withColumn("fan_in", F.lit(None).cast("bigint"))
    none, lib = (F.col("p") + F.col("c")) == 0, F.col("repo").rlike(LIBRARY)
    role = (
        F.when(F.col("front") & (F.col("http") > 0) & (F.col("c") == 0), "frontend")
        .when(F.col("front") & (F.col("services") == 0) & ~lib, "frontend")
        .when((F.coalesce("fan_in", F.lit(0)) >= 3) & none, "shared-library")
        .when(none & lib, "shared-library")
        .when(F.col("server") | F.col("nest") | ~none, "backend-service")
        .when((F.col("node") >= 3) & ~F.col("front"), "backend-service")
        .otherwise("unknown")
    )
    return per.select("repo", "imports", "calls", "services", role.alias("role"))


def vulnerable_importers(edges: DataFrame, advisories: DataFrame) -> DataFrame:
    """(package, source): modules that import an advisory's package, by the target's derived package."""
    return edges.where("kind = 'imports'").withColumn("package", package_of(F.col("target"))).join(advisories.select("package").distinct(), "package", "left_semi").select("package", "source").distinct()


def highest_tier(summaries: DataFrame) -> DataFrame:
    """Each entity's summary of the highest tier."""
    return summaries.groupBy("entity_id").agg(F.max_by(F.struct("tier", "description", "confidence"), "tier").alias("s")).select("entity_id", "s.*")


def deduplicated(findings: DataFrame) -> DataFrame:
    return first_wins(findings, ["fp"], "ord")
