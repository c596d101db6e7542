"""Module and repository metrics over import edges and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABSTRACT_KINDS = ("interface", "type")


def is_barrel(path: Column) -> Column:
    """Index files, which re-export others."""
    return path.rlike(r"(?:^|[/\\])index\.[jt]sx?$")


def zone(instability: Column, abstractness: Column, distance: Column) -> Column:
    return (
        F.when((instability < 0.3) & (abstractness < 0.3), "pain")
        .when((instability > 0.7) & (abstractness > 0.7), "uselessness")
        .when(distance < 0.3, "main-sequence")
        .otherwise("balanced")
    )


def module_metrics(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, module, ca, ce, instability, abstractness, distance, zone) of each import endpoint or parsed file of a repo.

    Both couplings and the symbol counts come from one aggregation by module over a union, not from joins.
    """
    pairs = edges.where("kind = 'imports'").select("repo", "source", "target").distinct()
    zero = F.lit(0).cast("bigint")
    top = F.col("container").isNull() if "container" in symbols.columns else F.lit(True)
    abstract = F.col("kind").isin(*ABSTRACT_KINDS)
    if "is_abstract" in symbols.columns:
        abstract = abstract | F.coalesce("is_abstract", F.lit(False))
    ends = F.explode(F.array(F.struct(F.col("source").alias("module"), F.lit(0).alias("into")), F.struct(F.col("target").alias("module"), F.lit(1).alias("into"))))
    touched = pairs.select("repo", ends.alias("e")).select(
        "repo", "e.module", F.col("e.into").cast("bigint").alias("ca"), (1 - F.col("e.into")).cast("bigint").alias("ce"), zero.alias("syms"), zero.alias("abst")
    )
    parsed = symbols.select(
        "repo", F.col("path").alias("module"), zero.alias("ca"), zero.alias("ce"), top.cast("bigint").alias("syms"), (top & abstract).cast("bigint").alias("abst")
    )
    per = touched.unionByName(parsed).groupBy("repo", "module").agg(*[F.sum(c).alias(c) for c in ("ca", "ce", "syms", "abst")])
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(b == 0, 1).otherwise(b))
    out = per.select("repo", "module", "ca", "ce", ratio(F.col("ce"), F.col("ca") + F.col("ce")).alias("instability"), ratio(F.col("abst"), F.col("syms")).alias("abstractness"))
    out = out.withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1.0))
    return out.withColumn("zone", zone(F.col("instability"), F.col("abstractness"), F.col("distance")))


def repo_summary(metrics: DataFrame) -> DataFrame:
    """Averages and zone counts per repo; internal modules are those whose id begins with the repo's name and a colon."""
    inside = F.expr("startswith(module, concat(repo, ':'))")
    return metrics.groupBy("repo").agg(
        F.count("*").alias("module_count"),
        *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("instability", "abstractness", "distance")],
        F.count_if(F.col("zone") == "pain").alias("pain_count"),
        F.count_if(F.col("zone") == "uselessness").alias("useless_count"),
        F.count_if(inside).alias("internal_count"),
        F.count_if(inside & (F.col("zone") == "pain")).alias("internal_pain"),
        F.count_if(inside & (F.col("zone") == "uselessness")).alias("internal_useless"),
    )


def unstable_dependencies(edges: DataFrame, metrics: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per source: its import edges whose target is less stable by more than the threshold; parallel edges count."""
    m = metrics.select("repo", "module", "instability")
    src = m.withColumnsRenamed({"module": "source", "instability": "src_instability"})
    tgt = m.withColumnsRenamed({"module": "target", "instability": "tgt_instability"})
    joined = edges.where("kind = 'imports'").where(~is_barrel(F.col("target"))).join(src, ["repo", "source"]).join(tgt, ["repo", "target"])
    delta = F.col("tgt_instability") - F.col("src_instability")
    return joined.where(delta > threshold).groupBy("repo", "source").agg(F.count("*").alias("violations"), F.round(F.max(delta), 6).alias("max_delta"))


def zone_findings(metrics: DataFrame) -> DataFrame:
    """Internal modules in a bad zone; those of pain need dependants and are no barrels."""
    inside = metrics.where("startswith(module, concat(repo, ':'))")
    pain = inside.where((F.col("zone") == "pain") & (F.col("ca") > 0) & ~is_barrel(F.col("module"))).select("repo", "module", F.lit("structural/pain-zone-module").alias("rule_id"))
    useless = inside.where(F.col("zone") == "uselessness").select("repo", "module", F.lit("structural/uselessness-zone-module").alias("rule_id"))
    return pain.unionByName(useless)


def dead_exports(edges: DataFrame, symbols: DataFrame, entry_points: DataFrame | None = None) -> DataFrame:
    """Files with exported symbols that no import of their repo targets, with the number of dead exports."""
    imported = edges.where("kind = 'imports'").select("repo", F.col("target").alias("path")).distinct()
    files = symbols.where("exported").groupBy("repo", "path").agg(F.count("*").alias("dead_exports"))
    files = files.join(imported, ["repo", "path"], "left_anti")
    return files.join(entry_points, ["repo", "path"], "left_anti") if entry_points is not None else files


def structural_health(summary: DataFrame) -> DataFrame:
    """Ratings by mean distance (.2/.4) and by the shares of modules in pain (10/25 %) and uselessness (5/15 %)."""
    rate = lambda x, a, b: F.when(x < a, "good").when(x < b, "warning").otherwise("critical")
    n = F.greatest(F.col("module_count"), F.lit(1))
    pain, useless = F.col("pain_count") / n, F.col("useless_count") / n
    return summary.select(
        "repo",
        rate(F.col("avg_distance"), 0.2, 0.4).alias("distance_rating"),
        rate(pain, 0.10, 0.25).alias("pain_rating"),
        rate(useless, 0.05, 0.15).alias("useless_rating"),
    )


def dependency_matrix(edges: DataFrame, top: int = 80) -> DataFrame:
    """The dependency structure matrix in long form: edge counts between the `top` modules of highest degree."""
    imports = edges.where("kind = 'imports'").select("source", "target")
    ends = imports.select(F.explode(F.array("source", "target")).alias("module"))
    best = F.broadcast(ends.groupBy("module").count().orderBy(F.desc("count"), "module").limit(top).select("module"))  # `top` rows
    kept = imports.join(best.withColumnRenamed("module", "source"), "source", "left_semi").join(best.withColumnRenamed("module", "target"), "target", "left_semi")
    return kept.groupBy("source", "target").agg(F.count("*").alias("n"))


def report_metrics(metrics: DataFrame) -> DataFrame:
    """Per repo: quartiles, linearly interpolated, of distance and instability, to 4 places."""
    quart = lambda c: F.expr(f"percentile({c}, array(0.0, 0.25, 0.5, 0.75, 1.0))")
    per = metrics.groupBy("repo").agg(F.count("*").alias("modules"), quart("distance").alias("d"), quart("instability").alias("i"))
    pick = [F.round(F.col(a)[k], 4).alias(f"{n}_{q}") for a, n in (("d", "distance"), ("i", "instability")) for k, q in enumerate(("min", "q1", "median", "q3", "max"))]
    return per.select("repo", "modules", *pick)


def report_graph(edges: DataFrame) -> DataFrame:
    """Per edge kind: edges, nodes, and the mean fan, edges over nodes, to 4 places."""
    counts = edges.groupBy("kind").agg(F.count("*").alias("edges"))
    nodes = edges.select("kind", F.explode(F.array("source", "target")).alias("node")).distinct().groupBy("kind").agg(F.count("*").alias("nodes"))
    return counts.join(nodes, "kind").withColumn("avg_fan", F.round(F.col("edges") / F.col("nodes"), 4))
