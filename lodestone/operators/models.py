"""Feature models, configuration checks and covering arrays.

Constraints are rows (kind, flags, source, ...) over parameters (name, kind, value_type, module, ...); configurations are
long: (config_id, name, value).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def colocated(items: DataFrame, cap: int = 10) -> DataFrame:
    """(a, b): names that share a module of at most `cap` items, made inside each module's list."""
    lists = items.groupBy("module").agg(F.sort_array(F.collect_set("name")).alias("ns")).where(F.size("ns") <= cap)
    pairs = F.expr("flatten(transform(ns, (a, i) -> transform(slice(ns, i + 2, size(ns)), b -> struct(a AS a, b AS b))))")
    return lists.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def required_by_edges(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): an item's module depends on another's."""
    i = items.select("name", "module").distinct()
    e = edges.select("source", "target").distinct()
    j = i.select(F.col("name").alias("a"), F.col("module").alias("source")).join(e, "source").join(i.select(F.col("name").alias("b"), F.col("module").alias("target")), "target")
    return j.where("a <> b").select("a", "b").distinct()


def built(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, flags): implies by co-location, requires by dependency, enum and range by the items themselves; each once."""
    implies = colocated(items).select(F.lit("implies").alias("kind"), F.array("a", "b").alias("flags"))
    requires = required_by_edges(items, edges).select(F.lit("requires").alias("kind"), F.array("a", "b").alias("flags"))
    own = items.select(F.when(F.size("enum_values") > 0, "enum").when(F.col("range_min").isNotNull(), "range").alias("kind"), F.array("name").alias("flags")).where("kind IS NOT NULL")
    return implies.unionByName(requires).unionByName(own).distinct()


def model_issues(items: DataFrame, constraints: DataFrame, registry: DataFrame) -> DataFrame:
    """(rule_id, name): what is wrong with a model; semi and anti joins over the exploded constraints.

    dead: a flag that excludes itself's requirement; always on: required by a flag that has no condition of its own;
    untested: implied pairs without a test; unused and unregistered: registry against use; missing: a requirement that
    doesn't exist; conflicting: a pair both required and excluded; dead setting: a setting that no module reads.
    """
    flags = items.where("kind = 'flag'").select("name").distinct()
    pair = constraints.where(F.size("flags") == 2).select("kind", F.col("flags")[0].alias("a"), F.col("flags")[1].alias("b"))
    sym = pair.where("kind IN ('mutex', 'excludes')")
    sym = sym.select("a", "b").unionAll(sym.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    requires = pair.where("kind = 'requires'").select("a", "b").distinct()
    rule = lambda df, r: df.select(F.lit(f"config/{r}").alias("rule_id"), "name").distinct()
    impossible = requires.join(sym, ["a", "b"], "left_semi")
    needed = requires.select(F.col("b").alias("name"))
    parts = [
        rule(impossible.select(F.col("a").alias("name")).join(flags, "name", "left_semi"), "dead-flag"),
        rule(constraints.where("kind = 'always'").select(F.explode("flags").alias("name")).join(flags, "name", "left_semi"), "always-on-flag"),
        rule(impossible.select(F.concat_ws(",", "a", "b").alias("name")), "conflicting-settings"),
        rule(needed.join(items.select("name"), "name", "left_anti"), "missing-dependency"),
        rule(registry.select("name").join(flags, "name", "left_anti"), "unused-registry-flag"),
        rule(flags.join(registry.select("name"), "name", "left_anti"), "unregistered-flag"),
        rule(items.where("kind = 'setting' AND module IS NULL").select("name"), "dead-setting"),
        rule(pair.where("kind = 'implies'").select(F.concat_ws(",", "a", "b").alias("name")), "untested-interaction"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def interaction_strength(constraints: DataFrame, arity: int = 3, neighbours: int = 3) -> DataFrame:
    """(name, arity, neighbours): flags in constraints of many flags, or with many distinct ones."""
    per = constraints.select("flags", F.explode("flags").alias("name"))
    out = per.groupBy("name").agg(F.max(F.size("flags")).cast("bigint").alias("arity"), F.size(F.array_except(F.array_distinct(F.flatten(F.collect_list("flags"))), F.array("name"))).cast("bigint").alias("neighbours"))
    return out.where((F.col("arity") >= arity) | (F.col("neighbours") >= neighbours))


def validated(configs: DataFrame, constraints: DataFrame) -> DataFrame:
    """(config_id, kind, flags): violated constraints of each configuration; a flag is on if its value is not false, 0 or empty.

    Each configuration's values become one map, so every constraint is checked against it in one row. constraints also have
    allowed (enum) and condition (name, value: conditional).
    """
    maps = configs.groupBy("config_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    j = maps.crossJoin(F.broadcast(constraints))  # a model's constraints: as many as its author wrote
    value = lambda i: F.try_element_at("m", F.get("flags", F.lit(i)))
    on = lambda v: F.coalesce(~F.lower(v).isin("", "0", "false", "off"), F.lit(False))
    active = F.size(F.filter("flags", lambda f: on(F.try_element_at("m", f))))
    bad = (
        F.when(F.col("kind") == "requires", on(value(0)) & ~on(value(1)))
        .when(F.col("kind").isin("mutex", "excludes"), active > 1)
        .when(F.col("kind") == "enum", value(0).isNotNull() & ~F.array_contains("allowed", value(0)))
        .when(F.col("kind") == "conditional", (F.try_element_at("m", F.col("when_name")) == F.col("when_value")) & value(0).isNull())
    )
    return j.where(F.coalesce(bad, F.lit(False))).select("config_id", "kind", F.array_join("flags", ",").alias("flags"))


def domains(items: DataFrame) -> DataFrame:
    """(name, value): flags are true or false, enums their values, ranges their ends."""
    values = (
        F.when(F.size("enum_values") > 0, F.col("enum_values"))
        .when(F.col("range_min").isNotNull(), F.array(F.col("range_min").cast("string"), F.col("range_max").cast("string")))
        .when(F.col("value_type") == "boolean", F.array(F.lit("true"), F.lit("false")))
    )
    return items.groupBy("name").agg(F.first(values, True).alias("vs")).select("name", F.explode("vs").alias("value")).distinct()


def tuples(domain: DataFrame, t: int = 2) -> DataFrame:
    """(names, values): every combination of values of t parameters."""
    out = domain.select(F.array("name").alias("names"), F.array("value").alias("vals"))
    for _ in range(t - 1):
        out = out.join(domain, F.col("name") > F.element_at("names", -1)).select(F.concat("names", F.array("name")).alias("names"), F.concat("vals", F.array("value")).alias("vals"))
    return out.select(F.array_join("names", ",").alias("names"), F.array_join("vals", ",").alias("vals"))


def covering_array(domain: Mapping[str, Sequence[str]], t: int = 2, feasible=lambda row: True) -> list[dict[str, str]]:
    """Rows that cover every feasible combination of t parameters' values: greedy growth, a parameter at a time.

    Sequential by nature and small: as many rows as a few values' products, whatever the data's size.
    """
    if not 2 <= t <= 6:
        raise ValueError("strength must be from 2 to 6")
    names = sorted(domain, key=lambda n: (-len(domain[n]), n))
    first = names[:t]
    rows = [dict(zip(first, v, strict=True)) for v in product(*(domain[n] for n in first))]
    rows = [r for r in rows if feasible(r)]
    for k, name in enumerate(names[t:], t):
        rest = {frozenset([*zip(c, v, strict=True), (name, x)]) for c in combinations(names[:k], t - 1) for v in product(*(domain[n] for n in c)) for x in domain[name]}
        rest = {s for s in rest if feasible(dict(s))}
        covers = lambda r, x: {s for s in rest if (name, x) in s and all(r.get(n) == v for n, v in s if n != name)}  # noqa: B023, E731
        for r in rows:
            ok = [x for x in domain[name] if feasible(r | {name: x})]
            if ok:
                r[name] = max(ok, key=lambda x: len(covers(r, x)))  # noqa: B023
                rest -= covers(r, r[name])
        while rest:
            s = dict(min(rest, key=sorted))
            host = next((r for r in rows if all(r.get(n, v) == v for n, v in s.items()) and feasible(r | s)), None)
            if host is None:
                rows.append(host := {})
            host |= s
            rest = {x for x in rest if not all(host.get(n) == v for n, v in x)}
    for r in rows:
        for n in names:
            if n not in r:
                r[n] = next((x for x in domain[n] if feasible(r | {n: x})), domain[n][0])
    return rows


def requirement_level(accesses: DataFrame) -> DataFrame:
    """(field, level): always if every access is plain, never if each is guarded and has a default, else conditional.

    accesses: (field, guarded, has_default).
    """
    per = accesses.groupBy("field").agg(
        F.bool_and(~F.col("guarded") & ~F.col("has_default")).alias("always"), F.bool_and(F.col("guarded") & F.col("has_default")).alias("never")
    )
    return per.select("field", F.when(F.col("always"), "always").when(F.col("never"), "never").otherwise("conditional").alias("level"))


def field_constraints(levels: DataFrame) -> DataFrame:
    """levels with a child's level no stricter than its parents': an ancestor that isn't always required makes it conditional.

    A field's ancestors are its dotted prefixes, so one join on them settles all depths at once.
    """
    prefixes = F.expr("transform(sequence(1, greatest(size(split(field, '[.]')) - 1, 1)), i -> array_join(slice(split(field, '[.]'), 1, i), '.'))")
    up = levels.where(F.instr("field", ".") > 0).select("field", F.explode(prefixes).alias("parent"))
    weak = up.join(levels.where("level <> 'always'").select(F.col("field").alias("parent")), "parent", "left_semi").select("field").distinct().withColumn("weak", F.lit(True))
    level = F.when(F.col("weak") & (F.col("level") == "always"), "conditional").otherwise(F.col("level"))
    return levels.join(weak, "field", "left").select("field", level.alias("level"))


def config_problems(configs: DataFrame, fields: DataFrame) -> DataFrame:
    """(config_id, field, problem): missing required fields, wrong types, unknown fields. fields: (field, level, value_type)."""
    ids = configs.select("config_id").distinct()
    have = configs.select("config_id", F.col("name").alias("field"), "value")
    want = ids.crossJoin(F.broadcast(fields.where("level = 'always'").select("field")))  # a schema's fields
    missing = want.join(have, ["config_id", "field"], "left_anti").withColumn("problem", F.lit("missing"))
    j = have.join(F.broadcast(fields.select("field", "value_type")), "field", "left")
    typed = F.when(F.col("value_type") == "number", F.col("value").rlike(r"^-?\d+(?:\.\d+)?$")).when(F.col("value_type") == "boolean", F.col("value").isin("true", "false")).otherwise(True)
    problem = F.when(F.col("value_type").isNull(), "unknown").when(~typed, "type")
    return missing.unionByName(j.select("config_id", "field", problem.alias("problem")).where("problem IS NOT NULL"))


def nearest_valid(configs: DataFrame, valid: DataFrame) -> DataFrame:
    """(config_id, nearest, distance): for each configuration the valid one that differs in the fewest values."""
    m = lambda d, n: d.groupBy(F.col("config_id").alias(n)).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias(f"m_{n}"))
    j = m(configs, "config").crossJoin(F.broadcast(m(valid, "nearest")))  # a catalogue of known configurations
    keys = F.array_union(F.map_keys("m_config"), F.map_keys("m_nearest"))
    d = F.size(F.filter(keys, lambda k: ~F.try_element_at("m_config", k).eqNullSafe(F.try_element_at("m_nearest", k)))).cast("bigint")
    w = Window.partitionBy("config").orderBy("distance", "nearest")
    return j.select("config", "nearest", d.alias("distance")).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("config").alias("config_id"), "nearest", "distance")


def cross_entities(accesses: DataFrame) -> DataFrame:
    """(entity_a, entity_b, n): entities read in the same function."""
    a = accesses.select("function", F.col("entity").alias("entity_a")).distinct()
    b = accesses.select("function", F.col("entity").alias("entity_b")).distinct()
    return a.join(b, "function").where("entity_a < entity_b").groupBy("entity_a", "entity_b").agg(F.count("*").alias("n"))
