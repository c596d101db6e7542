"""Graph operators: set-at-a-time loops over edge tables.

A loop's step is one join of the frontier with the edges and one anti join with what was visited; each step's new rows are
written once to the shared folder. Only emptiness, scalars and broadcast frontiers reach the driver. Frontiers are small beside
the edges, so the join is a broadcast whenever the frontier's measured size allows it and a shuffle otherwise; what was visited
is never broadcast. Loops of many rounds end in one task as soon as it can hold what is left (kernels).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import kernels
from lodestone.operators.tables import Grown, written


LOCAL = 16_000_000  # edges that one Python task searches as numbers; a quarter of them as names


def _apart(df: DataFrame) -> DataFrame:
    """df as a side of a join that must not pass through the driver: its rows grow with the graph."""
    return df.hint("merge")


def forward(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b"))


def backward(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("a"), F.col("source").alias("b"))


def levels(steps: DataFrame, seeds: DataFrame, max_depth: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, node, depth): what each key's seeds reach over steps (a, b), with the least number of steps.

    A search of any depth from one set of seeds takes one task if that can hold the steps, as rounds may be many and each reads
    all that was seen before.
    """
    on = [*keys, "node"]
    steps = written(steps.select("a", "b").distinct())
    seen = Grown(seeds.select(*on).distinct().withColumn("depth", F.lit(0).cast("bigint")))
    if max_depth is None and not keys and steps.count() <= LOCAL:
        return _searched(steps, seen)
    frontier, depth = seen.table(), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = frontier.join(steps, F.col("node") == F.col("a")).select(*keys, F.col("b").alias("node")).distinct()
        fresh = reached.join(_apart(seen.table()), on, "left_anti").withColumn("depth", F.lit(depth).cast("bigint"))
        frontier = seen.add(fresh)
        if frontier.isEmpty():
            break
    return seen.table()


def _searched(steps: DataFrame, seen: Grown) -> DataFrame:
    """seen's seeds and all that they reach, in one task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [*batches]
        if sum(b.num_rows for b in held):
            a, b, seeds = (np.concatenate([h.column(i).to_numpy(zero_copy_only=False) for h in held]) for i in range(3))
            held.clear()
            (a, b), first = kernels.dense(a, b)
            n = int(first[-1])
            depth = kernels.depths(kernels.Links(a[~seeds], b[~seeds], n), a[seeds], n)
            found = np.flatnonzero(depth > 0)
            for at in range(0, len(found), 100_000):
                some = found[at : at + 100_000]
                yield pa.record_batch([pa.array(kernels.sparse(some, first)), pa.array(depth[some])], ["id", "depth"])

    nodes, links = _linked(steps.where("a IS NOT NULL"), nulls=True)
    seeds = nodes.join(_apart(seen.table().select("node")), "node", "left_semi").select(F.col("id").alias("from"), F.col("id").alias("to"), F.lit(True).alias("seed"))
    rows = links.select("from", "to", F.lit(False).alias("seed")).unionAll(seeds)
    found = rows.repartition(1).mapInArrow(search, "id bigint, depth bigint")
    seen.add(nodes.join(_apart(found), "id").select("node", "depth"))
    return seen.table()


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """The distinct edges out of the nodes that are at most max_depth steps away."""
    near = levels(forward(edges), seeds, max_depth).select(F.col("node").alias("source"))
    return edges.join(near, "source", "left_semi").select("source", "target", "kind").distinct()


def transitive(edges: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """(node, depth) reached from the seeds, without them."""
    return levels(forward(edges), seeds, max_depth).where("depth > 0")


def dependencies_and_dependents(edges: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """(direction, node, depth) over imports, without the start."""
    imports = edges.where("kind = 'imports'")
    out = [("dependency", forward(imports)), ("dependent", backward(imports))]
    a, b = (levels(s, seeds, max_depth).where("depth > 0").select(F.lit(n).alias("direction"), "node", "depth") for n, s in out)
    return a.unionByName(b)


def blast_radius(edges: DataFrame, seeds: DataFrame, max_depth: int = 5, calls: bool = True) -> DataFrame:
    """(node, depth, via) of what depends on the seeds, seeds aside.

    via tells by which kinds a node is reached: all its edges to nodes above max_depth count, not just the first found.
    """
    kept = edges.where(F.col("kind").isin("imports", "calls") if calls else F.col("kind") == "imports").select("source", "target", "kind").distinct()
    found = levels(backward(kept), seeds, max_depth)
    inner = found.where(F.col("depth") < max_depth).select(F.col("node").alias("target"))
    kinds = kept.join(inner, "target", "left_semi").groupBy(F.col("source").alias("node"))
    kinds = kinds.agg(F.bool_or(F.col("kind") == "imports").alias("i"), F.bool_or(F.col("kind") == "calls").alias("c"))
    via = F.when(F.col("i") & F.col("c"), "both").when(F.col("i"), "imports").otherwise("calls")
    return found.where("depth > 0").join(kinds, "node").select("node", "depth", via.alias("via"))


def resolved_seeds(edges: DataFrame, wanted: DataFrame, hits: DataFrame) -> DataFrame:
    """Seeds that nothing depends on give way to the file of their best search hit (node, hit), if there is one."""
    known = edges.select(F.col("target").alias("node")).distinct().withColumn("known", F.lit(True))
    out = wanted.join(known, "node", "left").join(hits, "node", "left")
    return out.select(F.when(F.col("known"), F.col("node")).otherwise(F.coalesce(F.substring_index("hit", "#", 1), "node")).alias("node")).distinct()


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(node, score, iterations) over imports. Parallel edges count; nodes without targets spread their mass over all.

    A step is one job that writes the new scores, so no plan holds more than one; with a tolerance the driver sees their change
    alone. Links are written once, by source, with what each passes on.
    """
    pairs = edges.where("kind = 'imports'").select("source", "target")
    degree = pairs.groupBy("source").agg(F.count("*").alias("out"))
    links = written(pairs.join(degree, "source").groupBy("source", "target").agg((F.count("*") / F.first("out")).alias("share")))
    nodes = written(pairs.select(F.explode(F.array("source", "target")).alias("node")).distinct().join(degree.withColumnRenamed("source", "node"), "node", "left").select("node", F.col("out").isNull().alias("dangling")))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"), F.lit(0).alias("iterations"))
    ranks = nodes.select("node", "dangling", F.lit(1.0 / n).alias("score"), F.lit(0.0).alias("change"))
    done = 0
    while done < iterations:
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0)).alias("loose"))
        got = links.join(ranks.select(F.col("node").alias("source"), "score"), "source")
        got = got.groupBy(F.col("target").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        score = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)
        ranks = ranks.join(got, "node", "left").crossJoin(F.broadcast(loose))  # one row
        ranks = ranks.select("node", "dangling", score.alias("new"), F.abs(score - F.col("score")).alias("change")).withColumnRenamed("new", "score")
        done += 1
        ranks = written(ranks)
        if tolerance is not None and ranks.agg(F.sum("change")).first()[0] < tolerance:
            break
    return ranks.select("node", "score", F.lit(done).cast("bigint").alias("iterations"))


def top_ranked(ranks: DataFrame, top: int = 10, share: float = 0.1) -> DataFrame:
    """The best internal modules (their id has a repo) that score over a share of the best one's."""
    inside = ranks.where(F.instr("node", ":") > 0)
    best = inside.agg(F.max("score").alias("best"))
    kept = inside.crossJoin(F.broadcast(best)).where(F.col("score") > share * F.col("best"))  # one row
    return kept.orderBy(F.desc("score"), "node").limit(top).select("node", "score")


BLOCK = 50_000  # nodes whose reach one task counts, at least


def _linked(pairs: DataFrame, nulls: bool = False) -> tuple[DataFrame, DataFrame]:
    """(node, id) of pairs (a, b), and the pairs as ids. Ids are unique and written, but have gaps. With nulls, b may be null."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()))
    from_ = _apart(nodes.select(F.col("node").alias("a"), F.col("id").alias("from")))
    to = _apart(nodes.select(F.col("node").alias("end"), F.col("id").alias("to")))
    same = F.col("b").eqNullSafe(F.col("end")) if nulls else F.col("b") == F.col("end")
    return nodes, pairs.join(from_, "a").join(to, same).select("from", "to")


def reach_counts(edges: DataFrame) -> DataFrame:
    """(node, reach): how many others depend on each import endpoint, directly or not.

    The pairs of the closure are counted, never kept: each of at most 24 tasks holds the links as numbers, 16 bytes each, and
    counts for its share of the nodes. Time grows with the pairs, memory and shuffle with the edges.
    """
    imports = written(backward(edges.where("kind = 'imports'")).distinct())
    nodes, links = _linked(imports)
    tasks = max(1, min(24, -(-nodes.count() // BLOCK)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([batch.column(i).to_numpy().tobytes()], pa.binary()) for i in (0, 1)], ["a", "b"])

    def counted(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        a, b = (np.frombuffer(b"".join(group[c].to_pylist()), np.int64) for c in ("a", "b"))
        (a, b), first = kernels.dense(a, b)
        n, task = int(first[-1]), key[0].as_py()
        start, end = n * task // tasks, n * (task + 1) // tasks
        counts = kernels.reach(kernels.Links(a, b, n), n, start, end)
        return pa.table({"id": kernels.sparse(np.arange(start, end), first), "reach": counts})

    copies = links.mapInArrow(packed, "a binary, b binary").withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    n = copies.groupBy("task").applyInArrow(counted, "id bigint, reach bigint")
    return nodes.join(_apart(n), "id", "left").select("node", F.coalesce("reach", F.lit(0)).alias("reach"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles; a component is named by its least node.

    Nodes without edges in or out can't be on a cycle: they are peeled off, round by round, until one task can hold what is left
    or a round peels less than a tenth; one task ends the search in linear time and memory.
    """
    left = written(forward(edges).where("a <> b").distinct())
    before, now = None, left.count()
    while now > LOCAL // 4 and (before is None or now < 0.9 * before):
        ends, starts = left.select(F.col("b").alias("a")).distinct(), left.select(F.col("a").alias("b")).distinct()
        left = written(left.join(_apart(ends), "a", "left_semi").join(_apart(starts), "b", "left_semi"))
        before, now = now, left.count()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [*batches]
        if sum(b.num_rows for b in held):
            names, (a, b) = kernels.numbered([h.column(0) for h in held], [h.column(1) for h in held])
            nodes, component = (names.take(pa.array(c)).cast(pa.string()) for c in kernels.cyclic(a, b, len(names)))
            yield pa.record_batch([nodes, component], ["node", "component"])

    return written(left.select("a", "b").repartition(1).mapInArrow(search, "node string, component string"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph, named by the least node: alternating large and small stars.

    Each task first reduces its own edges to a star for each of their components, so the rounds see at most one row for each node
    and task instead of the edges. The rounds end when the edges are stars.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionAll(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        j = e.join(_apart(e.groupBy("x").agg(F.min("y").alias("m"))), "x").withColumn("m", F.least("m", "x"))
        if large:
            return j.where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        moved = j.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        return moved.unionAll(j.select("x", F.col("m").alias("y"))).where("x <> y").distinct()

    first = written(edges.select("source", "target").mapInArrow(kernels.stars, "x string, y string"))
    lone = first.where("x <=> y").select("x").distinct()
    e = written(star(first.where("x <> y"), False))
    while True:
        twice = e.groupBy("x").agg(F.count("*").alias("n")).where("n > 1")
        if twice.isEmpty() and e.join(_apart(e.select(F.col("y").alias("x"))), "x", "left_semi").isEmpty():
            break
        e = written(star(star(e, True), False))
    lone = lone.join(_apart(e.select("x")), "x", "left_anti").select("x", F.col("x").alias("y"))
    return e.unionByName(lone).select(F.col("x").alias("node"), F.col("y").alias("component"))


def import_cycles(edges: DataFrame) -> DataFrame:
    """(repo, cycle): one cycle for each back edge of a depth-first search of each repo's imports, in sorted order.

    The search is sequential, so each repo's cyclic core is one group; edges that lie on no cycle are cut off before.
    """
    imports = written(edges.where("kind = 'imports'").select("repo", "source", "target").distinct())
    part = strong_components(imports)
    core = imports.join(part.select(F.col("node").alias("source"), F.col("component").alias("c1")), "source")
    core = core.join(part.select(F.col("node").alias("target"), F.col("component").alias("c2")), "target").where("c1 = c2").select("repo", "source", "target")

    def search(group: pa.Table) -> pa.Table:
        after: dict[str, list[str]] = {}
        for s, t in sorted(zip(group["source"].to_pylist(), group["target"].to_pylist(), strict=True)):
            after.setdefault(s, []).append(t)
        state: dict[str, int] = {}
        cycles = []
        for root in sorted(after):
            if state.get(root):
                continue
            path, stack, place = [root], [iter(after[root])], {root: 0}
            state[root] = 1
            while stack:
                node = next(stack[-1], None)
                if node is None:
                    stack.pop()
                    state[path.pop()] = 2
                elif not state.get(node):
                    state[node] = 1
                    place[node] = len(path)
                    path.append(node)
                    stack.append(iter(after.get(node, [])))
                elif state[node] == 1:
                    cycles.append([*path[place[node] :], node])
        repo = group["repo"][0].as_py()
        return pa.table({"repo": pa.array([repo] * len(cycles), pa.string()), "cycle": pa.array(cycles, pa.list_(pa.string()))})

    return core.groupBy("repo").applyInArrow(search, "repo string, cycle array<string>")


def barrel_mediated(cycles: DataFrame) -> DataFrame:
    """cycles with barrel: whether one of the cycle's files is an index file."""
    return cycles.withColumn("barrel", F.exists("cycle", lambda p: p.rlike(r"(?:^|[/\\])index\.[jt]sx?$")))


def barrel_expansion(edges: DataFrame, barrels: DataFrame, rounds: int = 5) -> DataFrame:
    """(node): barrels, and what re-exports them, for at most `rounds` rounds."""
    return levels(backward(edges), barrels, rounds).select("node")


def cross_pairs(edges: DataFrame, kinds: Sequence[str] = ("imports", "depends-on")) -> DataFrame:
    """(source_repo, target_repo, n): edges between repos, those of ids."""
    repo = lambda c: F.when(F.instr(c, ":") > 0, F.substring_index(c, ":", 1))
    e = edges.where(F.col("kind").isin(*kinds)).select(repo("source").alias("source_repo"), repo("target").alias("target_repo"))
    return e.where("source_repo <> target_repo").groupBy("source_repo", "target_repo").agg(F.count("*").alias("n"))


def shortest_paths(pairs: DataFrame, start: str, goal: str, max_depth: int | None = None) -> DataFrame:
    """Every shortest path (path, joined by >) from start to goal over (a, b).

    Nodes off the shortest paths are dropped first: those whose distances from the start and to the goal don't add up.
    """
    spark = pairs.sparkSession
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    out = levels(pairs, one(start), max_depth).withColumnRenamed("depth", "d1")
    back = levels(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), one(goal), max_depth).withColumnRenamed("depth", "d2")
    total = out.where(F.col("node") == goal).select(F.col("d1").alias("total"))
    on = written(out.join(back, "node").crossJoin(F.broadcast(total)).where("d1 + d2 = total").select("node", "d1", "total"))  # one row
    length = on.agg(F.max("total")).first()[0]
    paths = on.where("d1 = 0").select("node", F.array("node").alias("path"))
    for depth in range(1, (length or 0) + 1):
        step = pairs.join(on.where(F.col("d1") == depth).select(F.col("node").alias("b")), "b", "left_semi").distinct()
        paths = paths.join(step, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"))
    return paths.where(F.col("node") == goal).select(F.array_join("path", ">").alias("path"))


def simple_paths(pairs: DataFrame) -> DataFrame:
    """(start, path) of all simple paths over (a, b), a graph of few nodes such as one of repos."""
    pairs = written(pairs.distinct())
    seen = Grown(pairs.where("a <> b").select(F.col("a").alias("start"), F.array("a", "b").alias("path")))
    frontier = seen.table()
    while not frontier.isEmpty():
        longer = frontier.join(pairs, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b")))
        frontier = seen.add(longer.select("start", F.concat("path", F.array("b")).alias("path")))
    return seen.table()


def critical_paths(pairs: DataFrame, min_nodes: int = 4) -> DataFrame:
    """(start, nodes, path): each start's longest simple path, the least of equals, if it has min_nodes nodes."""
    best = simple_paths(pairs).select("start", F.size("path").cast("bigint").alias("nodes"), F.array_join("path", ">").alias("path"))
    longest = best.groupBy("start").agg(F.min(F.struct((-F.col("nodes")).alias("less"), "path")).alias("m"))
    return longest.select("start", (-F.col("m.less")).alias("nodes"), "m.path").where(F.col("nodes") >= min_nodes)


def trace_back(steps: DataFrame, seeds: DataFrame, keys: Sequence[str] = ("function_id",)) -> DataFrame:
    """Nodes from which a seed of the same function is reached, over control-flow edges (*keys, a, b)."""
    on = [*keys, "node"]
    seen = Grown(seeds.select(*on).distinct())
    frontier = seen.table()
    while not frontier.isEmpty():
        back = frontier.join(steps.withColumnRenamed("b", "node"), on).select(*keys, F.col("a").alias("node")).distinct()
        frontier = seen.add(back.join(seen.table(), on, "left_anti"))
    return seen.table()
