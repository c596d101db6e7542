"""Graph operators read their edges once and keep what grows with the graph away from the driver."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from lodestone.operators import graph, kernels


def _counted(spark, rows, names="source string, target string, kind string, repo string"):
    """Edges, and a counter of the rows that were read from them."""
    read = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, names).mapInArrow(through, names), read


def _pairs(seed, nodes, edges):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(edges)})


def test_components_read_edges_once(spark):
    pairs = [*_pairs(3, 300, 170), ("lone", "lone")]
    edges, read = _counted(spark, [(a, b, "imports", "t") for a, b in pairs])
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.component for r in graph.components(edges).collect()} == root
    assert read.value == len(pairs)


def test_stars_of_a_task(monkeypatch):
    """However often a task reduces or sends what it holds, each node is linked to its component's least; nulls link nothing."""
    pairs = _pairs(4, 60, 50)
    for held in (3, 20, 1000):
        monkeypatch.setattr(kernels, "HELD", held)
        batches = [pa.record_batch([[a for a, _ in pairs[i : i + 7]], [b for _, b in pairs[i : i + 7]]], ["a", "b"]) for i in range(0, len(pairs), 7)]
        rows = [r for b in kernels.stars([*batches, pa.record_batch([pa.array([None, None], pa.string()), pa.array(["z", None], pa.string())], ["a", "b"])]) for r in b.to_pylist()]
        names = sorted({n for p in pairs for n in p})
        of = {n: i for i, n in enumerate(names)}
        want = kernels.least(np.array([of[a] for a, _ in pairs]), np.array([of[b] for _, b in pairs]), len(names))
        kept = [(r["x"], r["y"]) for r in rows if r["x"] not in (None, "z")]
        got = kernels.least(np.array([of[x] for x, _ in kept]), np.array([of[y] for _, y in kept]), len(names))
        assert {x for x, _ in kept} == set(names) and got.tolist() == want.tolist()
        assert {(r["x"], r["y"]) for r in rows if r["x"] in (None, "z")} == {(None, None), ("z", "z")}
        if held == 1000:
            assert len(kept) == len(names)


def test_reach_counts_read_edges_once(spark, monkeypatch):
    """Several tasks, ids with gaps, cycles, nodes without dependents; no table that is written holds the closure's pairs."""
    monkeypatch.setattr(graph, "BLOCK", 25)
    sizes = []
    monkeypatch.setattr(graph, "written", lambda df, f=graph.written: (out := f(df), sizes.append(out.count()))[0])
    pairs = [*_pairs(5, 150, 180), *((f"c{i:03}", f"c{i + 1:03}") for i in range(60))]
    edges, read = _counted(spark, [(a, b, "imports", "t") for a, b in pairs] + [("c060", "c000", "calls", "t")])
    after = {}
    for a, b in pairs:
        after.setdefault(b, []).append(a)
    want = {}
    for n in {n for p in pairs for n in p}:
        found = [n]
        for v in found:
            found += [w for w in dict.fromkeys(after.get(v, [])) if w not in found]
        want[n] = len(found) - 1
    assert {r.node: r.reach for r in graph.reach_counts(edges).collect()} == want
    assert read.value == len(pairs) + 1 and max(sizes) <= max(len(pairs), len(want))


def test_reach_of_a_block():
    """Blocks of one word and of many, a ring and a dense graph."""
    for n, a, b in ((200, np.arange(200), (np.arange(200) + 1) % 200), (300, *np.random.default_rng(6).integers(0, 300, (2, 420)))):
        m = np.eye(n, dtype=bool)
        step = np.eye(n, dtype=bool)
        step[a, b] = True
        for _ in range(9):
            m = m | (step.astype(int) @ step.astype(int) > 0)
            step = m
        links = kernels.Links(a, b, n)
        assert kernels.reach(links, n, 0, n).tolist() == (m.sum(axis=1) - 1).tolist()
        assert kernels.reach(links, n, 70, 171).tolist() == (m.sum(axis=1) - 1)[70:171].tolist()


def _jobs(spark, run):
    name = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_cycles_behind_a_long_chain(spark):
    """Peeling a chain takes no job for each of its nodes; edges are read once."""
    pairs = [*((f"c{i:03}", f"c{i + 1:03}") for i in range(40)), ("c040", "x"), ("x", "y"), ("y", "x"), ("y", "z"), ("z", "w")]
    edges, read = _counted(spark, [(a, b, "imports", "t") for a, b in pairs])
    cycles, jobs = _jobs(spark, lambda: [r.cycle for r in graph.import_cycles(edges).collect()])
    assert cycles == [["x", "y", "x"]] and read.value == len(pairs) and jobs < 40


def test_strong_components_peel_until_a_task_can_hold_the_rest(spark, monkeypatch):
    pairs = _pairs(7, 80, 110)
    edges = spark.createDataFrame([(a, b, "imports", "t") for a, b in pairs], "source string, target string, kind string, repo string")
    want = {(r.node, r.component) for r in graph.strong_components(edges).collect()}
    monkeypatch.setattr(graph, "LOCAL", 80)
    assert want and {(r.node, r.component) for r in graph.strong_components(edges).collect()} == want


def test_cyclic_against_reach():
    for seed in range(30):
        n = 40
        a, b = np.random.default_rng(seed).integers(0, n, (2, 20 + 3 * seed))
        a, b = a[a != b], b[a != b]
        m = np.eye(n, dtype=int)
        m[a, b] = 1
        for _ in range(6):
            m = (m @ m > 0).astype(int)
        both = (m > 0) & (m.T > 0)
        want = [(i, int(np.flatnonzero(both[i])[0])) for i in range(n) if both[i].sum() > 1]
        nodes, component = kernels.cyclic(a, b, n)
        assert list(zip(nodes.tolist(), component.tolist(), strict=True)) == want


def test_search_of_any_depth(spark, monkeypatch):
    """A chain of 40 takes few jobs; the rounds that replace the task on a greater graph give the same and broadcast no seen rows."""
    pairs = [*((f"c{i:03}", f"c{i + 1:03}") for i in range(40)), ("c040", "c010"), ("c005", "d"), ("e", "c000"), ("c001", None), (None, "e")]
    steps = spark.createDataFrame(pairs, "a string, b string")
    seeds = spark.createDataFrame([("c000",), ("c003",), ("alone",), (None,)], "node string")
    found, jobs = _jobs(spark, lambda: {(r.node, r.depth) for r in graph.levels(steps, seeds).collect()})
    want = {("alone", 0), (None, 0), ("c000", 0), ("c001", 1), ("c002", 2), (None, 2), ("d", 3)} | {(f"c{i:03}", i - 3) for i in range(3, 41)}
    assert found == want and jobs < 40  # a round for each of the chain would take more
    short = [(f"c{i:03}", f"c{i + 1:03}") for i in range(4)]
    monkeypatch.setattr(graph, "LOCAL", 0)
    assert {(r.node, r.depth) for r in graph.levels(spark.createDataFrame(short, "a string, b string"), seeds.where("node = 'c000'")).collect()} == {(f"c{i:03}", i) for i in range(5)}
