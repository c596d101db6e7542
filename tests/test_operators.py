"""Operators on small hand-made inputs and on random graphs against plain Python."""

from __future__ import annotations

import itertools
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import correlate, diagnostics, extract, graph, metrics, mining, models, rules, text
from lodestone.plans import catalog, registry
from lodestone.streaming import incremental


def _edges(spark, pairs, kind="imports", repo="t"):
    rows = [(a, b, kind if isinstance(kind, str) else kind[i], repo) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "source string, target string, kind string, repo string")


def _nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def _random_graph(seed, nodes=14, edges=28):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(nodes)]
    return sorted({(rng.choice(names), rng.choice(names)) for _ in range(edges)})


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_against_python(spark, seed):
    pairs = _random_graph(seed)
    e = _edges(spark, pairs)
    nodes = sorted({n for p in pairs for n in p})
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    strict = {(a, b) for a in nodes for b in reach[a] if a != b}
    assert {r.node: r.reach for r in graph.reach_counts(e).collect()} == {n: sum(b == n for _, b in strict) for n in nodes}
    mutual = {n: min([n, *(b for b in nodes if (n, b) in strict and (b, n) in strict)]) for n in nodes if any((n, b) in strict and (b, n) in strict for b in nodes)}
    assert {r.node: r.component for r in graph.strong_components(e).collect()} == mutual
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.component for r in graph.components(e).collect()} == root
    for r in graph.import_cycles(e).collect():
        assert r.cycle[0] == r.cycle[-1] and all(p in pairs for p in itertools.pairwise(r.cycle))
    depth = {nodes[0]: 0}
    for d in range(3):
        for a, b in pairs:
            if depth.get(b) == d and a not in depth:
                depth[a] = d + 1
    blast = {r.node: (r.depth, r.via) for r in graph.blast_radius(e, _nodes(spark, nodes[:1]), 3).collect()}
    assert blast == {n: (d, "imports") for n, d in depth.items() if d}


def test_pagerank_mass_and_convergence(spark):
    """Scores add up to one, a chain's end scores most, and the loop stops before its limit."""
    ranks = graph.pagerank(_edges(spark, [("a", "b"), ("b", "c"), ("d", "c")]), iterations=60).collect()
    scores = {r.node: r.score for r in ranks}
    assert abs(sum(scores.values()) - 1) < 1e-6
    assert max(scores, key=scores.get) == "c" and ranks[0].iterations < 60


def test_shortest_paths_on_a_cycle(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "x"), ("x", "c")], "a string, b string")
    assert sorted(r.path for r in graph.shortest_paths(pairs, "a", "d").collect()) == ["a>b>c>d", "a>x>c>d"]


def test_module_metrics(spark):
    """Three importers of one module without abstractions: it is stable and concrete, in pain."""
    e = _edges(spark, [("t:a", "t:s"), ("t:b", "t:s"), ("t:c", "t:s")])
    symbols = spark.createDataFrame([("t", "t:s", "S", "class", True)], "repo string, path string, name string, kind string, exported boolean")
    m = {r.module: r for r in metrics.module_metrics(e, symbols).collect()}
    assert (m["t:s"].ca, m["t:s"].ce, m["t:s"].instability, m["t:s"].zone) == (3, 0, 0.0, "pain")
    assert (m["t:a"].instability, m["t:a"].zone) == (1.0, "main-sequence")


def test_temporal_coupling_skips_large_commits(spark):
    rows = [(f"c{i}", f) for i in range(3) for f in ("a.ts", "b.ts")] + [("big", f"f{i}.ts") for i in range(60)]
    out = mining.temporal_coupling(spark.createDataFrame(rows, "hash string, file_path string")).collect()
    assert [(r.file_a, r.file_b, r.co_changes, r.confidence) for r in out] == [("a.ts", "b.ts", 3, 1.0)]


@pytest.mark.parametrize(("modules", "pain", "useless", "distance", "e", "w", "n", "want"), [(10, 0, 0, 0.0, 0, 0, 0, 100), (10, 0, 0, 0.0, 100, 0, 0, 50), (10, 2, 1, 0.4, 1, 3, 6, 71), (100, 0, 0, 0.0, 50, 0, 0, 75)])
def test_debt_index(spark, modules, pain, useless, distance, e, w, n, want):
    summary = spark.createDataFrame([("r", modules, distance, modules, pain, useless)], "repo string, module_count bigint, avg_distance double, internal_count bigint, internal_pain bigint, internal_useless bigint")
    counts = spark.createDataFrame([("r", e, w, n)], "repo string, errors bigint, warnings bigint, notes bigint")
    assert diagnostics.repo_scores(summary, counts).first().score == want


@pytest.mark.parametrize(
    ("version", "wanted", "ok"),
    [("1.2.3", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("0.2.5", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("1.5.0", "1.x", True), ("2.0.0", ">=1 <2", False), ("3.1.0", "<1 || >=3", True), ("1.0.0", "*", True), ("1.2.3", "1.2.3", True), ("1.4.0", "1.2 - 1.4.5", True)],
)
def test_versions(version, wanted, ok):
    assert rules.satisfies(version, wanted) is ok


def test_globs():
    import re

    match = lambda p, s: re.search(rules.glob_pattern(p), s) is not None
    assert match("src/**", "src/a/b.ts") and match("src/*.ts", "src/a.ts") and not match("src/*.ts", "src/a/b.ts") and not match("a.ts", "abts")
    with pytest.raises(ValueError):
        rules.glob_pattern("*a" * 11)


@given(st.sampled_from([2, 3]), st.lists(st.integers(1, 3), min_size=3, max_size=5))
def test_covering_array_covers(t, sizes):
    domain = {f"p{i}": [str(v) for v in range(n)] for i, n in enumerate(sizes)}
    rows = models.covering_array(domain, t)
    for names in itertools.combinations(sorted(domain), t):
        have = {tuple(r[n] for n in names) for r in rows}
        assert have == set(itertools.product(*(domain[n] for n in names)))


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("licensed", "licens"), ("happy", "happi"), ("probate", "probat"), ("controlling", "control")])
def test_stems(word, stem):
    assert text.stem_word(word) == stem


def test_repository_states():
    assert incremental.next_state("candidate", "index") == "indexing"
    with pytest.raises(ValueError):
        incremental.next_state("indexed", "restore")


def test_import_refuses_anonymised_exports(spark, tmp_path):
    from lodestone.sources import readers

    e = _edges(spark, [("t:a", "t:b")])
    readers.exported(spark, {"edges": e}, f"{tmp_path}/plain")
    assert readers.imported(spark, f"{tmp_path}/plain")["edges"].count() == 1
    readers.exported(spark, {"edges": e}, f"{tmp_path}/hidden", salt="x")
    with pytest.raises(ValueError):
        readers.imported(spark, f"{tmp_path}/hidden")


def test_redaction(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(diagnostics.redacted(F.lit("UserService in src/a/UserService.ts and MyUserService"), "s", paths=True).alias("t")).first()
    assert "Service" not in row.t and row.t.count("[REDACTED:") == 3


def test_file_kinds(spark):
    want = {
        "src/a.ts": "typescript", "A.TSX": "typescript", "x.mjs": "javascript", "package.json": "json", "k8s/deployment.yaml": "yaml", "README.MD": "markdown", "docs/a.mdx": "markdown",
        "Dockerfile": "dockerfile", "docker/dockerfile.dev": "dockerfile", "k8s/configmap": "kubernetes", "deploy/Kubernetes/service": "kubernetes", "main.py": "unknown", "": "unknown",
    }
    rows = spark.createDataFrame([(p,) for p in [*want, None]], "path string").select("path", rules.file_kind(F.col("path")).alias("kind")).collect()
    assert {r.path: r.kind for r in rows} == want | {None: "unknown"}


def test_question_kinds(spark):
    want = {"what calls login": "structural", "Show the dependency graph": "structural", "which error is likely": "analytical", "any RISK here": "analytical", "errors everywhere": "search", "where is auth": "search"}
    rows = spark.createDataFrame([(q,) for q in want], "q string").select("q", text.question_kind(F.col("q")).alias("kind")).collect()
    assert {r.q: r.kind for r in rows} == want


def test_shared_contexts(spark):
    groups = {
        1: ["sql failed", "query took long", "permission"], 2: ["token expired", "other"], 3: ["a", "b", "disk"], 4: ["http request", "file is gone"], 5: ["file api"], 6: [None, "heap is full"],
    }
    rows = [(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)]
    got = {r.group_id: r.context for r in text.shared_context(spark.createDataFrame(rows, "group_id int, ord int, template string")).collect()}
    assert got == {1: "database", 2: "authentication", 4: "network", 5: "network", 6: "memory"}


def _drain_by_hand(messages, similarity, clusters):
    found = []
    for m in messages:
        words, best = m.split(), None
        alike = lambda c: sum(t in (w, "<*>") for t, w in zip(c[0], words, strict=True)) / len(words) if words else 0  # noqa: B023, E731
        same = [c for c in found if len(c[0]) == len(words)]
        best = next((c for c in same if alike(c) >= similarity), None)
        if best is None and len(found) < clusters:
            found.append([words, 1])
            continue
        best = best or max(same, key=alike, default=None)
        if best:
            best[0], best[1] = [t if t == w else "<*>" for t, w in zip(best[0], words, strict=True)], best[1] + 1
    return [(" ".join(t), n) for t, n in found]


@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=4).map(" ".join), max_size=40), st.sampled_from([0.4, 0.5, 0.75]), st.integers(1, 6))
def test_drain_takes_the_first_cluster_that_is_alike(messages, similarity, clusters):
    """Repeats too go to an earlier cluster that has become alike meanwhile."""
    d = text.Drain(similarity, clusters)
    for m in messages:
        d.add(m)
    assert [(" ".join(t), n) for t, n in zip(d.templates, d.counts, strict=True)] == _drain_by_hand(messages, similarity, clusters)


def test_log_templates(spark):
    rows = [(3, "r", "error", "user 2 lost"), (1, "r", "error", "user 1 lost"), (2, "r", "warn", "disk full"), (4, "r", "error", None), (1, "q", "error", "user 1 lost")]
    got = {tuple(r) for r in text.log_templates(spark.createDataFrame(rows, "ord int, repo string, severity string, message string")).collect()}
    assert got == {("r", "error", "user <*> lost", 2), ("r", "warn", "disk full", 1), ("q", "error", "user 1 lost", 1)}


def test_fault_tree_joins_what_reaches_each_other(spark):
    """a-b and c-b make one group; a way through a step that is no condition counts, a common end that is none does not."""
    steps = spark.createDataFrame([("t", n, n != "x") for n in "abcdefx"] + [("u", n, True) for n in "ab"], "tree_id string, label string, condition boolean")
    links = spark.createDataFrame([("t", "a", "b"), ("t", "c", "b"), ("t", "d", "x"), ("t", "e", "x"), ("t", "x", "f")], "tree_id string, a string, b string")
    rows = [r for r in extract.fault_tree(steps, links).collect() if r.kind == "BASIC"]
    groups = {}
    for r in rows:
        groups.setdefault((r.tree_id, r.parent_id), set()).add(r.label)
    assert groups == {("t", "and:a"): set("abc"), ("t", "and:d"): set("def"), ("u", "and:a"): {"a"}, ("u", "and:b"): {"b"}}


def test_last_registry_row_wins(spark):
    flags = spark.createDataFrame([("r", "k", "m")], "repo string, name string, module string")
    registry = spark.createDataFrame([(2, "k", "zz"), (9, "k", "aa"), (5, "k", "mm")], "ord int, name string, description string").repartition(3)
    assert [r.description for r in correlate.enriched(flags, registry).collect()] == ["aa"]


def test_log_pairs_take_the_best_relation(spark):
    rows = [(1, "a.ts", 10, ["x", "y"], ["b.ts"]), (2, "a.ts", 25, ["z"], []), (3, "a.ts", 90, ["z", "w"], []), (4, "b.ts", 5, ["q"], []), (5, "c.ts", 5, ["x", "y", "k"], ["c.ts"])]
    logs = spark.createDataFrame([("r1", *r) for r in rows], "repo string, id int, module string, line int, traces array<string>, calls array<string>")
    got = {(r.id_a, r.id_b): r.relation for r in text.log_pairs(logs).collect()}
    assert got == {(1, 2): "same-function", (1, 3): "same-file", (1, 4): "call-connected", (1, 5): "trace-overlap", (2, 3): "trace-overlap"}


def test_drain_over_the_events(spark):
    """The query against the plain algorithm over each repo's messages in order."""
    rows = registry.Facts(spark, "/root/testdata/sf0.001")["br_logs"].orderBy("ord").collect()
    want = []
    for repo in {r.repo for r in rows}:
        want += [(repo, t.split(" ", 1)[1], n) for t, n in _drain_by_hand([f"{r.severity} {r.message}" for r in rows if r.repo == repo], 0.5, 100)]
    got = [(r.repo, r.template, r.frequency) for r in catalog.QUERIES["tx_drain"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want)
