"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import exact_dedup, language, license_scan, line_rules, mixing, near_dedup, pieces, pii, quality, sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i}" for i in range(60_000))
ROWS = [
    (1, "The river runs along the old mill and past the town.", "en", "a", 52),
    (1, "The river runs along the old mill and past the town.", "en", "a", 52),
    (2, "The river runs along the old mill and past the town.", "en", "b", 52),
    (3, None, "en", "a", None),
    (4, "", "en", None, 0),
    (5, LONG, "en", "a", len(LONG)),
    (None, "Der Fluss zieht an der alten Mühle vorbei in die Stadt.", "de", None, 55),
    (None, None, None, None, None),
    (7, "!!! ???", "de", "b", 7),
    (8, "Der Fluss zieht an der alten Mühle vorbei.", "de", "b", 42),
]
LABELS = [(1, 1, 0), (2, 1, 0), (8, 0, 0), (None, 1, None), (5, None, None)]

OPERATORS = {
    "license": lambda d, lab: license_scan.scanned(d),
    "near": lambda d, lab: near_dedup.near_duplicates(d),
    "language": lambda d, lab: language.identified(d),
    "sharding": lambda d, lab: sharding.sharded(d, 4),
    "mixing": lambda d, lab: mixing.mixed(d),
    "quality": lambda d, lab: quality.scored(d, lab),
    "pii": lambda d, lab: pii.personal_data(d),
    "pieces": lambda d, lab: pieces.round_trip(d),
    "exact": lambda d, lab: exact_dedup.exact_duplicates(d),
    "lines": lambda d, lab: line_rules.line_rules(d),
}
PER_ROW = ("near", "language", "sharding", "quality", "pieces", "exact", "lines")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, docs, labels):
    rows = OPERATORS[name](docs, labels).collect()
    if name in PER_ROW:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    assert len(rows) < 1000


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, docs, labels):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(name, docs, labels):
    """Extra columns that are named like the operator's own change nothing in its result."""
    own = ["__rid", "keeper", "duplicate", "fp", "h", "word", "ids", "decoded", "shard", "part", "copy", "score", "keep", "language", "gone", "parts", "__n", "__e", "__c", "Shard"]
    more = docs.select("*", *[F.lit("x").alias(c) for c in own])
    plain, other = OPERATORS[name](docs, labels), OPERATORS[name](more, labels)
    cols = plain.columns
    assert set(cols) <= set(other.columns)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, other.select(*cols).collect()))


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(stage, docs, spark):
    _, f = stage
    empty = f(spark, docs.limit(0), "")
    assert empty.collect() == []
    out = f(spark, docs, "")
    out.collect()
    if stage is not corpus_pipeline.STAGES[-1]:
        assert out.columns == docs.columns


def test_all_null(spark):
    rows = spark.createDataFrame([(None,) * 5] * 3, SCHEMA)
    labels = spark.createDataFrame([(None, None, None)], "doc_id bigint, quality int, toxic int")
    for f in OPERATORS.values():
        f(rows, labels).collect()
    assert [r.duplicate for r in exact_dedup.exact_duplicates(rows).collect()] == [False] * 3
    assert not any(r.accepted for r in language.identified(rows).collect())


def test_stated_results(docs, labels):
    exact = sorted((r.doc_id, r.keeper, r.duplicate) for r in exact_dedup.exact_duplicates(docs).where("doc_id IN (1, 2, 3, 4)").collect())
    assert exact == [(1, 1, False), (1, 1, True), (2, 1, True), (3, 3, False), (4, 4, False)]
    near = sorted((r.doc_id, r.keeper, r.duplicate) for r in near_dedup.near_duplicates(docs).where("doc_id IN (1, 2, 3, 4)").collect())
    assert near == exact
    kept = {r.doc_id for r in language.accepted(docs).collect()}
    assert not kept & {3, 4, 7} and {1, 2, 8} <= kept
    scores = {r.doc_id: r.score for r in quality.scored(docs, labels).collect()}
    assert scores[3] == scores[4] == 0
    empty = {r.doc_id: (r.ids, r.decoded) for r in pieces.round_trip(docs).where("doc_id IN (3, 4)").collect()}
    assert empty == {3: ([], ""), 4: ([], "")}
    lines = {r.doc_id: (r.text, r.keep) for r in line_rules.line_rules(docs).where("doc_id IN (3, 4)").collect()}
    assert lines == {3: (None, True), 4: ("", True)}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_with_clashing_columns(stage, docs, spark):
    """Columns that are named like an operator's own change nothing in what a stage keeps."""
    _, f = stage
    more = docs.select("*", *[F.lit("x").alias(c) for c in ("__rid", "__c", "__source", "__n", "ids", "decoded", "keeper", "Doc_ID", "extra")])
    plain, other = f(spark, docs, ""), f(spark, more, "")
    assert "extra" in other.columns
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, other.select(*plain.columns).collect()))


def test_without_a_text_column(docs):
    bare = docs.drop("text")
    assert language.accepted(bare).collect() == []
    assert all(r.ids == [] and r.decoded == "" for r in pieces.encode(bare, decoded=True).collect())
    assert not any(r.duplicate for r in near_dedup.near_duplicates(bare).collect())
    assert pii.personal_data(bare).collect() == license_scan.scanned(bare).collect() == []


def test_long_texts_are_taken_whole(spark):
    """A text of half a million characters: its last words count as much as its first."""
    end = "Released under the MIT License. write to ann.lee@mail.example.org"
    rows = [(1, f"{LONG} {end}", "a"), (2, f"{LONG} {end}", "a"), (3, LONG, "a"), (4, LONG[:-1] + "!", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r.doc_id: (r.keeper, r.duplicate) for r in exact_dedup.exact_duplicates(docs).collect()} == {1: (1, False), 2: (1, True), 3: (3, False), 4: (4, False)}
    near = {r.doc_id: (r.keeper, r.duplicate, r.links) for r in near_dedup.near_duplicates(docs).collect()}
    assert near == {1: (1, False, 3), 2: (1, True, 3), 3: (1, True, 3), 4: (1, True, 3)}
    assert sorted((r.doc_id, r.license) for r in license_scan.scanned(docs).collect()) == [(1, "MIT"), (2, "MIT")]
    assert sorted((r.doc_id, r.kind, r.end) for r in pii.personal_data(docs).collect()) == [(i, "email", len(LONG) + 1 + len(end)) for i in (1, 2)]
    assert {r.doc_id: r.decoded for r in pieces.round_trip(docs).collect()} == {i: t for i, t, _ in rows}
    assert {r.doc_id: r.text for r in line_rules.line_rules(docs).collect()} == {i: t for i, t, _ in rows}


def test_ties(spark):
    """Equal ids, texts and scores: one of equals is kept, equals are judged alike."""
    rows = [(7, "the same old text", "en", "a")] * 3 + [(8, "another text altogether here", "en", "a")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert sorted(r.doc_id for r in exact_dedup.without_exact_duplicates(docs).collect()) == [7, 8]
    assert sorted(r.doc_id for r in near_dedup.without_near_duplicates(docs).collect()) == [7, 8]
    assert sorted((r.doc_id, r.links) for r in near_dedup.near_duplicates(docs).collect()) == [(7, 2)] * 3 + [(8, 1)] * 2
    scores = quality.scored(docs, spark.createDataFrame([(7, 1)], "doc_id bigint, quality int")).collect()
    assert len({(r.doc_id, r.score) for r in scores}) == 2
    copies = mixing.mixed(docs, budget=100).groupBy("doc_id").count().collect()
    assert all(r["count"] % (3 if r.doc_id == 7 else 2) == 0 for r in copies)
    assert len({(r.shard, r.part) for r in sharding.sharded(docs, 2).where("doc_id = 7").collect()}) == 1
    kept = line_rules.line_rules(docs, max_documents=1, min_kept=0.0).collect()
    assert all(r.removed == 0 and r.keep for r in kept)  # copies count as one text
