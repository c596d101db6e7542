"""Scopes and entities of questions."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from lodestone.operators import text
from lodestone.plans import catalog

DATA = "/root/testdata/sf0.001"
QUESTIONS = ['repo:web what calls UserService.find in "src/a.ts"', "repos:a,b explain camelCase and PascalCase and a.b.c", "why is OrderHandler in OrderHandler risky", "plain words"]
WANT = [("web", "src/a.ts,UserService,UserService.find,a.ts"), ("a,b", "PascalCase,camelCase,a.b.c"), ("", "OrderHandler"), ("", "")]


def _by_hand(q: str) -> tuple[str, str]:
    m = re.match(r"\s*repos?:([A-Za-z0-9_.,@/-]+)\s+", q)
    rest = q[m.end() :] if m else q
    found = [x for p in (r'"([^"]+)"', r"\b[A-Z][a-z]+[A-Z][a-zA-Z]*\b", r"\b[a-z]+[A-Z][a-zA-Z]*\b", r"\b\w+(?:\.\w+)+\b") for x in re.findall(p, rest, re.ASCII)]
    return ",".join(x for x in m[1].split(",") if x) if m else "", ",".join(dict.fromkeys(found))


def test_questions(spark):
    q = spark.createDataFrame(list(enumerate(QUESTIONS)), "id int, q string").select("id", text.scope(F.col("q")).alias("s"))
    rows = q.select("id", F.array_join("s.repos", ",").alias("r"), F.array_join(text.entities(F.col("s.question")), ",").alias("e")).orderBy("id").collect()
    assert [(r.r, r.e) for r in rows] == WANT == [_by_hand(t) for t in QUESTIONS]


def test_every_turn_has_its_entities(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    want = Counter((r.conv_id, r.turn, *_by_hand(r.text)) for r in rows if r.text is not None)
    got = Counter(tuple(r) for r in catalog.QUERIES["tx_entities"](spark, DATA).select("conv_id", "turn", "repos", "entities").where("repos IS NOT NULL").collect())
    assert got == want
