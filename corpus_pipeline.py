"""The corpus pipeline: languages, exact and near duplicates, the mixture, tokens.

Every stage takes and, but for the last, returns the columns of documents; rows stay as they are or go. An empty table passes
through all of them. Texts of any length are taken whole. A column that is named like an operator's own (__rid, __c, ids,
decoded and so on) gives way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import exact_dedup, language, mixing, near_dedup, pieces
from lodestone.llm._common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that their labels know stay; null, empty and letterless texts go, repeated rows share their fate."""
    return language.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, that of the least doc_id; null texts all stay, null doc_ids come last, repeated rows fall to one."""
    return exact_dedup.without_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id; texts without a word all stay."""
    return near_dedup.without_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated and left out by their sources' rates; null sources make one, repeated rows share their coin."""
    return mixing.mixed(docs, number=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids in place of their text, and the text that these decode to; of null and empty texts none and ''."""
    return pieces.encode(docs, decoded=True)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing", mixture),
    ("SentencePiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs


#: Language ID and near-dedup are no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None
