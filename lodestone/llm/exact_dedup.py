"""Exact deduplication by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks, each chunk is hashed as a polynomial modulo two 31-bit primes, and the chunks'
hashes combine by length-shifted arithmetic, H(ab) = H(a) * base**len(b) + H(b), so a huge document's chunks can be hashed
in parallel and in any grouping. Texts of equal fingerprint and length are then compared chunk by chunk; a collision
doesn't merge them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import BROADCAST_ROWS, RID, columns, map_batches, numbered, small, tidy, without_rows, written
from lodestone.llm._text import blocks, buffer, strings

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_003)
CHUNK_BYTES = 8192


@lru_cache(maxsize=8)
def _powers(prime: int, base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    for i in range(1, n):
        out[i] = out[i - 1] * base % prime
    return out


def chunk_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, k: int, chunk: int = CHUNK_BYTES) -> np.ndarray:
    """The polynomial hash modulo prime k of each data[start:end], of `chunk` bytes at most; bytes count from 1."""
    if len(start) == 0:
        return np.zeros(0, np.int64)
    powers = _powers(PRIMES[k], BASES[k], chunk)
    lengths = end - start
    place = np.repeat(end, lengths) - np.arange(len(data)) - 1
    return np.add.reduceat((data.astype(np.int64) + 1) * powers[place], start) % PRIMES[k]


def combine(left: int, right: int, right_bytes: int, k: int) -> int:
    """The hash of ab from those of a and b and b's length."""
    return (left * pow(BASES[k], right_bytes, PRIMES[k]) + right) % PRIMES[k]


def fingerprints(data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK_BYTES) -> np.ndarray:
    """A 62-bit fingerprint of each text: both primes' hashes of its chunks, combined."""
    lengths = np.diff(offsets)
    parts = -(-lengths // chunk)
    owner = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = offsets[:-1][owner] + number * chunk
    end = np.minimum(start + chunk, offsets[1:][owner])
    out = np.zeros(len(lengths), np.int64)
    for k in (0, 1):
        h = chunk_hashes(data, start, end, k, chunk)
        total = np.zeros(len(lengths), np.int64)
        single = number == 0
        total[owner[single]] = h[single]
        for i in np.flatnonzero(~single):
            total[owner[i]] = combine(int(total[owner[i]]), int(h[i]), int(end[i] - start[i]), k)
        out = (out << 31) | total
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(__rid, doc_id, fp, bytes) of every row with a text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = strings(batch.column("text"))
        fp, size = [], []
        for _, block in blocks(column):
            data, offsets = buffer(block)
            fp.append(fingerprints(data, offsets))
            size.append(np.diff(offsets))
        return pa.RecordBatch.from_pydict(
            {RID: batch.column(RID), "doc_id": batch.column("doc_id"), "fp": pa.array(np.concatenate(fp)), "bytes": pa.array(np.concatenate(size))}
        )

    rows = columns(docs, **{RID: "bigint", "doc_id": "bigint", "text": "string"}).where("text IS NOT NULL")
    return map_batches(rows, run, f"{RID} bigint, doc_id bigint, fp bigint, bytes bigint")


def classes(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(__rid, doc_id, keeper, keeper_rid) of the rows whose text another row has too; docs is numbered."""
    prints = written(fingerprinted(docs))
    shared = written(prints.groupBy("fp", "bytes").agg(F.count("*").alias("n")).where("n > 1").select("fp", "bytes"))
    members = written(prints.join(small(shared, broadcast_rows), ["fp", "bytes"]))
    # Chunkwise comparison. Copies of a chunk collapse before the shuffle, so a group of any size moves little.
    texts = columns(docs, **{RID: "bigint", "text": "string"}).join(small(members.select(RID, "fp", "bytes"), broadcast_rows), RID)
    size = CHUNK_BYTES // 4  # characters, 4 bytes at most
    chunks = texts.select(
        "fp", "bytes", F.posexplode(F.expr(f"transform(sequence(0, length(text) div {size}), i -> substr(text, i * {size} + 1, {size}))")).alias("at", "chunk")
    )
    differing = chunks.groupBy("fp", "bytes", "at", "chunk").agg(F.lit(1).alias("one")).groupBy("fp", "bytes", "at").count().where("count > 1")
    collided = written(differing.select("fp", "bytes").distinct())
    group = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", RID)).alias("first")

    def keyed(rows: DataFrame, keys: list[str]) -> DataFrame:
        firsts = rows.groupBy(*keys).agg(group, F.count("*").alias("n")).where("n > 1")
        return rows.join(firsts, keys).select(RID, "doc_id", F.col("first.doc_id").alias("keeper"), F.col(f"first.{RID}").alias("keeper_rid"))

    if collided.isEmpty():
        return keyed(members, ["fp", "bytes"])
    same = members.join(small(collided, broadcast_rows), ["fp", "bytes"], "left_anti")
    apart = members.join(small(collided, broadcast_rows), ["fp", "bytes"]).select(RID, "doc_id")
    apart = columns(docs, **{RID: "bigint", "text": "string"}).join(small(apart, broadcast_rows), RID)
    return keyed(same, ["fp", "bytes"]).unionByName(keyed(apart, ["text"]))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Every row of docs as (doc_id, keeper, duplicate): keeper is the least doc_id that has the same text.

    Null texts equal nothing: their rows are their own keepers. Empty texts equal each other. Null doc_ids come after all
    others. Of repeated rows one is kept, the others are duplicates. An empty table gives an empty result; extra columns
    are ignored.
    """
    docs = numbered(columns(docs, doc_id="bigint", text="string"))
    found = small(written(classes(docs)).withColumnRenamed("doc_id", "found_id"))
    return docs.select(RID, "doc_id").join(found, RID, "left").select(
        "doc_id",
        F.when(F.col("keeper_rid").isNull(), F.col("doc_id")).otherwise(F.col("keeper")).alias("keeper"),
        (F.col("keeper_rid").isNotNull() & (F.col("keeper_rid") != F.col(RID))).alias("duplicate"),
    )


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each distinct text, that of the least doc_id; all columns stay.

    Null texts all stay, of empty ones one; of repeated rows one stays, as of rows that tie in doc_id. Null doc_ids, as which
    those count that are no integers, come last. An empty table stays empty. An input column named __rid goes.
    """
    docs = numbered(tidy(docs))
    found = written(classes(docs).where(f"keeper_rid <> {RID}").select(RID))
    return without_rows(docs, found)


ORACLE_SQL = """
SELECT doc_id,
       CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keeper,
       text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS duplicate
FROM documents
"""
