"""Range sharding by sampled splitters.

Keys are sampled with probability in proportion to their rows' size, the sample's quantiles become the splitters, and
each record goes to the range that its key falls into. Ranges that turn out overfull are split again the same way.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import tidy, written

#: Shards are as many as it takes for SHARD_BYTES each, and MIN_SHARDS at least.
MIN_SHARDS, SHARD_BYTES = 24, 256 << 20
SAMPLES_PER_SHARD = 64
OVERFULL = 1.25
SEED = 11


def _coin(seed: int, text: Column) -> Column:
    """A number in [0, 1) from an MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __size (bytes; a null text has 0; a record counts 1 more) and the key that orders records."""
    docs = tidy(docs, ["shard", "part", "__size", "__source", "__id", "__u"])
    have = {c.lower(): c for c in docs.columns}
    col = lambda n, t: F.col(have[n]).try_cast(t) if n in have else F.lit(None).cast(t)
    return docs.select(
        "*",
        (F.coalesce(F.octet_length(col("text", "string")), F.lit(0)) + 1).cast("bigint").alias("__size"),
        F.coalesce(col("source", "string"), F.lit("")).alias("__source"),
        F.coalesce(col("doc_id", "bigint"), F.lit(-1)).alias("__id"),
    ).withColumn("__u", _coin(SEED, F.concat_ws(":", "__source", F.col("__id").cast("string"))))


KEY = ("__source", "__id")


def _splitters(sample: DataFrame, by: list[str], parts: Column) -> DataFrame:
    """Per `by`: the sorted keys at the sample's quantiles, `parts` - 1 of them, ties once."""
    rows = sample.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*KEY))).alias("s"), F.first(parts).alias("k"))
    return rows.select(
        *by,
        F.expr("array_distinct(transform(filter(sequence(1, greatest(k, 1)), i -> i < k AND size(s) > 0), i -> s[int(floor(i * size(s) / double(k)))]))").alias("bounds"),
    )


def _place(bounds: Column) -> Column:
    """How many bounds are not above the record's key, by bisection."""
    key = F.struct(*KEY)
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s.lo + s.hi) / 2).cast("int")
        up = F.get(bounds, mid) <= key
        return F.when(s.lo >= s.hi, s).otherwise(
            F.struct(F.when(up, mid + 1).otherwise(s.lo).alias("lo"), F.when(up, s.hi).otherwise(mid).alias("hi"))
        )

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(bounds) + F.lit(1.0))).cast("int") + 1)
    return F.when(F.size(bounds) > 0, F.aggregate(steps, start, step, lambda s: s.lo)).otherwise(F.lit(0))


def _placed(docs: DataFrame, shards: int | None, samples_per_shard: int, overfull: float) -> tuple[DataFrame, list[int]]:
    """placed(), and how many parts each shard has."""
    docs = keyed(docs)
    keys = written(docs.select(*KEY, "__size", "__u"))
    total = keys.agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("bytes")).first()["bytes"]
    shards = shards or max(MIN_SHARDS, -(-total // SHARD_BYTES))
    target = max(total / shards, 1.0)
    rate = shards * samples_per_shard / max(total, 1)
    sample = keys.where(F.col("__u") < F.col("__size") * F.lit(rate))
    one = [F.lit(0).alias("all")]
    first = _splitters(sample.select(*one, *KEY), ["all"], F.lit(shards)).select("bounds")
    bounds = first.first()
    ranges = [{k: r[k] for k in KEY} for r in bounds["bounds"]] if bounds else []
    ranges = F.from_json(F.lit(json.dumps(ranges)), "array<struct<__source:string,__id:bigint>>")  # folded to a constant
    place = lambda df: df.withColumn("shard", _place(ranges))
    sized = place(keys).groupBy("shard").agg(F.sum("__size").alias("bytes"))
    cut = sized.where(F.col("bytes") > F.lit(overfull * target)).select("shard", F.ceil(F.col("bytes") / F.lit(target)).cast("int").alias("k"))
    inner = place(keys).join(F.broadcast(cut), "shard")  # at most as many rows as shards
    inner = inner.where(F.col("__u") < F.col("__size") * F.lit(rate))
    parts = written(_splitters(inner, ["shard"], F.col("k")).withColumnRenamed("shard", "__cut"))
    sizes = [1] * (len(bounds["bounds"]) + 1 if bounds else 1)
    for r in parts.select("__cut", F.size("bounds").alias("n")).collect():  # at most as many rows as shards
        sizes[r["__cut"]] = r["n"] + 1
    out = place(docs)
    out = out.join(F.broadcast(parts), F.col("shard") == F.col("__cut"), "left")  # at most as many rows as shards
    out = out.withColumn("part", F.when(F.col("bounds").isNull(), F.lit(0)).otherwise(_place(F.col("bounds"))))
    return out.drop("__cut", "bounds", "__u", "__size", "__source", "__id"), sizes


def placed(docs: DataFrame, shards: int | None = None, samples_per_shard: int = SAMPLES_PER_SHARD, overfull: float = OVERFULL) -> DataFrame:
    """docs with shard and part: ranges of (source, doc_id), in key order, of about equal bytes.

    There are `shards` ranges, or as many as MIN_SHARDS and SHARD_BYTES ask for. A range of more than `overfull` times the
    average is cut into parts by splitters of its own sample. Null sources sort as empty ones; null doc_ids, as which those
    count that are no integers, before all others. Rows that share a key stay together, however many. A text counts with all
    its bytes. An empty table gives an empty result; input columns named shard or part are replaced.
    """
    return _placed(docs, shards, samples_per_shard, overfull)[0]


def sharded(docs: DataFrame, shards: int | None = None, samples_per_shard: int = SAMPLES_PER_SHARD, overfull: float = OVERFULL) -> DataFrame:
    """placed(), with the records moved: each task holds one whole (shard, part) range, and they follow in key order."""
    out, sizes = _placed(docs, shards, samples_per_shard, overfull)
    first = [0]
    for n in sizes:
        first.append(first[-1] + n)
    number = F.get(F.from_json(F.lit(json.dumps(first)), "array<int>"), F.col("shard")) + F.col("part")
    return out.repartitionById(max(first[-1], 1), number.cast("int"))


def oracle_sql(samples_per_shard: int = SAMPLES_PER_SHARD, overfull: float = OVERFULL) -> str:
    return f"""
WITH k AS (
  SELECT *, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS sz, coalesce(source, '') AS so, coalesce(doc_id, -1) AS id FROM documents),
ku AS (SELECT *, CAST(('0x' || md5('{SEED}:' || so || ':' || CAST(id AS VARCHAR))[1:12]) AS BIGINT) / CAST(281474976710656 AS DOUBLE) AS u FROM k),
t AS (SELECT CAST(sum(sz) AS DOUBLE) AS total, CAST(greatest({MIN_SHARDS}, ceil(sum(sz) / {SHARD_BYTES}.0)) AS BIGINT) AS shards FROM ku),
s AS (SELECT so, id, row_number() OVER (ORDER BY so, id) - 1 AS rn, count(*) OVER () AS n
      FROM ku, t WHERE u < sz * (CAST(shards * {samples_per_shard} AS DOUBLE) / total)),
b AS (SELECT DISTINCT s.so, s.id FROM s, t, range(1, 1000000) r(i) WHERE r.i < t.shards AND s.rn = CAST(floor(r.i * s.n / CAST(t.shards AS DOUBLE)) AS BIGINT)),
p AS (SELECT ku.*, (SELECT count(*) FROM b WHERE (b.so, b.id) <= (ku.so, ku.id)) AS shard FROM ku),
z AS (SELECT shard, CAST(ceil(sum(sz) / (any_value(total) / any_value(shards))) AS BIGINT) AS k
      FROM p, t GROUP BY shard HAVING sum(sz) > CAST({overfull} AS DOUBLE) * (any_value(total) / any_value(shards))),
s2 AS (SELECT p.shard, so, id, k, row_number() OVER (PARTITION BY p.shard ORDER BY so, id) - 1 AS rn, count(*) OVER (PARTITION BY p.shard) AS n
       FROM p JOIN z ON p.shard = z.shard, t WHERE u < sz * (CAST(shards * {samples_per_shard} AS DOUBLE) / total)),
b2 AS (SELECT DISTINCT s2.shard, s2.so, s2.id FROM s2, range(1, 100000) r(i) WHERE r.i < s2.k AND s2.rn = CAST(floor(r.i * s2.n / CAST(s2.k AS DOUBLE)) AS BIGINT))
SELECT doc_id, text, lang, source, n_chars, CAST(shard AS INTEGER) AS shard,
       CAST((SELECT count(*) FROM b2 WHERE b2.shard = p.shard AND (b2.so, b2.id) <= (p.so, p.id)) AS INTEGER) AS part
FROM p
"""
