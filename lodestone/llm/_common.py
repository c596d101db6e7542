"""What the operators share: tidy inputs, row identity, written tables, joins whose small side is measured."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._text import give_back

#: Rows of narrow keys that are broadcast at most (about 64 MB as a hashed relation); beyond it the join shuffles.
BROADCAST_ROWS = 1_500_000

RID = "__rid"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def tidy(df: DataFrame, own: Sequence[str] = ()) -> DataFrame:
    """df without columns whose names, whatever their case, repeat an earlier one or one of `own`.

    An operator passes the names that it adds, so an input column of such a name gives way to the operator's.
    """
    seen, names, kept = {o.lower() for o in own}, [], []
    for i, c in enumerate(df.columns):
        if c.lower() in seen:
            names.append(f"__dropped_{i}")
        else:
            seen.add(c.lower())
            names.append(c)
            kept.append(c)
    if len(kept) == len(names):
        return df
    return df.toDF(*names).select(*[F.col(quoted(c)) for c in kept])


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Just the named columns, cast; a missing one is null. Casts that fail give null."""
    df = tidy(df)
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (F.col(quoted(have[n.lower()])).try_cast(t) if n.lower() in have else F.lit(None).cast(t)).alias(n)
            for n, t in types.items()
        ]
    )


def numbered(df: DataFrame) -> DataFrame:
    """df with a row number in __rid, the same whenever the same input is read again.

    A table that is read from files, and any plan whose partitions don't depend on timing, is numbered alike each time;
    so a lost executor's tasks give the same numbers again.
    """
    return tidy(df, [RID]).withColumn(RID, F.monotonically_increasing_id())


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder of a local session, as in tests. A cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """df, a written table of narrow rows, marked for broadcast if it is counted to be small enough.

    Rows that hold lists count by `weight`, their number of entries.
    """
    few = df.limit(rows + 1)
    n = few.count() if weight is None else few.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= rows else df.hint("shuffle_merge")


def without_rows(docs: DataFrame, dropped: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs (numbered) without the rows whose __rid is in `dropped`, a written table; __rid goes."""
    return docs.join(small(dropped.select(RID), rows), RID, "left_anti").drop(RID)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over Arrow batches, in place: no shuffle. After its task the worker, which stays for later ones, gives its memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out
        batch = out = None
        give_back()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
