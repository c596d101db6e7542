"""Incremental maintenance with Structured Streaming: watch loops, merges, baselines, windows and repository states."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lodestone.operators.diagnostics import compared


def watched(spark: SparkSession, folder: str, schema: StructType, checkpoint: str, on_batch: Callable[[DataFrame, int], None], every: str | None = "30 seconds") -> StreamingQuery:
    """Hands new Parquet files in a folder to on_batch, every so often; None takes what is there and stops.

    The checkpoint remembers what was done, so a restarted run goes on after the last complete batch.
    """
    w = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if every is None else w.trigger(processingTime=every)).start()


def merged_inventory(old: DataFrame, scanned: DataFrame, new: DataFrame, key: Sequence[str] = ("repo", "module")) -> DataFrame:
    """Rows of modules that weren't scanned again stay; scanned modules' rows are the new ones."""
    return old.join(scanned.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def cleaned(tables: dict[str, DataFrame], gone: DataFrame, columns: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Each table without the rows whose named columns are, or are in, a deleted file (repo, path)."""
    files = gone.select(F.concat_ws(":", "repo", "path").alias("__f")).distinct()
    out = {}
    for name, df in tables.items():
        for c in columns[name]:
            df = df.withColumn("__f", F.substring_index(c, "#", 1)).join(files, "__f", "left_anti").drop("__f")
        out[name] = df
    return out


def limited_to(df: DataFrame, affected: DataFrame, column: str = "path") -> DataFrame:
    """Only rows of affected files."""
    return df.join(affected.select(F.col("node").alias(column)).distinct(), column, "left_semi")


def pending_phases(done: DataFrame, phases: Sequence[str]) -> DataFrame:
    """(repo, phase): where each repo's run resumes, after the last phase whose predecessors are complete too."""
    order = F.array(*[F.lit(p) for p in phases])
    per = done.groupBy("repo").agg(F.collect_set("phase").alias("have"))
    return per.select("repo", F.get(F.filter(order, lambda p: ~F.array_contains("have", p)), F.lit(0)).alias("phase"))


def baseline_sink(baseline: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch's comparison with the baseline; a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        compared(batch, baseline).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events and values by type and time window, on a stream or a table; a stream drops what is later than the watermark."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def co_changes(events: DataFrame, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, a, b): pairs of unlike events of a user less than `within` apart; an interval join with state that expires."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    a = events.select(F.col("user_id").alias("ua"), F.col("ts").alias("ta"), F.col("event_id").alias("a"), F.col("event_type").alias("ka"))
    b = events.select(F.col("user_id").alias("ub"), F.col("ts").alias("tb"), F.col("event_id").alias("b"), F.col("event_type").alias("kb"))
    near = F.expr(f"ua = ub AND tb >= ta AND tb < ta + interval {within} AND ka < kb")
    return a.join(b, near).select(F.col("ua").alias("user_id"), "a", "b")


TRANSITIONS = {("candidate", "index"): "indexing", ("candidate", "ignore"): "ignored", ("indexing", "done"): "indexed", ("indexing", "fail"): "candidate", ("indexed", "index"): "indexing", ("ignored", "restore"): "candidate"}


def next_state(state: str, action: str) -> str:
    """The next state of a repository; an illegal action is an error."""
    try:
        return TRANSITIONS[state, action]
    except KeyError:
        raise ValueError(f"{action} isn't possible in state {state}") from None


def folded_states(actions: DataFrame) -> DataFrame:
    """(repo, status, rejected) after all actions (repo, ord, action), in order; illegal ones are counted and change nothing."""
    ordered = actions.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("ord", "action"))).alias("xs"))
    table = F.create_map(*[F.lit(x) for (s, a), t in TRANSITIONS.items() for x in (f"{s}/{a}", t)])
    start = F.struct(F.lit("candidate").alias("s"), F.lit(0).cast("bigint").alias("r"))

    def step(acc, x):
        to = F.try_element_at(table, F.concat_ws("/", acc.s, x.action))
        return F.struct(F.coalesce(to, acc.s).alias("s"), (acc.r + F.when(to.isNull(), 1).otherwise(0)).alias("r"))

    return ordered.withColumn("f", F.aggregate("xs", start, step)).select("repo", F.col("f.s").alias("status"), F.col("f.r").alias("rejected"))


def streamed_states(actions: DataFrame) -> DataFrame:
    """folded_states() over a stream: each repo's state is kept between batches."""

    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, rejected = state.get if state.exists else ("candidate", 0)
        for action in pd.concat(list(batches)).sort_values("ord")["action"]:
            if (status, action) in TRANSITIONS:
                status = TRANSITIONS[status, action]
            else:
                rejected += 1
        state.update((status, rejected))
        yield pd.DataFrame({"repo": [key[0]], "status": [status], "rejected": [rejected]})

    kind = "status string, rejected bigint"
    return actions.groupBy("repo").applyInPandasWithState(run, f"repo string, {kind}", kind, "update", GroupStateTimeout.NoTimeout)


def state_summary(states: DataFrame) -> DataFrame:
    """(status, n) of all statuses, with zeros."""
    every = states.sparkSession.createDataFrame([(s,) for s in ("candidate", "ignored", "indexed", "indexing")], "status string")
    return every.join(states.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))
