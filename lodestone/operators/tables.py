"""Tables written once to the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder of a local session, as in tests. A cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="facts-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    return folder.rstrip("/")


class Grown:
    """A table that grows by written parts; it is read as one scan, so a loop's plan stays small."""

    def __init__(self, first: DataFrame):
        self.spark, self.schema, self.paths = first.sparkSession, first.schema, []
        self.add(first)

    def add(self, part: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/facts-{uuid.uuid4().hex}"
        part.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def written(df: DataFrame) -> DataFrame:
    """df written and read back: lineage ends here, and lost executors cost no recomputation."""
    return Grown(df).table()
