"""Tables written between steps, so that long plans survive a lost executor.

Round loops and range slices need a result that will not be computed again with
other partition bounds. They write it to the folder every executor can reach and
read it back, which also gives the next step real file sizes to plan with.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a temporary folder only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="supplyscope-")
    return _local_folders[app]


class Stage:
    """A set of tables of one schema that grows by appending one folder per round."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.schema = None

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths):05d}"
        df.write.parquet(path)
        self.schema = df.schema if self.schema is None else self.schema
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add_counted(self, df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
        """`add`, and aggregates of the rows taken while they are written, without a second job."""
        seen = Observation()
        rows = self.add(df.observe(seen, *[c.alias(n) for n, c in counts.items()]))
        return rows, seen.get

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def by_shuffle(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that shuffles both: a broadcast passes through the driver, and those of many rounds add up."""
    return df.hint("merge")


def settle(df: DataFrame) -> DataFrame:
    """Write `df` once and return a scan of what was written."""
    return Stage(df.sparkSession).add(df)
