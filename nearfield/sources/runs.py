"""Resumable stage outputs: run folders bucketed by key.

Each run of a stage writes its new rows to a fresh ``run=<n>`` folder, which
counts only once its ``_SUCCESS`` marker exists, so a run that is killed loses
at most its own folder. All folders of a store share one bucketing by the
stage's keys, fixed when the store is made (``layout``). A rerun leaves out
what is done by left-anti joins with the finished folders, bucket by bucket:
the keys to do are dealt into the buckets once, and what is done is read where
it lies and never shuffled, however much it has grown.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.sources.catalog import is_complete, path_exists

# Rows a bucket is meant to hold when its store is filled once over.
ROWS_PER_BUCKET = 1_000_000


def run_folders(spark: SparkSession, root: str) -> list[str]:
    """All run folders below ``root``, finished or not."""
    if not path_exists(spark, root):
        return []
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(str(s.getPath().toString()) for s in fs.listStatus(p) if s.isDirectory())
    return [n for n in names if n.rsplit("/", 1)[-1].startswith("run=")]


class KeyedRuns:
    """The finished runs below ``root``; ``rows`` (about how many keys there will be) and ``rows_per_bucket``
    decide the number of buckets when the store is made."""

    def __init__(
        self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], rows: int = 0, rows_per_bucket: int = ROWS_PER_BUCKET
    ):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, keys
        layout = f"{self.root}/layout"
        if not is_complete(spark, layout):
            n = max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_bucket))
            spark.createDataFrame([(n, list(keys))], "buckets int, keys array<string>").coalesce(1).write.mode("overwrite").parquet(layout)
        self.buckets, made_for = spark.read.schema("buckets int, keys array<string>").parquet(layout).first()
        if made_for != list(keys):
            raise ValueError(f"the store '{self.root}' is bucketed by {made_for}, not by {list(keys)}")

    def finished(self) -> list[DataFrame]:
        """One bucketed table per finished run."""
        return [self._table(f) for f in run_folders(self.spark, self.root) if is_complete(self.spark, f)]

    def _table(self, folder: str) -> DataFrame:
        name = f"run_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        keys = ", ".join(f"`{k}`" for k in self.keys)
        where = folder.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{where}'"
        )
        table = self.spark.table(name).select(*self.schema.fieldNames())
        table.schema  # resolved: the files and their bucketing are known from here on
        self.spark.sql(f"DROP TABLE {name}")  # the folder stays
        return table

    def read(self) -> DataFrame:
        """The rows of all finished runs."""
        out = self.spark.createDataFrame([], self.schema)
        for run in self.finished():
            out = out.unionByName(run)
        return out

    def pending(self, todo: DataFrame) -> DataFrame:
        """The rows of ``todo`` whose key no finished run has."""
        for run in self.finished():
            todo = todo.join(run.select(*self.keys).hint("merge"), self.keys, "left_anti")
        return todo

    def of(self, keys: DataFrame) -> DataFrame:
        """The finished rows of these keys."""
        out = self.spark.createDataFrame([], self.schema)
        for run in self.finished():
            out = out.unionByName(run.join(keys.select(*self.keys), self.keys, "left_semi"))
        return out

    def append(self, new: DataFrame) -> None:
        """Write ``new`` as a run of its own."""
        used = [int(f.rsplit("=", 1)[-1]) for f in run_folders(self.spark, self.root)]
        target = f"{self.root}/run={max(used, default=-1) + 1:05d}"
        name = f"run_{uuid.uuid4().hex}"
        rows = new.select([F.col(f.name).cast(f.dataType) for f in self.schema.fields]).repartition(self.buckets, *self.keys)
        rows.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", target).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
