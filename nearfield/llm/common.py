"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import sys
import tempfile
import types

from pyspark.sql import DataFrame, SparkSession

from nearfield.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the session names; a fresh one on a local master that names none."""
    named = checkpoint_dir(spark)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="nearfield-checkpoint-"))
    return checkpoint_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that later jobs read it instead of recomputing it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps removed now.

    Spark removes them once the driver has collected the plans that made them; a driver that
    only plans seldom collects, and many small steps fill the disks meanwhile. What is still
    referenced stays."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def per_process(key: tuple, build):
    """``build()`` once in each Python worker process, whichever task asks first.

    Functions travel to the workers by value, so module globals start afresh
    with each task; a module of its own in ``sys.modules`` outlives them.
    """
    held = sys.modules.setdefault("nearfield_worker_state", types.ModuleType("nearfield_worker_state")).__dict__
    if key not in held:
        held[key] = build()
    return held[key]


def slices(batch, max_rows: int, columns: list[str]):
    """Column lists of an Arrow batch, ``max_rows`` rows at a time."""
    for lo in range(0, batch.num_rows, max_rows):
        part = batch.slice(lo, max_rows)
        yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]
