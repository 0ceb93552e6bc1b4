"""Session helpers: a local builder for tests/bench and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cpus: int | str = "*",
    shuffle_partitions: int = 8,
    app: str = "nearfield",
    checkpoint_dir: str | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """A local session with the settings the library is tuned for.

    A checkpoint folder is set only when the session has none; on a cluster
    the shared folder named in ``spark.checkpoint.dir`` is used as given.
    """
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # A folder of this machine serves local masters only; a cluster names its own.
    local = spark.sparkContext.master.startswith("local")
    if checkpoint_dir is not None and spark.sparkContext.getCheckpointDir() is None:
        if not local and (checkpoint_dir.startswith("file:") or "://" not in checkpoint_dir):
            raise ValueError("executors of a cluster do not share local folders; set spark.checkpoint.dir to a shared one")
        os.makedirs(checkpoint_dir, exist_ok=True)
        spark.sparkContext.setCheckpointDir(checkpoint_dir)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder of the session, if any."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = sc.getConf().get("spark.checkpoint.dir")
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    return None


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; a fresh one of
    this machine where a local master names none."""
    named = checkpoint_dir(spark)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nearfield-checkpoint-"))
    return checkpoint_dir(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, so later jobs read it instead of
    recomputing it and a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
