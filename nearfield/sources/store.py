"""Index storage: run folders published by a manifest.

A save writes ``centroids`` (``cell_id, centroid``) and ``cells``
(``item_id, embedding`` partitioned by ``cell_id``) into a new folder under
``runs/`` and then a one-row ``manifest/v=<n>`` table that names it. Only a
manifest whose write finished counts, and the latest one is loaded, so a save
that is killed anywhere leaves the former index whole. Former runs stay until
their owner deletes them.

Rows are range partitioned on ``(cell_id, residual, item_id)`` before the write,
into as many ranges as the vectors' bytes ask for: each task writes a few
neighbouring cells, and a cell holding a third of all rows is still split over
many tasks. A search reads only the folders of the cells that its probes name,
found out at run time (dynamic partition pruning), and where it knows which
residuals can matter, only row groups that hold some: files are sorted by
residual and cut into small row groups. The centroids' table carries each
cell's number of rows and its smallest and largest residual.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nearfield.operators.index import IvfIndex, check_stats
from nearfield.operators.knn import id_column
from nearfield.session import cut_lineage
from nearfield.sources.catalog import is_complete, path_exists

# Vector bytes that one written range holds about.
TARGET_FILE_BYTES = 128 << 20
# Bytes of a row group, the least that a search can skip inside a file.
ROW_GROUP_BYTES = 4 << 20


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Finished manifests, oldest first."""
    if not path_exists(spark, f"{root}/manifest"):
        return []
    p, fs = _hadoop(spark, f"{root}/manifest")
    names = sorted(str(s.getPath().toString()) for s in fs.listStatus(p) if s.isDirectory())
    return [n for n in names if "/v=" in n and is_complete(spark, n)]


def file_count(n_rows: int, dim: int, target_bytes: int = TARGET_FILE_BYTES) -> int:
    """Ranges for ``n_rows`` float vectors of ``dim`` elements with their keys."""
    return max(1, -(-n_rows * (4 * dim + 16) // target_bytes))


def save_index(index: IvfIndex, path: str, num_files: int | None = None) -> None:
    """Write the index and publish it; parents are created by the writer. Rows that are checked
    while they are written (``build_index(validate="write")``) raise ``ValueError`` before anything is published."""
    spark = index.cells.sparkSession
    root = path.rstrip("/")
    run = f"runs/{uuid.uuid4().hex}"
    cells = cut_lineage(index.cells)  # counted, sampled for the ranges and written
    if index.checks is not None:
        n, _ = check_stats(index.checks.get, dim=index.dim)
    else:
        n = cells.count()
    n = num_files or file_count(n, index.dim)
    order = ("cell_id", "residual", "item_id")
    laid = cells.repartitionByRange(n, *order).sortWithinPartitions(*order)
    laid.write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy("cell_id").parquet(f"{root}/{run}/cells")
    held = spark.read.parquet(f"{root}/{run}/cells").groupBy(F.col("cell_id").cast("int").alias("cell_id"))
    held = held.agg(F.count(F.lit(1)).alias("n_items"), F.min("residual").alias("smallest"), F.max("residual").alias("largest"))
    index.centroids.select("cell_id", "centroid").join(held, "cell_id", "left").write.parquet(f"{root}/{run}/centroids")
    done = _versions(spark, root)
    last = int(done[-1].rsplit("=", 1)[-1]) if done else -1
    manifest = spark.createDataFrame([(run, index.nlist, index.dim)], "run string, nlist int, dim int")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/v={last + 1:08d}")


def _current(spark: SparkSession, root: str):
    done = _versions(spark, root)
    if not done:
        raise FileNotFoundError(
            f"no finished vector index under '{root}': build one with nearfield.plans.jobs.build_job, "
            "or with build_index and save_index, and load it from the path given there"
        )
    return spark.read.schema("run string, nlist int, dim int").parquet(done[-1]).first()


def load_index(spark: SparkSession, path: str) -> IvfIndex:
    """Read the index published last under ``path``.

    Raises ``FileNotFoundError`` naming the path and the step that builds it.
    """
    root = path.rstrip("/")
    now = _current(spark, root)
    schema = "cell_id int, centroid array<float>, n_items bigint, smallest double, largest double"
    centroids = spark.read.schema(schema).parquet(f"{root}/{now['run']}/centroids")
    cells = spark.read.parquet(f"{root}/{now['run']}/cells")
    cells = cells.select(id_column(cells, "item_id"), F.col("embedding").cast("array<float>"), F.col("cell_id").cast("int"), "residual")
    return IvfIndex(centroids=centroids, cells=cells, nlist=now["nlist"], dim=now["dim"], stored=True)


def index_bytes(spark: SparkSession, path: str) -> int:
    """Stored size of the index published last under ``path``."""
    root = path.rstrip("/")
    p, fs = _hadoop(spark, f"{root}/{_current(spark, root)['run']}")
    return int(fs.getContentSummary(p).getLength())
