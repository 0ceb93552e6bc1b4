"""Inverted-file (IVF-Flat) vector index: validate, train, assign, search.

An index is two tables: ``centroids(cell_id, centroid)`` and
``cells(item_id, embedding, cell_id)``. Vectors are stored exactly (flat);
search probes the ``nprobe`` nearest cells of each query and scores exactly
inside them.

Cell assignment ships the centroids (nlist x dim, size-checked) to every
task and scores each Arrow batch with BLAS: no shuffle and no centroid-fold
row blow-up. Past the size bound the centroids are grouped under coarse centres
and only the groups that can hold a nearest one are searched (``tree``), on a
tag per row, so both forms return the same cells for the same rows, repeated
ids included. Training past that bound goes level by level in the same way.

Each indexed row keeps its residual, the distance to its cell's centroid. A
query that has found k rows within distance u needs, of a further cell at
distance c, only rows with residuals from c - u to c + u (triangle inequality),
and no row of a cell whose residuals all lie outside; a stored index is sorted
by residual, so that row groups outside are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from nearfield.functions.vectors import bad_vector
from nearfield.operators import kernels as K
from nearfield.operators.knn import DEFAULT_CONFIG, SearchConfig, final_topk, id_column, search
from nearfield.operators.tree import CellTree, assign_in_tree, grow, train_in_levels
from nearfield.session import cut_lineage


@dataclass
class IvfIndex:
    centroids: DataFrame  # cell_id int, centroid array<float>
    cells: DataFrame  # item_id bigint or string, embedding array<float>, cell_id int, residual double
    nlist: int
    dim: int
    # Read back from a store, where cells are partitions: searches prune them at run time.
    stored: bool = False
    # Statistics of the rows, observed while they are written; None when they were checked before.
    checks: Observation | None = field(default=None, repr=False)
    # (cell ids, centroid matrix) once fetched, or False when too large to ship.
    _matrix: object = field(default=None, repr=False)
    _tree: CellTree | None = field(default=None, repr=False)

    def centroid_matrix(self, cfg: SearchConfig = DEFAULT_CONFIG):
        """Centroids as driver-side arrays (size-checked), fetched once."""
        if self._matrix is None:
            self._matrix = _centroid_matrix(self.centroids, cfg, self.nlist, self.dim) or False
        return self._matrix or None

    def cell_tree(self, cfg: SearchConfig = DEFAULT_CONFIG) -> CellTree | None:
        """The centroids under coarse centres, grown once, where they are too large to ship."""
        if self.centroid_matrix(cfg) is not None:
            return None
        if self._tree is None:
            self._tree = grow(self.centroids, cfg=cfg)
        return self._tree


def _stats(dim: int | None, col: str = "embedding") -> list:
    c = F.col(col)
    size = F.size(c)
    bad = c.isNull() | F.exists(c, lambda x: x.isNull() | F.isnan(x)) if dim is None else bad_vector(c, dim)
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(c.isNull()).alias("n_null"),
        F.min(F.when(c.isNotNull(), size)).alias("dim_min"),
        F.max(F.when(c.isNotNull(), size)).alias("dim_max"),
        F.count_if(bad).alias("n_bad"),
    ]


def vector_stats(df: DataFrame, dim: int | None = None, col: str = "embedding") -> DataFrame:
    """One row: ``n_rows, n_null, dim_min, dim_max, n_bad`` (one aggregate).

    ``n_bad`` counts null vectors, vectors whose size differs from ``dim``
    (from ``dim_min`` when not given) and vectors with a null or NaN element.
    """
    return df.agg(*_stats(dim, col))


def observed(df: DataFrame, dim: int | None = None) -> tuple[DataFrame, Observation]:
    """``df`` and an observation that holds its vector statistics once a job has read it: no scan of its own."""
    seen = Observation()
    return df.observe(seen, *_stats(dim)), seen


def check_stats(r, nlist: int | None = None, dim: int | None = None) -> tuple[int, int]:
    """Raise ``ValueError`` on what ``vector_stats`` counted; return ``(n, dim)``."""
    n = r["n_rows"]
    if n == 0:
        raise ValueError("no vectors to index")
    if r["n_null"]:
        raise ValueError(f"{r['n_null']} null vectors")
    if r["dim_min"] != r["dim_max"] or (dim is not None and r["dim_min"] != dim):
        raise ValueError(f"vectors must all have dimension {dim or r['dim_min']}, got {r['dim_min']}..{r['dim_max']}")
    if r["n_bad"]:
        raise ValueError(f"{r['n_bad']} vectors hold null or NaN elements")
    if nlist is not None and n < nlist:
        raise ValueError(f"{n} vectors cannot fill {nlist} cells: pass nlist of at most {n}")
    return n, int(r["dim_min"])


def validate_vectors(df: DataFrame, nlist: int | None = None, dim: int | None = None) -> tuple[int, int]:
    """Raise ``ValueError`` on bad vectors or too few rows; return ``(n, dim)``.

    Elements must be single-precision floats (cast first if they are not).
    """
    _check_float32(df)
    return check_stats(vector_stats(df, dim).first(), nlist, dim)


def validate_query(df: DataFrame, dim: int) -> int:
    """Query vectors must be non-null, finite and of the index dimension; returns their number."""
    _check_float32(df)
    r = vector_stats(df, dim).first()
    if r["n_bad"]:
        raise ValueError(f"{r['n_bad']} query vectors are null, NaN or not of dimension {dim}")
    return r["n_rows"]


def _check_float32(df: DataFrame, col: str = "embedding") -> None:
    kind = dict(df.dtypes)[col]
    if kind != "array<float>":
        raise ValueError(f"column '{col}' is {kind}; vectors must be array<float>")


def _centroid_matrix(centroids: DataFrame, cfg: SearchConfig, max_rows: int | None = None, dim: int | None = None):
    """``(cell_ids, matrix)`` on the driver, or None past the broadcast bound.

    With a known row bound and dimension the size is proven without a
    counting pass; otherwise the rows are counted first.
    """
    if max_rows is None or dim is None:
        stats = centroids.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("dim")).first()
        max_rows, dim = stats["n"] or 0, stats["dim"] or 0
    if max_rows * dim * 8 > cfg.max_broadcast_bytes:
        return None
    t = centroids.select(F.col("cell_id").cast("bigint"), F.col("centroid").cast("array<float>")).toArrow()
    if t.num_rows > max_rows:
        raise ValueError(f"{t.num_rows} centroids, more than the stated bound {max_rows}")
    return K.to_ids(t.column("cell_id")), K.to_matrix(t.column("centroid"))


def assign_cells(
    vectors: DataFrame,
    centroids: DataFrame,
    n: int = 1,
    id_col: str = "item_id",
    cfg: SearchConfig = DEFAULT_CONFIG,
    matrix=None,
    tree: CellTree | None = None,
) -> DataFrame:
    """``(id, embedding, cell_id, probe, distance)``: the ``n`` nearest cells of each
    vector, ``probe`` 1..n by ``(distance, cell_id)``, squared L2 distances.

    ``matrix`` may carry the centroids already fetched as ``(ids, matrix)``, ``tree`` those already grouped.
    """
    src = vectors.select(id_column(vectors, id_col), F.col("embedding").cast("array<float>"))
    id_type = dict(src.dtypes)[id_col]
    mat = matrix if matrix is not None or tree is not None else _centroid_matrix(centroids, cfg)
    if mat is None:
        return assign_in_tree(src, tree or grow(centroids, cfg=cfg), n, id_col, cfg)
    # Shipped in the task closure (broadcast by PySpark above its threshold).
    def nearest(batches):
        cids, C = mat
        for rb in batches:
            if rb.num_rows == 0:
                continue
            # Rows are compared by position, and ids only carried through.
            rows = np.arange(rb.num_rows, dtype=np.int64)
            qi, ci, d = K.topk(K.to_matrix(rb.column("embedding")), rows, C, cids, n)
            probe = np.arange(len(qi)) - np.searchsorted(qi, qi)
            yield pa.RecordBatch.from_arrays(
                [
                    rb.column(id_col).take(pa.array(qi)),
                    rb.column("embedding").take(pa.array(qi)),
                    pa.array(ci.astype(np.int32)),
                    pa.array((probe + 1).astype(np.int32)),
                    pa.array(d),
                ],
                names=[id_col, "embedding", "cell_id", "probe", "distance"],
            )

    schema = f"{id_col} {id_type}, embedding array<float>, cell_id int, probe int, distance double"
    return src.mapInArrow(nearest, schema)


def train_centroids(
    vectors: DataFrame,
    nlist: int,
    seed: int = 42,
    max_iter: int = 20,
    sample_fraction: float | None = None,
    dim: int | None = None,
    cfg: SearchConfig = DEFAULT_CONFIG,
    n: int | None = None,
    rows_per_cell: int = 256,
) -> DataFrame:
    """k-means centroids with Spark ML (distributed Lloyd iterations).

    Returns ``(cell_id, centroid)``; k-means may return fewer than ``nlist``
    cells on duplicate-heavy data. ``sample_fraction`` trains on a sample (of
    keys, so the same rows whatever the file layout); without it, and where the
    number ``n`` of vectors is given, on about ``rows_per_cell`` rows a cell (all,
    where there are fewer). One cell has the mean vector of all rows as its centroid. k-means keeps
    all centres on the driver and in every task; where these would exceed
    ``max_broadcast_bytes``, the cells are trained level by level instead (``train_in_levels``).
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    if nlist <= 0:
        raise ValueError(f"nlist must be positive, got {nlist}")
    if dim is None:
        dim = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    src = vectors
    if sample_fraction is None and nlist > 1 and n and n > rows_per_cell * nlist:
        sample_fraction = rows_per_cell * nlist / n
    if sample_fraction is not None:
        src = vectors.where(F.pmod(F.xxhash64("item_id", F.lit(seed)), F.lit(1_000_000)) < F.lit(sample_fraction * 1e6))
    if nlist * dim * 8 > cfg.max_broadcast_bytes:
        return train_in_levels(src, nlist, seed, max_iter, cfg=cfg)
    # Sorted by key, so the layout of the input files decides nothing.
    feats = src.orderBy("item_id").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if nlist == 1:
        mean = feats.agg(vector_to_array(Summarizer.mean(F.col("features"))).cast("array<float>").alias("centroid"))
        return mean.select(F.lit(0).alias("cell_id"), "centroid")
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="features").fit(feats)
    rows = [(i, [float(x) for x in np.asarray(c, dtype=np.float32)]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell_id int, centroid array<float>")


def default_nlist(n: int) -> int:
    """Square root of the number of vectors, one at least."""
    return max(1, round(n**0.5))


def build_index(
    vectors: DataFrame,
    nlist: int | None = None,
    centroids: DataFrame | None = None,
    seed: int = 42,
    max_iter: int = 20,
    sample_fraction: float | None = None,
    validate: bool | str = True,
    dim: int | None = None,
    cfg: SearchConfig = DEFAULT_CONFIG,
) -> IvfIndex:
    """Validate, train (unless ``centroids`` are supplied) and assign.

    ``vectors``: ``(item_id, embedding)``; ``nlist`` defaults to the square root
    of their number (of the supplied centroids'). Supplied centroids are fetched once
    (at most ``nlist`` rows, checked). ``validate=False`` skips the checking
    pass for vectors valid by construction; ``dim`` must then be given.
    ``validate="write"`` (``dim`` given too) leaves the checks to the write: ``save_index``
    counts what it writes and raises before it publishes a bad index.
    """
    n, seen = None, None
    if validate == "write" and dim is not None:
        _check_float32(vectors)
        checked, seen = observed(vectors, dim)
    elif validate:
        n, dim = validate_vectors(vectors, nlist if centroids is None else None, dim)
        checked = vectors
    elif dim is None:
        raise ValueError("dim is required when validate=False")
    else:
        checked = vectors
    if nlist is None:
        nlist = default_nlist(n if n is not None else vectors.count()) if centroids is None else centroids.count()
    if centroids is None:
        centroids = train_centroids(vectors, nlist, seed, max_iter, sample_fraction, dim, cfg, n)
    else:
        centroids = centroids.select(F.col("cell_id").cast("int"), F.col("centroid").cast("array<float>"))
    index = IvfIndex(centroids=centroids, cells=None, nlist=nlist, dim=dim, checks=seen)
    if seen is not None:
        # only what the kernels can take reaches them; the rest is counted, and raised after the write
        checked = checked.where(~bad_vector(F.col("embedding"), dim))
    cells = assign_cells(checked, centroids, 1, cfg=cfg, matrix=index.centroid_matrix(cfg), tree=index.cell_tree(cfg))
    index.cells = cells.select("item_id", "embedding", "cell_id", F.sqrt("distance").alias("residual"))
    return index


def knn_ivf(
    queries: DataFrame,
    index: IvfIndex,
    k: int = 10,
    nprobe: int = 1,
    exclude_self: bool = False,
    strategy: str = "auto",
    cfg: SearchConfig = DEFAULT_CONFIG,
    max_queries: int | None = None,
    validate: bool = True,
    prune: bool = False,
    read: list | None = None,
) -> DataFrame:
    """IVF search: probe the ``nprobe`` nearest cells, exact distance inside.

    ``queries``: ``(query_id, embedding)``. Returns ``(query_id, item_id, rank,
    distance)``; fewer than k rows when the probed cells hold fewer items.
    ``max_queries`` is a proven bound on the query count (e.g. a seed list),
    which lets the broadcast strategy skip its counting pass. ``validate``
    checks the query vectors first (one aggregate) and raises ``ValueError``
    on vectors that are null, hold NaN, or differ in type or dimension from
    the index; switch it off only for queries taken from the index itself.

    ``prune`` searches each query's nearest cell first and reads of the other cells only rows
    whose residual allows a nearer neighbour: the same neighbours from fewer rows, for one
    more job. It pays where cells are large and k small against them. ``read`` receives the
    rows that were read, as tables ``(cell_id, residual)``.
    """
    if nprobe <= 0:
        raise ValueError(f"nprobe must be positive, got {nprobe}")
    # The number of queries bounds the probes, so their assignment runs once, for the search itself.
    n_queries = validate_query(queries, index.dim) if validate else None
    if max_queries is None:
        max_queries = n_queries if n_queries is not None else queries.count()
    probes = assign_cells(
        queries, index.centroids, nprobe, id_col="query_id", cfg=cfg, matrix=index.centroid_matrix(cfg), tree=index.cell_tree(cfg)
    )
    if prune and nprobe > 1:
        return _knn_pruned(probes, index, k, nprobe, exclude_self, strategy, cfg, max_queries, read)
    probes = probes.select("query_id", "embedding", "cell_id")
    return search(
        probes, index.cells, k, exclude_self, strategy, cfg, max_probe_rows=max_queries * nprobe, dim=index.dim, partitioned=index.stored
    )


# Slack of the residual bounds: residuals and distances are double, far within it.
RESIDUAL_MARGIN = 1e-6


def _knn_pruned(probes, index, k, nprobe, exclude_self, strategy, cfg, max_queries, read) -> DataFrame:
    probes = cut_lineage(probes)
    near = probes.where("probe = 1").select("query_id", "embedding", "cell_id")
    how = {"exclude_self": exclude_self, "strategy": strategy, "cfg": cfg, "dim": index.dim, "partitioned": index.stored}
    found = cut_lineage(search(near, index.cells, k, max_probe_rows=max_queries, **how))
    far = found.groupBy("query_id").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("held"))
    # with fewer than k found, any distance may count
    reach = F.when(F.col("held") == k, F.sqrt("far") * (1 + RESIDUAL_MARGIN) + RESIDUAL_MARGIN).otherwise(F.lit(float("inf")))
    others = probes.where("probe > 1").join(far, "query_id", "left").withColumn("at", F.sqrt("distance"))
    others = others.withColumn("reach", F.coalesce(reach, F.lit(float("inf"))))
    others = others.select("query_id", "embedding", "cell_id", (F.col("at") - F.col("reach")).alias("low"), (F.col("at") + F.col("reach")).alias("high"))
    sizes = cell_bounds(index)
    others = cut_lineage(others.join(sizes, "cell_id").where("low <= largest and high >= smallest").select("query_id", "embedding", "cell_id", "low", "high"))
    # one row per cell still probed
    bands = cut_lineage(others.groupBy("cell_id").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    again = search(others.drop("low", "high"), index.cells, k, max_probe_rows=max_queries * (nprobe - 1), bands=bands, **how)
    if read is not None:
        near_cells = near.select("cell_id").distinct()
        read += [index.cells.join(near_cells, "cell_id", "left_semi").select("cell_id", "residual"),
                 index.cells.join(bands, "cell_id").where("residual between low and high").select("cell_id", "residual")]
    return final_topk(found.drop("rank").unionByName(again.drop("rank")), k)


def cell_bounds(index: IvfIndex) -> DataFrame:
    """``(cell_id, smallest, largest)`` residual of every cell: stored with the centroids, else one aggregate."""
    if "largest" in index.centroids.columns:
        return index.centroids.select("cell_id", "smallest", "largest").where("largest is not null")
    return index.cells.groupBy("cell_id").agg(F.min("residual").alias("smallest"), F.max("residual").alias("largest"))
