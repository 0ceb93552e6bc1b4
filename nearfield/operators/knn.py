"""Exact and inverted-file (IVF) k-nearest-neighbour search.

Two physical strategies, chosen from a size check:

* **broadcast** — the query side (vectors plus probe cells) is bounded by
  ``max_broadcast_bytes``; it is shipped once to every task and the item side
  is scanned where it lies, with no shuffle of items. Each task keeps a
  running top-k per query and emits at most k rows per query, so the merge
  volume (queries x k x item partitions) is bounded too, by
  ``max_broadcast_candidates``.
* **tiled** — otherwise. Each cell is cut into a grid of (query block,
  item block) tiles sized from per-cell counts, so a cell holding a third of
  all rows is spread over many tasks and no task holds more than one tile.
  A row goes to a bounded number of tiles, which grow with their cell instead.
  Queries are replicated over the item blocks of their cell and items over
  the query blocks; a cogrouped Arrow kernel emits only the local top-k.

Both end with ``row_number() <= k`` per query (planned as a partial and final
``WindowGroupLimit``). No pair rows are materialised and no cross join is
planned. Exact search is IVF with one cell holding everything.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators import kernels as K
from nearfield.session import cut_lineage


def _candidate_schema(query_id: str, item_id: str) -> str:
    return f"query_id {query_id}, item_id {item_id}, distance double"


@dataclass(frozen=True)
class SearchConfig:
    """Size limits of the search strategies."""

    # Largest query payload shipped to every task (vectors as float32).
    max_broadcast_bytes: int = 64 << 20
    # Largest set of coarse centres held by the driver and every task.
    max_coarse_bytes: int = 64 << 20
    # Largest tile, in rows, on each side of the tiled strategy.
    item_tile_rows: int = 16384
    query_tile_rows: int = 4096
    # Largest tile, in bytes of double-precision vectors, on each side.
    max_tile_bytes: int = 64 << 20
    # Tiles of its cell that a row is copied to at most. Where tiles of the rows above would be more,
    # they grow with the cell, up to max_tile_bytes, so that what is moved grows with the input only.
    max_copies: int = 8
    # Candidates kept in memory per task before a running top-k merge.
    merge_every_rows: int = 1 << 20
    # Shipped queries that a task takes up at once.
    query_block_rows: int = 1 << 14
    # Largest candidate volume (queries x k x item partitions) the broadcast
    # strategy may send to its final merge; past it the tiled strategy runs.
    max_broadcast_candidates: int = 1 << 28


DEFAULT_CONFIG = SearchConfig()


def parallelism(spark) -> int:
    """Cores available to the session (shuffle partitions as a fallback)."""
    return int(spark.sparkContext.defaultParallelism)


def estimated_partitions(df: DataFrame) -> int:
    """Input partitions of ``df`` estimated from Catalyst's size statistics
    and the split size (no job runs); at least the session's parallelism."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(parallelism(spark), -(-size // max(1, split)))


def final_topk(cands: DataFrame, k: int) -> DataFrame:
    """The k nearest ``(query_id, item_id, distance)`` of each query, ranked by distance, then by id."""
    w = Window.partitionBy("query_id").orderBy("distance", "item_id")
    return (
        cands.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", "item_id", F.col("rank").cast("bigint").alias("rank"), "distance")
    )


# ----------------------------------------------------------------- broadcast
def _within(items: DataFrame, bands: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Rows of the cells in ``bands (cell_id, low, high)`` whose residual lies in their cell's band.

    The widest band is a literal, so that row groups outside it are skipped on the scan; the cells prune the
    partitions of a stored index at run time."""
    bands = bands.where("low <= high").select(F.col("cell_id").cast("bigint"), "low", "high")
    n, low, high = bands.agg(F.count(F.lit(1)), F.min("low"), F.max("high")).first()
    if not n:
        return items.limit(0)
    # one row per cell: shipped while that many are proven to fit
    bands = F.broadcast(bands) if n * 64 <= cfg.max_broadcast_bytes else bands
    near = items.where(F.col("residual").between(F.lit(low), F.lit(high)))
    return near.join(bands, "cell_id").where("residual between low and high").drop("low", "high")


def _broadcast_candidates(
    items: DataFrame,
    probes: pa.Table,
    query_type: str,
    k: int,
    exclude_self: bool,
    cfg: SearchConfig,
    probed: DataFrame | None = None,
) -> DataFrame:
    """Scan ``items (item_id, embedding, cell_id)`` against a shipped probe table
    ``(query_id, embedding, cell_id)``."""
    qids_all = K.to_ids(probes.column("query_id"))
    cells_all = K.to_ids(probes.column("cell_id"))
    _, first, qpos = np.unique(K.ranks(qids_all)[0], return_index=True, return_inverse=True)
    uq = qids_all[first]
    vectors = K.to_matrix(probes.column("embedding"), dtype=np.float32)
    Q = vectors[first]
    # Q[qpos] is every probe's vector, unless an id came with several
    if not np.array_equal(Q[qpos], vectors, equal_nan=True) or len(set(zip(qpos.tolist(), cells_all.tolist()))) < len(qpos):
        raise ValueError(_REPEATED)
    K.check_finite(Q, "query")
    order = np.lexsort((qpos, cells_all))
    cell_keys, starts = np.unique(cells_all[order], return_index=True)
    ptr = np.r_[starts, len(order)]
    # Fetched once by each executor; a worker holds the arrays alone, not their pickled form besides.
    payload = items.sparkSession.sparkContext.broadcast((uq, Q, cell_keys, ptr, qpos[order]))
    merge_every, block = cfg.merge_every_rows, cfg.query_block_rows
    schema = _candidate_schema(query_type, dict(items.dtypes)["item_id"])
    qtype, xtype = (_arrow_id(t) for t in (query_type, dict(items.dtypes)["item_id"]))

    def scan(batches):
        qids, Qf, ckeys, cptr, cq = payload.value
        # the queries are taken up in ranges: of the vectors one range at a time is copied, and
        # each range has a running top-k of its own
        edges = np.arange(0, len(qids) + block, block)
        acc = [[] for _ in edges[1:]]
        held, merged = np.zeros(len(acc), np.int64), np.zeros(len(acc), np.int64)

        def merge(r):
            acc[r] = [K.merge_topk(*(np.concatenate(c) for c in zip(*acc[r])), k)]
            held[r] = merged[r] = len(acc[r][0][0])

        for rb in batches:
            if rb.num_rows == 0:
                continue
            xids = K.to_ids(rb.column("item_id"))
            X = K.to_matrix(rb.column("embedding"))
            K.check_finite(X, "item")
            xcell = K.to_ids(rb.column("cell_id"))
            xo = np.argsort(xcell, kind="stable")
            bcells, bstart = np.unique(xcell[xo], return_index=True)
            bptr = np.r_[bstart, len(xo)]
            for j, c in enumerate(bcells):
                p = np.searchsorted(ckeys, c)
                if p >= len(ckeys) or ckeys[p] != c:
                    continue
                xs = xo[bptr[j] : bptr[j + 1]]
                Xc, xc = X[xs], xids[xs]
                own = cq[cptr[p] : cptr[p + 1]]  # ascending
                cuts = np.searchsorted(own, edges)
                for r in np.flatnonzero(np.diff(cuts)):
                    qs = own[cuts[r] : cuts[r + 1]]
                    qi, xi, d = K.topk(Qf[qs], qids[qs], Xc, xc, k, exclude_self)
                    acc[r].append((qs[qi], xi, d))
                    held[r] += len(qi)
                    # what a merge left is merged again once as much has come
                    if held[r] > max(merge_every // len(acc), 2 * merged[r]):
                        merge(r)
        for r in range(len(acc)):
            if held[r]:
                merge(r)
                (q, x, d), acc[r] = acc[r][0], []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qids[q], qtype), pa.array(x, xtype), pa.array(d)], names=["query_id", "item_id", "distance"]
                )

    if probed is not None:
        # Only probed cells are read: on an index stored partitioned by cell_id this prunes
        # partitions at run time, which makes the search sub-linear.
        items = items.join(F.broadcast(probed), "cell_id", "left_semi")
    return items.select("item_id", "embedding", "cell_id").mapInArrow(scan, schema)


# --------------------------------------------------------------------- tiled
def _tile_plan(
    q_counts: dict, i_counts: dict, cfg: SearchConfig, parallelism: int, dim: int = 0
) -> list[tuple[int, int, int]]:
    """``(cell_id, item_blocks, query_blocks)`` for every cell with both sides.

    Blocks are bounded by the tile sizes in rows and, for vectors of ``dim``
    elements, in bytes; small inputs are cut finer so that there are at least
    about ``parallelism`` tiles overall. An item is copied to every query block of
    its cell and a probe to every item block: these are ``max_copies`` at most, and
    only the bound in bytes asks for more.
    """
    fit = max(1, cfg.max_tile_bytes // max(1, 8 * dim))

    def blocks(rows: int, tile_rows: int) -> int:
        return max(math.ceil(rows / fit), min(math.ceil(rows / tile_rows), cfg.max_copies))

    cells = sorted(set(q_counts) & set(i_counts))
    total_pairs = sum(q_counts[c] * i_counts[c] for c in cells)
    target = max(1, total_pairs // max(1, parallelism))
    plan = []
    for c in cells:
        qc, ic = q_counts[c], i_counts[c]
        ib = blocks(ic, cfg.item_tile_rows)
        qb = blocks(qc, cfg.query_tile_rows)
        # Split further along the query side only while a tile is above target.
        while qb < qc and (qc / qb) * (ic / ib) > target and qc / qb > 64:
            qb *= 2
        plan.append((int(c), int(ib), int(min(qb, qc))))
    return plan


def _tiled_candidates(
    probes: DataFrame, items: DataFrame, k: int, exclude_self: bool, cfg: SearchConfig, partitioned: bool
) -> DataFrame:
    spark = items.sparkSession
    types = [dict(d.dtypes)[c] for d, c in ((probes, "query_id"), (items, "item_id"))]
    schema = _candidate_schema(*types)
    qtype, xtype = map(_arrow_id, types)
    q_counts = {r["cell_id"]: r["n"] for r in probes.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = items.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).collect()
    i_counts = {r["cell_id"]: r["n"] for r in counts}
    dim = max((r["dim"] or 0 for r in counts), default=0)
    plan = _tile_plan(q_counts, i_counts, cfg, parallelism(spark), dim)
    if not plan:
        return spark.createDataFrame([], schema)
    if len(plan) == 1:
        # One cell (exact search): the block counts are plain literals.
        c, ib, qb = plan[0]
        items = items.where(F.col("cell_id") == c).withColumns({"ib": F.lit(ib), "qb": F.lit(qb)})
        probes = probes.where(F.col("cell_id") == c).withColumns({"ib": F.lit(ib), "qb": F.lit(qb)})
    else:
        # One row per cell: bounded by the number of cells, so broadcasting is safe.
        tiles = spark.createDataFrame(plan, "cell_id bigint, ib int, qb int")
        tiles = F.broadcast(cut_lineage(tiles) if partitioned else tiles)
        # Cells no query probes are never read (partition pruning when stored).
        items, probes = items.join(tiles.where("ib > 0"), "cell_id"), probes.join(tiles, "cell_id")
    it = items.select(
        "item_id",
        "embedding",
        "cell_id",
        F.pmod(F.xxhash64("item_id"), F.col("ib")).cast("int").alias("iblock"),
        F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("qblock"),
    )
    qt = probes.select(
        "query_id",
        "embedding",
        "cell_id",
        F.explode(F.sequence(F.lit(0), F.col("ib") - 1)).alias("iblock"),
        F.pmod(F.xxhash64("query_id"), F.col("qb")).cast("int").alias("qblock"),
    )

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        qids = K.to_ids(left.column("query_id"))
        xids = K.to_ids(right.column("item_id"))
        Q = K.to_matrix(left.column("embedding"), dtype=np.float32)  # as stored: widened in blocks
        qi, xi, d = K.topk(Q, qids, K.to_matrix(right.column("embedding")), xids, k, exclude_self)
        return pa.table({"query_id": pa.array(qids[qi], qtype), "item_id": pa.array(xi, xtype), "distance": pa.array(d)})

    keys = ["cell_id", "iblock", "qblock"]
    return qt.groupBy(*keys).cogroup(it.groupBy(*keys)).applyInArrow(tile, schema)


_REPEATED = "a query id is given more than once; query ids must be unique"


def _check_unique_queries(probes: DataFrame) -> None:
    """One partial aggregate: every query id has one vector and each of its cells once."""
    per_query = probes.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("cell_id").alias("cells"),
        F.min(F.xxhash64("embedding")).alias("low"),
        F.max(F.xxhash64("embedding")).alias("high"),
    )
    if not per_query.where("n != cells or low != high").isEmpty():
        raise ValueError(_REPEATED)


def id_column(df: DataFrame, name: str) -> Column:
    """A key column: strings as they are, whole numbers as bigint."""
    return F.col(name) if dict(df.dtypes)[name] == "string" else F.col(name).cast("bigint").alias(name)


def _arrow_id(spark_type: str) -> pa.DataType:
    return pa.string() if spark_type == "string" else pa.int64()


# ------------------------------------------------------------------ public
def search(
    probes: DataFrame,
    items: DataFrame,
    k: int,
    exclude_self: bool = False,
    strategy: str = "auto",
    cfg: SearchConfig = DEFAULT_CONFIG,
    max_probe_rows: int | None = None,
    dim: int | None = None,
    partitioned: bool = False,
    bands: DataFrame | None = None,
) -> DataFrame:
    """k nearest items per query, restricted to matching ``cell_id``.

    ``probes``: ``(query_id, embedding, cell_id)``, one row per probed cell.
    ``items``: ``(item_id, embedding, cell_id)``.
    Returns ``(query_id, item_id, rank, distance)`` with squared L2
    distances, ranks 1..k ordered by ``(distance, item_id)``; self matches are
    removed before ranking when ``exclude_self``. Ids are whole numbers or
    strings. Both strategies raise ``ValueError`` on a repeated query id, a
    null id, and a null, uneven or non-finite vector among the rows compared.
    ``partitioned``: the items are stored by cell, so that unprobed cells are pruned at
    run time. ``bands (cell_id, low, high)`` leaves of the items (which then have a
    ``residual``) those of these cells with residuals in the cell's band.
    """
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    if strategy not in ("auto", "broadcast", "tiled"):
        raise ValueError(f"unknown strategy {strategy!r}")
    probes = probes.select(
        id_column(probes, "query_id"), F.col("embedding").cast("array<float>"), F.col("cell_id").cast("bigint")
    )
    residual = [] if bands is None else ["residual"]
    items = items.select(
        id_column(items, "item_id"), F.col("embedding").cast("array<float>"), F.col("cell_id").cast("bigint"), *residual
    )
    if bands is not None:
        items, partitioned = _within(items, bands, cfg).drop("residual"), False
    elif partitioned:
        probes = cut_lineage(probes)  # what is shipped, and what prunes the partitions
    if strategy != "tiled":
        if max_probe_rows is None or dim is None:
            stats = probes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
            max_probe_rows, dim = stats["n"] or 0, stats["dim"] or 0
        size = max_probe_rows * dim * 4
        cands = max_probe_rows * k * estimated_partitions(items)
        if strategy == "broadcast" or (size <= cfg.max_broadcast_bytes and cands <= cfg.max_broadcast_candidates):
            if strategy == "broadcast" and size > cfg.max_broadcast_bytes:
                raise ValueError(f"query side of {size} bytes exceeds the broadcast bound")
            table = probes.toArrow()
            if table.num_rows > max_probe_rows:
                raise ValueError(f"{table.num_rows} probe rows, more than the stated bound {max_probe_rows}")
            probed = probes.where("cell_id >= 0").select("cell_id").distinct() if partitioned else None
            cands = _broadcast_candidates(items, table, dict(probes.dtypes)["query_id"], k, exclude_self, cfg, probed)
            return final_topk(cands, k)
    probes = probes if partitioned else cut_lineage(probes)  # checked, counted and tiled
    _check_unique_queries(probes)
    return final_topk(_tiled_candidates(probes, items, k, exclude_self, cfg, partitioned), k)


def knn_exact(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    exclude_self: bool = False,
    strategy: str = "auto",
    cfg: SearchConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Exact (flat) kNN: ``queries (query_id, embedding)`` against
    ``items (item_id, embedding)``."""
    one = F.lit(0).cast("bigint").alias("cell_id")
    return search(
        queries.select("query_id", "embedding", one),
        items.select("item_id", "embedding", one),
        k,
        exclude_self,
        strategy,
        cfg,
    )


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """``(n_queries, n_expected, n_found, recall)`` of approximate neighbours
    against exact ones (matching on query and item)."""
    hits = approx.select("query_id", "item_id", F.lit(1).alias("hit"))
    j = exact.select("query_id", "item_id").join(hits, ["query_id", "item_id"], "left")
    return j.agg(
        F.count_distinct("query_id").alias("n_queries"),
        F.count(F.lit(1)).alias("n_expected"),
        F.count("hit").alias("n_found"),
        F.try_divide(F.count("hit").cast("double"), F.count(F.lit(1)).cast("double")).alias("recall"),
    )
