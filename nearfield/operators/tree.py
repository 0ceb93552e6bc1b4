"""Cells in two levels: any number of centroids, grouped under few coarse centres.

**Training** (``train_in_levels``) never holds all centroids in one place. It
starts from a key-hashed sample of ``rows_per_cell`` rows a cell. As long as a
node of the tree wants more than ``fit_cells`` cells, it is split: a grouped
k-means finds its children from at most about ``fit_rows`` of its rows, its rows
go to their nearest child, and the children share the wanted cells by their
rows. What is left are nodes small enough to be fitted in one task each, all of
them in one grouped k-means. The centroids stay a table.

**Assignment** (``assign_in_tree``) finds the exact nearest cells without
comparing a vector with every centroid. The coarse centres are shipped to every
task; a group's radius is the distance from its centre to its farthest
centroid. A vector first meets the centroids of its nearest group; the distance
found bounds the answer, and by the triangle inequality only groups whose centre
is nearer than that distance plus their radius can hold a nearer centroid, so
only these are searched. Both rounds are the tiled search with the groups as
cells, so a group that a third of all vectors fall into is spread over tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators import kernels as K
from nearfield.operators.knn import DEFAULT_CONFIG, SearchConfig, final_topk, id_column, search
from nearfield.session import cut_lineage

# Sample rows are chosen by a hash of the key, modulo this.
HASH_RANGE = 1 << 30
# Relative slack of the group bounds, far above float64 rounding.
BOUND_MARGIN = 1e-9


@dataclass
class CellTree:
    """``centroids (cell_id, centroid, parent)`` and, on the driver, one row per group: ids, centres,
    radii and numbers of centroids."""

    centroids: DataFrame
    parents: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


# ------------------------------------------------------------------ training
def lloyd(X: np.ndarray, k: int, seed: int, max_iter: int) -> np.ndarray:
    """k-means centres of the rows of ``X``, at most ``k``: none is empty, none is repeated."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(X, axis=0)
    if len(distinct) <= k:
        return distinct
    C = distinct[np.sort(rng.choice(len(distinct), k, replace=False))]
    last = None
    for _ in range(max_iter):
        own = nearest(X, C)
        if last is not None and (own == last).all():
            break
        last = own
        count = np.bincount(own, minlength=len(C))
        order = np.argsort(own, kind="stable")
        some = np.flatnonzero(count)
        sums = np.add.reduceat(X[order], np.r_[0, np.cumsum(count[some])[:-1]], axis=0)
        C = sums / count[some][:, None]
        last = np.searchsorted(some, own)
    return np.unique(C, axis=0)


def nearest(X: np.ndarray, C: np.ndarray) -> np.ndarray:
    """Index of each row's nearest centre (of equally near ones the first)."""
    cn = np.einsum("ij,ij->i", C, C)
    out = np.empty(len(X), dtype=np.int64)
    step = max(1, K.SCORE_BLOCK // len(C))
    for s in range(0, len(X), step):
        out[s : s + step] = np.argmin(cn - 2.0 * (X[s : s + step] @ C.T), axis=1)
    return out


def _fit_groups(rows: DataFrame, wanted: dict[int, int], counts: dict[int, int], fit_rows: int, seed: int, max_iter: int) -> DataFrame:
    """``(node, child, centroid)``: k-means of each node of ``wanted`` on at most about ``fit_rows`` of its rows."""
    spark = rows.sparkSession
    plan = [(n, k, int(HASH_RANGE * min(1.0, fit_rows / max(1, counts[n])))) for n, k in sorted(wanted.items())]
    # one row per node: bounded by the number of nodes, which is far below that of cells
    plan = F.broadcast(spark.createDataFrame(plan, "node bigint, wanted int, upto bigint"))
    taken = rows.join(plan, "node").where(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(HASH_RANGE)) < F.col("upto"))

    def fit(table: pa.Table) -> pa.Table:
        node, k = table.column("node")[0].as_py(), table.column("wanted")[0].as_py()
        order = np.argsort(table.column("row").to_numpy(), kind="stable")
        C = lloyd(K.to_matrix(table.column("embedding"))[order], k, seed + node, max_iter).astype(np.float32)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, C.size + 1, C.shape[1], dtype=np.int32)), pa.array(C.reshape(-1)))
        return pa.table({"node": pa.array([node] * len(C), pa.int64()), "child": pa.array(range(len(C)), pa.int32()), "centroid": flat})

    return taken.select("node", "row", "embedding", "wanted").groupBy("node").applyInArrow(fit, "node bigint, child int, centroid array<float>")


def _share(nlist: int, counts: dict[int, int]) -> dict[int, int]:
    """``nlist`` cells dealt to nodes (not more than cells): one each, the rest in proportion to their rows,
    and no more than rows."""
    total, rest = sum(counts.values()), nlist - len(counts)
    exact = {n: 1 + rest * c / total for n, c in counts.items()}
    out = {n: min(counts[n], int(e)) for n, e in exact.items()}
    for n in sorted(exact, key=lambda n: (int(exact[n]) - exact[n], n)):
        if sum(out.values()) >= nlist:
            break
        out[n] += out[n] < counts[n]
    return out


def train_in_levels(
    vectors: DataFrame,
    nlist: int,
    seed: int = 42,
    max_iter: int = 10,
    n: int | None = None,
    rows_per_cell: int = 64,
    fit_cells: int = 1024,
    fan_out: int = 256,
    fit_rows: int = 32_768,
    cfg: SearchConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """``(cell_id, centroid)``: at most ``nlist`` cells of ``vectors (item_id, embedding)``.

    Learned from a sample of about ``rows_per_cell * nlist`` rows (all, where
    there are fewer), chosen by key; each single k-means sees at most about
    ``fit_rows`` rows and gives ``fit_cells`` or ``fan_out`` centres at most.
    Fewer cells come back where vectors repeat. ``n`` is the number of rows, if known.
    """
    if nlist <= 0:
        raise ValueError(f"nlist must be positive, got {nlist}")
    n = vectors.count() if n is None else n
    rate = min(1.0, rows_per_cell * nlist / max(1, n))
    row = F.xxhash64("item_id", F.lit(seed))
    sample = vectors.where(F.pmod(row, F.lit(HASH_RANGE)) < F.lit(int(HASH_RANGE * rate)))
    # rows are known by their key's hash: it only has to spread them, and a key that repeats is one place
    rows = cut_lineage(sample.select(F.lit(0).cast("bigint").alias("node"), F.xxhash64("item_id").alias("row"), F.col("embedding").cast("array<float>")))
    counts = {0: rows.count()}
    if not counts[0]:
        raise ValueError("no vectors to train on")
    wanted = {0: min(nlist, counts[0])}
    while big := {k: w for k, w in wanted.items() if w > fit_cells}:
        split = {k: max(2, min(fan_out, math.ceil(2 * w / fit_cells))) for k, w in big.items()}
        centres = cut_lineage(_fit_groups(rows, split, counts, fit_rows, seed, max_iter))
        rows, of_child = _deal(rows, centres, max(wanted) + 1, cfg)
        now = {r["node"]: r["n"] for r in rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}
        grown = {k: w for k, w in wanted.items() if k not in big}
        for parent, w in big.items():
            own = {c: now[c] for c, p in of_child.items() if p == parent and c in now}
            if len(own) < 2:  # equal vectors: they can't be told apart any further
                grown |= dict.fromkeys(own, 1)
            else:
                grown |= _share(w, own)
        wanted, counts = grown, now
    fitted = cut_lineage(_fit_groups(rows, wanted, counts, fit_rows, seed, max_iter))
    sizes = sorted((r["node"], r["n"]) for r in fitted.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect())
    starts = np.cumsum([0] + [s for _, s in sizes])
    first = vectors.sparkSession.createDataFrame([(n_, int(s)) for (n_, _), s in zip(sizes, starts)] or [(0, 0)], "node bigint, start int")
    return fitted.join(F.broadcast(first), "node").select((F.col("start") + F.col("child")).alias("cell_id"), "centroid")


def _deal(rows: DataFrame, centres: DataFrame, first_id: int, cfg: SearchConfig) -> tuple[DataFrame, dict[int, int]]:
    """Rows of the split nodes moved to their nearest child (children are numbered from ``first_id``), the
    others as they are; and each child's former node. The children are ``2 / fit_cells`` of all cells, so
    they fit into every task long after the cells themselves don't."""
    t = centres.orderBy("node", "child").toArrow()
    node, C = t.column("node").to_numpy(), K.to_matrix(t.column("centroid"))
    bounds = {int(k): (int(np.searchsorted(node, k)), int(np.searchsorted(node, k, "right"))) for k in np.unique(node)}
    payload = (bounds, C.astype(np.float32))

    def deal(batches):
        bounds, C = payload
        for rb in batches:
            old = rb.column("node").to_numpy()
            new, X = old.copy(), None
            for k in np.unique(old):
                if int(k) in bounds:
                    X = K.to_matrix(rb.column("embedding")) if X is None else X
                    lo, hi = bounds[int(k)]
                    at = old == k
                    new[at] = first_id + lo + nearest(X[at], C[lo:hi].astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), rb.column("row"), rb.column("embedding")], names=["node", "row", "embedding"])

    moved = cut_lineage(rows.mapInArrow(deal, "node bigint, row bigint, embedding array<float>"))
    return moved, {first_id + i: int(k) for i, k in enumerate(node)}


# ---------------------------------------------------------------- assignment
def grow(centroids: DataFrame, groups: int | None = None, seed: int = 42, cfg: SearchConfig = DEFAULT_CONFIG) -> CellTree:
    """``centroids (cell_id, centroid)`` under ``groups`` coarse centres (the square root of their number by
    default, fewer where these would not fit into ``max_coarse_bytes``)."""
    src = centroids.select(F.col("cell_id").cast("bigint").alias("item_id"), F.col("centroid").cast("array<float>").alias("embedding"))
    src = cut_lineage(src)
    n, dim = src.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        raise ValueError("no centroids")
    fit = max(1, cfg.max_coarse_bytes // max(1, 8 * dim))
    groups = min(n, fit, groups or max(1, round(n**0.5)))
    coarse = train_in_levels(src, groups, seed, n=n, cfg=cfg)
    t = coarse.select("centroid").toArrow()
    centres = K.to_matrix(t.column("centroid"))

    def group(batches):
        for rb in batches:
            X = K.to_matrix(rb.column("embedding"))
            own = nearest(X, centres)
            far = np.sqrt(np.einsum("ij,ij->i", X - centres[own], X - centres[own]))
            yield pa.RecordBatch.from_arrays(
                [rb.column("item_id"), rb.column("embedding"), pa.array(own.astype(np.int32)), pa.array(far)], names=["item_id", "embedding", "parent", "far"]
            )

    held = cut_lineage(src.mapInArrow(group, "item_id bigint, embedding array<float>, parent int, far double"))
    stats = {r["parent"]: r for r in held.groupBy("parent").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    parents = np.array(sorted(stats), dtype=np.int64)
    table = held.select(F.col("item_id").cast("int").alias("cell_id"), F.col("embedding").alias("centroid"), "parent")
    return CellTree(table, parents, centres[parents], np.array([stats[p]["far"] for p in parents]), np.array([stats[p]["n"] for p in parents]))


def group_distances(tree: CellTree, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of vectors to all coarse centres, and lower bounds of them that rounding can't break."""
    xn, cn = np.einsum("ij,ij->i", X, X), np.einsum("ij,ij->i", tree.centres, tree.centres)
    squares = np.maximum(0.0, xn[:, None] + cn[None, :] - 2.0 * (X @ tree.centres.T))
    slack = K.REL_MARGIN * (xn + cn.max()) + 1e-12
    return np.sqrt(squares), np.sqrt(np.maximum(0.0, squares - slack[:, None]))


def first_groups(tree: CellTree, X: np.ndarray, n: int) -> np.ndarray:
    """Per vector a mask of the nearest groups that together hold ``n`` centroids (all, if none do)."""
    d, _ = group_distances(tree, X)
    order = np.argsort(d, axis=1, kind="stable")
    before = np.cumsum(tree.sizes[order], axis=1) - tree.sizes[order]
    taken = np.zeros(d.shape, dtype=bool)
    np.put_along_axis(taken, order, before < n, axis=1)
    return taken


def assign_in_tree(
    vectors: DataFrame, tree: CellTree, n: int = 1, id_col: str = "item_id", cfg: SearchConfig = DEFAULT_CONFIG, work: list | None = None
) -> DataFrame:
    """``(id, embedding, cell_id, probe, distance)``: as ``assign_cells``, through the groups. ``work`` receives the
    searched groups, ``(query_id, embedding, cell_id)`` with the group as the cell."""
    src = vectors.select(id_column(vectors, id_col), F.col("embedding").cast("array<float>"))
    id_type = dict(src.dtypes)[id_col]
    light = CellTree(None, tree.parents, tree.centres, tree.radii, tree.sizes)
    cells = tree.centroids.select(F.col("cell_id").alias("item_id"), F.col("centroid").alias("embedding"), F.col("parent").alias("cell_id"))
    step = max(1, K.SCORE_BLOCK // max(1, len(tree.centres)))

    def listed(mask: np.ndarray) -> pa.Array:
        ends = np.r_[0, np.cumsum(mask.sum(1))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(light.parents[np.nonzero(mask)[1]]))

    def first(batches):
        for rb in batches:
            for s in range(0, rb.num_rows, step):
                part = rb.slice(s, step)
                X = K.to_matrix(part.column("embedding"))
                K.check_finite(X, "item")
                yield pa.RecordBatch.from_arrays([*part.columns, listed(first_groups(light, X, n))], names=[*part.schema.names, "met"])

    def further(batches):
        """The groups not met yet that may hold something as near as what was found."""
        for rb in batches:
            for s in range(0, rb.num_rows, step):
                part = rb.slice(s, step)
                _, low = group_distances(light, K.to_matrix(part.column("embedding")))
                upto = np.sqrt(part.column("upto").to_numpy(zero_copy_only=False))
                mask = low - light.radii[None, :] * (1 + BOUND_MARGIN) <= (upto * (1 + BOUND_MARGIN))[:, None]
                for i, met in enumerate(part.column("met").to_pylist()):
                    mask[i, np.searchsorted(light.parents, met)] = False
                some = pa.array(mask.any(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_tag").filter(some), part.column("embedding").filter(some), listed(mask[mask.any(1)])], names=["row_tag", "embedding", "met"]
                )

    # Rows are told apart by a tag, fixed by writing it: ids may repeat.
    tagged = src.withColumn("row_tag", F.monotonically_increasing_id())
    tagged = cut_lineage(tagged.mapInArrow(first, f"{id_col} {id_type}, embedding array<float>, row_tag bigint, met array<bigint>"))
    probes = lambda df: df.select(F.col("row_tag").alias("query_id"), "embedding", F.explode("met").alias("cell_id"))
    found = cut_lineage(search(probes(tagged), cells, n, strategy="tiled", cfg=cfg))
    bound = found.groupBy("query_id").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("held"))
    # with fewer than n centroids found, all groups were searched
    bound = bound.select(F.col("query_id").alias("row_tag"), F.when(F.col("held") == n, F.col("far")).otherwise(F.lit(float("inf"))).alias("upto"))
    more = tagged.select("row_tag", "embedding", "met").join(bound, "row_tag").mapInArrow(further, "row_tag bigint, embedding array<float>, met array<bigint>")
    more = cut_lineage(probes(more))
    again = search(more, cells, n, strategy="tiled", cfg=cfg)
    if work is not None:
        work += [probes(tagged), more]
    found = final_topk(found.drop("rank").unionByName(again.drop("rank")), n)
    found = found.select(F.col("query_id").alias("row_tag"), F.col("item_id").cast("int").alias("cell_id"), F.col("rank").cast("int").alias("probe"), "distance")
    return tagged.select("row_tag", id_col, "embedding").join(found, "row_tag").select(id_col, "embedding", "cell_id", "probe", "distance")
