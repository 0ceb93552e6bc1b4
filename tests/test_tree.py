"""Cells in two levels, run-time pruning and residual bounds, against flat forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import index as IX
from nearfield.operators.index import assign_cells, build_index, knn_ivf, train_centroids
from nearfield.operators.knn import SearchConfig, knn_exact
from nearfield.operators.tree import _share, assign_in_tree, first_groups, grow, lloyd, train_in_levels
from nearfield.session import cut_lineage
from nearfield.sources.store import load_index, save_index

# Nothing fits into a broadcast: the forms for many cells.
LARGE = SearchConfig(max_broadcast_bytes=0, item_tile_rows=512, query_tile_rows=256)


def table(spark, X, first=0):
    rows = [(first + i, [float(v) for v in x]) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "item_id bigint, embedding array<float>").repartition(5)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(0)
    topics = rng.normal(size=(30, 24)) * 4
    X = topics[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24)) * 0.4
    X[:900] = X[0]  # a third of all rows are one vector
    return table(spark, X.astype(np.float32)).cache()


def rows_of(df):
    return {(r.item_id, r.probe): r.cell_id for r in df.collect()}


@pytest.fixture(scope="module")
def centroids(clustered):
    return cut_lineage(train_in_levels(clustered, 150, fit_cells=16, fan_out=4, fit_rows=800, seed=3))


def test_cells_are_distinct_dense_and_within_the_number_wanted(spark, clustered, centroids):
    rows = centroids.collect()
    assert sorted(r.cell_id for r in rows) == list(range(len(rows))) and 100 < len(rows) <= 150
    assert len({tuple(r.centroid) for r in rows}) == len(rows)
    # close to what one k-means over everything reaches
    flat = train_centroids(clustered, 150, seed=3, max_iter=10)
    cost = lambda c: assign_cells(clustered, c).agg(F.sum("distance")).first()[0]
    assert cost(centroids) < 1.3 * cost(flat)


def test_training_does_not_depend_on_the_layout(spark, clustered, centroids):
    again = train_in_levels(clustered.repartition(11), 150, fit_cells=16, fan_out=4, fit_rows=800, seed=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, centroids.collect()))


def test_training_on_few_equal_or_no_vectors(spark):
    one = table(spark, np.ones((50, 3), np.float32))
    assert [tuple(r.centroid) for r in train_in_levels(one, 20, fit_cells=4, fan_out=3).collect()] == [(1.0, 1.0, 1.0)]
    with pytest.raises(ValueError, match="no vectors"):
        train_in_levels(one.limit(0), 3)
    with pytest.raises(ValueError, match="positive"):
        train_in_levels(one, 0)
    assert len(lloyd(np.repeat(np.eye(3), 5, axis=0), 7, 1, 5)) == 3


def test_shares_add_up():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = {i: int(c) for i, c in enumerate(rng.integers(1, 50, rng.integers(1, 9)))}
        nlist = int(rng.integers(len(counts), 60))
        share = _share(nlist, counts)
        assert all(1 <= share[k] <= counts[k] for k in counts) and sum(share.values()) <= nlist
        if all(share[k] < counts[k] for k in counts):
            assert sum(share.values()) == nlist


@pytest.mark.parametrize("n", [1, 3, 40])
def test_assignment_through_groups_equals_the_flat_one_for_less(spark, clustered, centroids, n):
    tree = grow(centroids, groups=9)
    work = []
    got = assign_in_tree(clustered, tree, n, work=work)
    assert rows_of(got) == rows_of(assign_cells(clustered, centroids, n))
    size = dict(zip(tree.parents.tolist(), tree.sizes.tolist()))
    n_cells = sum(size.values())
    distances = 3000 * len(size) + sum(size[r.cell_id] for w in work for r in w.select("cell_id").collect())
    assert n_cells == centroids.count() and distances < (0.6 if n < 40 else 1.1) * 3000 * n_cells


def test_more_probes_than_cells(spark, clustered, centroids):
    few = centroids.where("cell_id < 5")
    got = rows_of(assign_in_tree(clustered.limit(20), grow(few, groups=2), 9))
    assert got == rows_of(assign_cells(clustered.limit(20), few, 9)) and len(got) == 100


def test_group_masks_hold_enough_cells(spark, centroids):
    tree = grow(centroids, groups=7)
    X = np.random.default_rng(2).normal(size=(50, 24)) * 4
    for n in (1, 20, 10_000):
        taken = first_groups(tree, X, n)
        held = (taken * tree.sizes).sum(1)
        assert (held >= min(n, tree.sizes.sum())).all() and (taken.sum(1) >= 1).all()


def test_an_index_past_the_broadcast_bound(spark, clustered, monkeypatch):
    """The default number of cells is trained, assigned and searched without ever holding the centroids."""
    monkeypatch.setattr(IX, "train_in_levels", lambda v, k, *a, **kw: train_in_levels(v, k, *a, fit_cells=8, fan_out=4, **kw))
    index = build_index(clustered, cfg=LARGE)
    assert index.nlist == round(3000**0.5) and index.centroid_matrix(LARGE) is None
    q = clustered.where("item_id % 100 = 1").select(F.col("item_id").alias("query_id"), "embedding")
    got = knn_ivf(q, index, 5, index.nlist, exclude_self=True, cfg=LARGE)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, knn_exact(q, clustered, 5, exclude_self=True).collect()))


def test_training_takes_a_bounded_sample(spark, clustered, monkeypatch):
    seen = []
    monkeypatch.setattr(IX, "train_in_levels", lambda v, *a, **kw: seen.append(v.count()) or clustered.limit(1).selectExpr("0 as cell_id", "embedding as centroid"))
    train_centroids(clustered, 10, dim=24, n=3000, rows_per_cell=30, cfg=LARGE)
    assert 200 < seen[0] < 400


@pytest.mark.parametrize("strategy", ["auto", "tiled"])
def test_residual_bounds_leave_neighbours_and_skip_rows(spark, clustered, centroids, scratch_dir, strategy):
    index = build_index(clustered, centroids=centroids)
    save_index(index, f"{scratch_dir}/index")
    stored = load_index(spark, f"{scratch_dir}/index")
    q = clustered.where("item_id in (5, 1000, 1500, 2900)").select(F.col("item_id").alias("query_id"), "embedding")
    for k in (3, 50):
        plain = sorted(map(tuple, knn_ivf(q, index, k, 30, exclude_self=True).collect()))
        read = []
        got = knn_ivf(q, stored, k, 30, exclude_self=True, strategy=strategy, prune=True, read=read)
        assert sorted(map(tuple, got.collect())) == plain
        if k == 3:
            probed = assign_cells(q, centroids, 30, id_col="query_id").select("cell_id").distinct()
            without = stored.cells.join(probed, "cell_id", "left_semi").count()
            assert sum(r.count() for r in read) < 0.8 * without


def test_stored_cells_carry_their_bounds(spark, clustered, centroids, scratch_dir):
    save_index(build_index(clustered, centroids=centroids), f"{scratch_dir}/index")
    stored = load_index(spark, f"{scratch_dir}/index")
    want = {r.cell_id: (r.n, r.lo, r.hi) for r in stored.cells.groupBy("cell_id").agg(
        F.count("*").alias("n"), F.min("residual").alias("lo"), F.max("residual").alias("hi")).collect()}
    got = {r.cell_id: (r.n_items, r.smallest, r.largest) for r in stored.centroids.where("n_items is not null").collect()}
    assert got == want and stored.centroids.count() == centroids.count()
    joined = stored.cells.join(centroids, "cell_id").select("residual", F.expr(
        "sqrt(aggregate(zip_with(embedding, centroid, (a, b) -> pow(cast(a as double) - b, 2)), 0D, (s, x) -> s + x))").alias("plain"))
    assert all(abs(r.residual - r.plain) < 1e-9 for r in joined.collect())


@pytest.mark.parametrize("bad, message", [(None, "1 null vectors"), ([1.0] * 3, "dimension 24"), ([float("nan")] * 24, "null or NaN")])
def test_vectors_are_checked_while_they_are_written(spark, clustered, centroids, scratch_dir, bad, message):
    rows = clustered.limit(50).unionByName(spark.createDataFrame([(9_999, bad)], "item_id bigint, embedding array<float>"))
    path = f"{scratch_dir}/index"
    with pytest.raises(ValueError, match=message):
        save_index(build_index(rows, centroids=centroids, validate="write", dim=24), path)
    with pytest.raises(FileNotFoundError):
        load_index(spark, path)
    with pytest.raises(ValueError, match="no vectors"):
        save_index(build_index(clustered.limit(0), centroids=centroids, validate="write", dim=24), path)


def test_checks_at_the_write_add_no_scan(spark, clustered, centroids):
    plan = build_index(clustered, centroids=centroids, validate="write", dim=24).cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CollectMetrics") == 1 and "Aggregate" not in plan
