"""Kernels, kNN strategies, IVF index and validation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import kernels as K
from nearfield.operators.index import assign_cells, build_index, knn_ivf, validate_vectors
from nearfield.operators.knn import SearchConfig, knn_exact, recall_at_k
from nearfield.sources import fixtures as FX

from paths import SF_MID

TINY = SearchConfig(item_tile_rows=16, query_tile_rows=8, max_broadcast_bytes=0)


def brute(Q, qids, X, xids, k, exclude_self=False):
    out = []
    for i, q in enumerate(Q):
        d = ((X - q) ** 2).sum(1)
        cand = [(d[j], xids[j]) for j in range(len(X)) if not (exclude_self and xids[j] == qids[i])]
        for r, (dist, x) in enumerate(sorted(cand)[:k]):
            out.append((qids[i], x, r + 1, round(dist, 9)))
    return sorted(out)


def test_topk_kernel_matches_brute_force_with_ties():
    rng = np.random.default_rng(3)
    X = rng.integers(-2, 3, size=(300, 8)).astype(np.float64)  # many exact ties
    xids = rng.permutation(1000)[:300]
    Q = X[:40]
    qids = xids[:40]
    for k, ex in ((1, False), (5, True), (400, True)):
        qi, xi, d = K.topk(Q, qids, X, xids, k, ex)
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi) + 1
        got = sorted(zip(qids[qi], xi, rank, np.round(d, 9)))
        assert got == brute(Q, qids, X, xids, k, ex)


def _emb(spark):
    return FX.embeddings_table(spark, SF_MID)


def _rows(df):
    return sorted((r["query_id"], r["item_id"], r["rank"], round(r["distance"], 9)) for r in df.collect())


def test_exact_strategies_agree_with_brute_force(spark):
    e = _emb(spark).where(F.col("item_id") < 120)
    pdf = e.orderBy("item_id").toPandas()
    X = np.stack(pdf["embedding"].map(lambda v: np.asarray(v, dtype=np.float64)))
    ids = pdf["item_id"].to_numpy()
    want = brute(X, ids, X, ids, 4, True)
    q = e.select(F.col("item_id").alias("query_id"), "embedding")
    assert _rows(knn_exact(q, e, 4, exclude_self=True, strategy="broadcast")) == want
    assert _rows(knn_exact(q, e, 4, exclude_self=True, strategy="tiled", cfg=TINY)) == want


def test_ivf_all_cells_equals_exact_and_recall_monotone(spark):
    e = _emb(spark)
    q = e.select(F.col("item_id").alias("query_id"), "embedding")
    idx = build_index(e, nlist=16, centroids=FX.supplied_centroids(spark, SF_MID, 16))
    exact = knn_exact(q, e, 5, exclude_self=True)
    assert _rows(knn_ivf(q, idx, 5, nprobe=16, exclude_self=True)) == _rows(exact)
    recalls = [recall_at_k(knn_ivf(q, idx, 5, nprobe=p, exclude_self=True), exact).first()["recall"] for p in (1, 2, 4, 16)]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0


def test_hot_cell_is_split_into_tiles(spark):
    # A third of all vectors sit in one cell (identical direction, scaled).
    rows = [(i, [float(i % 7), 1.0, 0.0]) for i in range(60)] + [(100 + i, [0.0, 0.0, 50.0 + i]) for i in range(30)]
    items = spark.createDataFrame(rows, "item_id bigint, embedding array<float>")
    cents = spark.createDataFrame([(0, [0.0, 0.0, 60.0]), (1, [3.0, 1.0, 0.0])], "cell_id int, centroid array<float>")
    idx = build_index(items, nlist=2, centroids=cents)
    q = items.select(F.col("item_id").alias("query_id"), "embedding")
    tiled = _rows(knn_ivf(q, idx, 3, nprobe=2, exclude_self=True, strategy="tiled", cfg=TINY))
    assert tiled == _rows(knn_exact(q, items, 3, exclude_self=True, strategy="broadcast"))


def test_assign_cells_fallback_equals_broadcast(spark):
    e = _emb(spark)
    cents = FX.supplied_centroids(spark, SF_MID, 16)
    a = {(r["item_id"], r["cell_id"], r["probe"]) for r in assign_cells(e, cents, 2).collect()}
    b = {(r["item_id"], r["cell_id"], r["probe"]) for r in assign_cells(e, cents, 2, cfg=TINY).collect()}
    assert a == b and len(a) == 2 * e.count()


@pytest.mark.parametrize("strategy", ["broadcast", "tiled"])
def test_one_result_on_every_path(spark, strategy):
    schema = "item_id bigint, embedding array<float>"
    good = [(i, [float(i), 1.0]) for i in range(20)]
    query = lambda rows: spark.createDataFrame(rows, "query_id bigint, embedding array<float>")
    q = query([(100, [3.2, 1.0])])
    # A vector that is not finite stops the search instead of emptying it.
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="non-finite"):
            knn_exact(q, spark.createDataFrame(good + [(50, [bad, 0.0])], schema), 3, strategy=strategy).collect()
        with pytest.raises(Exception, match="non-finite"):
            knn_exact(query([(100, [bad, 0.0])]), spark.createDataFrame(good, schema), 3, strategy=strategy).collect()
    # A repeated item id is two items; a repeated query id is an error.
    twice = spark.createDataFrame(good + [(3, [3.1, 1.0])], schema)
    assert [(r.item_id, round(r.distance, 4)) for r in sorted(knn_exact(q, twice, 2, strategy=strategy).collect(), key=lambda r: r.rank)] == [
        (3, 0.01), (3, 0.04)]
    for second in ([3.2, 1.0], [9.0, 1.0]):
        with pytest.raises(ValueError, match="unique"):
            knn_exact(query([(100, [3.2, 1.0]), (100, second)]), twice, 2, strategy=strategy).collect()


def test_repeated_ids_keep_their_own_cells_past_the_bound(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (1, [9.0, 9.0]), (2, [9.0, 8.0])], "item_id bigint, embedding array<float>")
    cents = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 9.0])], "cell_id int, centroid array<float>")
    for cfg in (SearchConfig(), TINY):
        got = sorted((r.item_id, r.cell_id) for r in assign_cells(rows, cents, cfg=cfg).collect())
        assert got == [(1, 0), (1, 1), (2, 1)]


@pytest.mark.parametrize("strategy", ["broadcast", "tiled"])
def test_string_keys_agree_with_numbers(spark, strategy):
    e = _emb(spark).where(F.col("item_id") < 100)
    pad = F.concat(F.lit("k"), F.lpad(F.col("item_id").cast("string"), 5, "0"))
    s = e.withColumn("item_id", pad)
    as_q = lambda d: d.select(F.col("item_id").alias("query_id"), "embedding")
    numbers = _rows(knn_exact(as_q(e), e, 3, exclude_self=True, strategy=strategy, cfg=SearchConfig(item_tile_rows=16, query_tile_rows=8)))
    strings = _rows(knn_exact(as_q(s), s, 3, exclude_self=True, strategy=strategy, cfg=SearchConfig(item_tile_rows=16, query_tile_rows=8)))
    assert strings == [(f"k{q:05d}", f"k{i:05d}", r, d) for q, i, r, d in numbers]
    idx = build_index(s, nlist=4, seed=1, max_iter=3)
    assert dict(idx.cells.dtypes)["item_id"] == "string"
    assert _rows(knn_ivf(as_q(s), idx, 3, nprobe=4, exclude_self=True, strategy=strategy)) == strings


def test_one_cell_and_the_default_number_of_cells(spark):
    e = _emb(spark)
    one = build_index(e, nlist=1)
    mean = np.mean(np.array([r.embedding for r in e.collect()], dtype=np.float64), axis=0)
    assert np.allclose(one.centroids.first()["centroid"], mean, atol=1e-6)
    assert one.cells.where("cell_id = 0").count() == e.count()
    assert build_index(e, max_iter=2).nlist == round(e.count() ** 0.5)
    # past the broadcast bound the cells are trained by levels instead
    many = build_index(e, nlist=16, cfg=SearchConfig(max_broadcast_bytes=10))
    assert many.centroids.count() == 16 and many.cells.count() == e.count()


def test_training_ignores_the_file_layout(spark):
    from nearfield.operators.index import train_centroids

    e = _emb(spark)
    for kw in ({}, {"sample_fraction": 0.5}):
        a, b = (sorted(tuple(r.centroid) for r in train_centroids(d, 4, seed=3, max_iter=3, **kw).collect())
                for d in (e.coalesce(1), e.repartition(7)))
        assert np.allclose(a, b, atol=1e-5)


def test_double_vectors_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "item_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="array<double>"):
        validate_vectors(df)


def test_split_size_is_read_as_bytes(spark):
    from nearfield.operators.knn import estimated_partitions

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        many = estimated_partitions(_emb(spark))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128MB")
        assert estimated_partitions(_emb(spark)) < many
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fewer_items_than_k(spark):
    items = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "item_id bigint, embedding array<float>")
    q = spark.createDataFrame([(9, [0.0, 0.1])], "query_id bigint, embedding array<float>")
    got = knn_exact(q, items, 5).collect()
    assert [(r["item_id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]


def test_ties_prefer_smaller_id(spark):
    items = spark.createDataFrame([(5, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0])], "item_id bigint, embedding array<float>")
    q = spark.createDataFrame([(9, [0.0, 0.0])], "query_id bigint, embedding array<float>")
    got = sorted(knn_exact(q, items, 2).collect(), key=lambda r: r["rank"])
    assert [r["item_id"] for r in got] == [3, 5]


@pytest.mark.parametrize(
    "rows,nlist",
    [
        ([(1, [1.0, 2.0]), (2, [1.0])], None),  # wrong dimension
        ([(1, [1.0, 2.0]), (2, None)], None),  # null vector
        ([(1, [1.0, float("nan")])], None),  # NaN element
        ([(1, [1.0, 2.0]), (2, [2.0, 2.0])], 3),  # fewer rows than cells
    ],
)
def test_validation_errors(spark, rows, nlist):
    df = spark.createDataFrame(rows, "item_id bigint, embedding array<float>")
    with pytest.raises(ValueError):
        validate_vectors(df, nlist)


def test_trained_index_runs(spark):
    e = _emb(spark)
    idx = build_index(e, nlist=8, seed=1, max_iter=5)
    assert idx.cells.count() == e.count()
    assert 1 <= idx.cells.select("cell_id").distinct().count() <= 8


def test_tile_plan_bounds_hot_cells():
    import math

    from nearfield.operators.knn import _tile_plan

    cfg = SearchConfig(item_tile_rows=1000, query_tile_rows=500)
    # Cell 7 holds a third of all items and a third of all queries.
    q_counts = {c: 300 for c in range(20)} | {7: 3000, 99: 5}
    i_counts = {c: 600 for c in range(20)} | {7: 6000}
    plan = {c: (ib, qb) for c, ib, qb in _tile_plan(q_counts, i_counts, cfg, parallelism=8)}
    assert 99 not in plan  # no items there: the cell is never read
    for c, (ib, qb) in plan.items():
        assert math.ceil(i_counts[c] / ib) <= cfg.item_tile_rows
        assert math.ceil(q_counts[c] / qb) <= cfg.query_tile_rows
    assert plan[7][0] >= 6 and plan[7][1] >= 6
    # Long vectors make smaller tiles.
    wide = {c: (ib, qb) for c, ib, qb in _tile_plan(q_counts, i_counts, cfg, parallelism=8, dim=1 << 20)}
    assert math.ceil(i_counts[7] / wide[7][0]) * 8 * (1 << 20) <= cfg.max_tile_bytes


def test_rows_are_copied_to_a_bounded_number_of_tiles():
    from nearfield.operators.knn import _tile_plan

    for n in (10_000, 100_000, 1_000_000):
        (_, ib, qb), = _tile_plan({0: n}, {0: n}, TINY, parallelism=12, dim=8)
        assert ib <= 8 and qb <= 8 and ib * qb >= 12
    # only the bound in bytes asks for more
    (_, ib, qb), = _tile_plan({0: 10**6}, {0: 10**6}, TINY, parallelism=12, dim=1024)
    assert 10**6 / ib * 1024 * 8 <= TINY.max_tile_bytes and 10**6 / qb * 1024 * 8 <= TINY.max_tile_bytes


def test_grown_tiles_give_the_same_neighbours(spark):
    e = _emb(spark)
    q = e.select(F.col("item_id").alias("query_id"), "embedding")
    wide = SearchConfig(item_tile_rows=16, query_tile_rows=8, max_broadcast_bytes=0, max_copies=10**6)
    grown = _rows(knn_exact(q, e, 5, exclude_self=True, strategy="tiled", cfg=TINY))
    assert grown == _rows(knn_exact(q, e, 5, exclude_self=True, strategy="tiled", cfg=wide))


def test_query_validation_rejects_wrong_dimension(spark):
    e = _emb(spark)
    idx = build_index(e, nlist=16, centroids=FX.supplied_centroids(spark, SF_MID, 16))
    bad = spark.createDataFrame([(1, [1.0, 2.0])], "query_id bigint, embedding array<float>")
    with pytest.raises(ValueError, match="dimension 64"):
        knn_ivf(bad, idx, 5, validate=True)


def test_candidate_volume_bound_switches_to_tiled(spark):
    e = _emb(spark).where(F.col("item_id") < 100)
    q = e.select(F.col("item_id").alias("query_id"), "embedding")
    small = SearchConfig(max_broadcast_candidates=1)
    auto = knn_exact(q, e, 3, exclude_self=True, cfg=small)
    assert "FlatMapCoGroupsInArrow" in auto._jdf.queryExecution().executedPlan().toString()
    assert _rows(auto) == _rows(knn_exact(q, e, 3, exclude_self=True, strategy="broadcast"))


@pytest.mark.parametrize("text_keys", [False, True])
def test_shipped_queries_are_taken_up_in_ranges(spark, text_keys):
    e = _emb(spark)
    if text_keys:
        e = e.withColumn("item_id", F.concat(F.lit("B"), F.col("item_id").cast("string")))
    idx = build_index(e, nlist=4, seed=1, max_iter=3)
    q = e.select(F.col("item_id").alias("query_id"), "embedding")
    few = SearchConfig(query_block_rows=7, merge_every_rows=50)
    whole = _rows(knn_ivf(q, idx, 5, 3, exclude_self=True, strategy="broadcast"))
    assert whole and whole == _rows(knn_ivf(q, idx, 5, 3, exclude_self=True, strategy="broadcast", cfg=few))


def test_topk_kernel_memory_does_not_grow_with_ties():
    import tracemalloc

    X = np.tile(np.random.default_rng(3).normal(size=(2, 64)), (1500, 1))  # every query has 1,500 equal neighbours
    ids = np.arange(len(X))
    tracemalloc.start()
    q, x, d = K.topk(X[:400].astype(np.float32), ids[:400], X.astype(np.float32).astype(np.float64), ids, 5, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (d == 0).all() and x[:5].tolist() == [2, 4, 6, 8, 10] and peak < 128 << 20


def test_hashed_fold_kernel_matches_python_encoder():
    import pyarrow as pa

    from nearfield.operators.embed import PythonHashEncoder

    texts = ["the cat  the cat", "", None, "x", "  Ünïcode words\tand\nmore  ", "a " * 50]
    # The kernel sees JVM-lowered text with whitespace mapped to spaces.
    spaced = [None if t is None else " ".join(t.lower().split()) for t in texts]
    got = K.fold_spaced_texts(pa.array(spaced, pa.string()), 16).to_pylist()
    want = PythonHashEncoder(16)([t or "" for t in texts])
    assert len(got) == len(texts)
    for g, w in zip(got, want):
        assert g == pytest.approx(list(w))
    assert got[2] == [0.0] * 16 and got[5][int(np.argmax(np.abs(got[5])))] in (50.0, -50.0)


def test_hashed_fold_kernel_slices_batches(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["b a", None, "a", "c c c", "", "a b"], pa.string())
    whole = K.fold_spaced_texts(texts, 8).to_pylist()
    monkeypatch.setattr(K, "FOLD_SLICE_ROWS", 4)
    assert K.fold_spaced_texts(texts, 8).to_pylist() == whole
    assert whole[0] == whole[5] and whole[1] == [0.0] * 8
