"""Index storage, resumable build job and embedding hooks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators.embed import PythonHashEncoder, embed, hash_embed
from nearfield.operators.index import build_index
from nearfield.plans.jobs import build_job
from nearfield.sources import fixtures as FX
from nearfield.sources.catalog import load_items, materialize, pending
from nearfield.sources.store import load_index, save_index

from paths import SF_SMALL


def test_save_load_round_trip(spark, scratch_dir):
    e = FX.embeddings_table(spark, SF_SMALL)
    idx = build_index(e, nlist=16, centroids=FX.supplied_centroids(spark, SF_SMALL, 16))
    path = os.path.join(scratch_dir, "a", "b", "index")
    save_index(idx, path)
    back = load_index(spark, path)
    assert back.nlist == 16 and back.dim == 64
    got = {(r["item_id"], r["cell_id"]) for r in back.cells.select("item_id", "cell_id").collect()}
    assert got == {(r["item_id"], r["cell_id"]) for r in idx.cells.select("item_id", "cell_id").collect()}


def test_load_missing_index_names_path(spark, scratch_dir):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        load_index(spark, os.path.join(scratch_dir, "nowhere"))


def test_a_killed_save_leaves_the_old_index_whole(spark, scratch_dir, monkeypatch):
    from pyspark.sql import DataFrameWriter

    e = FX.embeddings_table(spark, SF_SMALL)
    path = os.path.join(scratch_dir, "index")
    cents = FX.supplied_centroids(spark, SF_SMALL, 16)
    save_index(build_index(e, nlist=16, centroids=cents), path)
    want = sorted(map(tuple, load_index(spark, path).cells.select("item_id", "cell_id").collect()))
    other = build_index(e, nlist=4, centroids=cents.where("cell_id < 4"))
    write = DataFrameWriter.parquet
    for killed_at in ("/cells", "/manifest/"):

        def die(self, out, *args, at=killed_at, **kw):
            if at in out:
                raise KeyboardInterrupt
            return write(self, out, *args, **kw)

        monkeypatch.setattr(DataFrameWriter, "parquet", die)
        with pytest.raises(KeyboardInterrupt):
            save_index(other, path)
        monkeypatch.setattr(DataFrameWriter, "parquet", write)
        os.makedirs(os.path.join(path, "manifest", "v=00000009"), exist_ok=True)  # a manifest without its marker
        back = load_index(spark, path)
        assert back.nlist == 16 and sorted(map(tuple, back.cells.select("item_id", "cell_id").collect())) == want
    save_index(other, path)
    assert load_index(spark, path).nlist == 4


def test_file_count_follows_the_data_size(spark, scratch_dir):
    from nearfield.sources.store import file_count

    assert file_count(0, 64) == file_count(500, 64) == 1
    assert file_count(10**9, 384) == -(-(10**9) * (4 * 384 + 16) // (128 << 20)) > 10_000


def test_load_items_requires_key(spark):
    df = spark.createDataFrame([(1, "t")], "id bigint, title string")
    with pytest.raises(KeyError):
        load_items(spark, df, key="sku")
    got = load_items(spark, df, key="id")
    assert got.columns == ["item_id", "title", "genres", "description", "review_text"]


def test_materialize_reuses_complete_output(spark, scratch_dir):
    path = os.path.join(scratch_dir, "stage")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert materialize(spark, path, build).count() == 5
    assert materialize(spark, path, build).count() == 5
    assert len(calls) == 1


def test_hash_encoder_hook_equals_builtin(spark):
    items = FX.items_view(spark, SF_SMALL).withColumnRenamed("description", "embedding_input")
    a = {r["item_id"]: r["embedding"] for r in hash_embed(items, 32).collect()}
    b = {r["item_id"]: r["embedding"] for r in embed(items, lambda: PythonHashEncoder(32), 32, batch_size=7).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_encoder_dimension_checked(spark):
    df = spark.createDataFrame([(1, "a")], "item_id bigint, embedding_input string")
    with pytest.raises(Exception, match="shape"):
        embed(df, lambda: (lambda texts: np.zeros((len(texts), 3))), 4).collect()


def test_build_job_resumes_without_rework(spark, scratch_dir):
    items = FX.items_view(spark, SF_SMALL)
    resp = FX.responses_view(spark, SF_SMALL)
    out = os.path.join(scratch_dir, "job")
    # A previous run that died mid-write leaves a folder without _SUCCESS.
    os.makedirs(os.path.join(out, "embeddings", "run=00000"))
    r1 = build_job(spark, items, resp, out, dim=32, nlist=4, seed=3)
    ok = r1.integrity.first()
    assert ok["ok"] and ok["n_indexed"] == r1.embeddings.count()
    n1 = r1.embeddings.count()
    r2 = build_job(spark, items, resp, out, dim=32, nlist=4, seed=3)
    assert r2.embeddings.count() == n1
    assert r2.embeddings.select("item_id").distinct().count() == n1
    todo = r2.prepared.where(F.col("embedding_input").isNotNull())
    assert pending(todo, r2.embeddings).count() == 0
    metrics = {r["metric"]: r["value"] for r in r2.summary.collect()}
    assert metrics["index_rows"] == n1 == metrics["items_embeddable"]
    assert metrics["index_bytes"] > 0 and metrics["elapsed_seconds"] > 0
    assert r2.index_path == f"{out}/index" and r2.embeddings_path == f"{out}/embeddings"


FULL = '{"results":[{"title":"Found","overview":"d","genre_ids":[7]}]}'


def _job_state(result):
    vectors = {r.item_id: tuple(r.embedding) for r in result.embeddings.collect()}
    tiers = {r.item_id: r.embedding_tier for r in result.prepared.collect()}
    cells = sorted(r.item_id for r in result.index.cells.collect())
    return vectors, tiers, cells


@pytest.mark.parametrize("text_keys", [False, True])
def test_rerun_equals_a_clean_run(spark, scratch_dir, text_keys):
    key = (lambda i: f"B{i}") if text_keys else (lambda i: i)
    kind = "string" if text_keys else "bigint"
    items_schema = f"item_id {kind}, title string, genres string, description string, review_text string"

    def items(title):
        rows = [(key(1), None, "g", "d", "r"), (key(2), title, "g", "d", "r"), (key(3), "t3", "g", None, None), (key(4), None, None, None, None)]
        return spark.createDataFrame(rows, items_schema)

    def responses(*bodies):
        return spark.createDataFrame([(key(i), b) for i, b in bodies], f"item_id {kind}, body string")

    out = os.path.join(scratch_dir, "job")
    first = build_job(spark, items("t2"), responses((4, "not json")), out, dim=16, nlist=1)
    assert _job_state(first)[1] == {key(1): 4, key(2): 1, key(3): 3, key(4): 4}
    # A late response, one next to a failed one, and a changed title.
    now = (items("changed title"), responses((1, FULL), (4, "not json"), (4, FULL)))
    again = build_job(spark, *now, out, dim=16, nlist=1)
    clean = build_job(spark, *now, os.path.join(scratch_dir, "clean"), dim=16, nlist=1)
    assert _job_state(again) == _job_state(clean)
    assert _job_state(again)[1] == {key(1): 1, key(2): 1, key(3): 3, key(4): 2}
    assert _job_state(again)[0][key(2)] != _job_state(first)[0][key(2)]
    back = build_job(spark, items("t2"), responses(), out, dim=16, nlist=1)
    assert _job_state(back)[0][key(2)] == _job_state(first)[0][key(2)] and back.integrity.first()["ok"]


def test_each_step_of_a_build_reads_the_items_once(spark, scratch_dir):
    rows = [(i, f"t{i}", "g" if i % 3 else None, f"text {i}", "r") for i in range(60)]
    given = spark.createDataFrame(rows, "item_id bigint, title string, genres string, description string, review_text string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    items, resp = given.mapInArrow(counted, given.schema), FX.responses_view(spark, SF_SMALL)
    out = os.path.join(scratch_dir, "job")
    first = build_job(spark, items, resp, out, dim=16, nlist=1)
    assert read.value <= 4 * 60  # the check of the keys, the weak items, the keys to do, the encoder
    before = read.value
    again = build_job(spark, items, resp, out, dim=16, nlist=1)
    assert read.value - before <= 3 * 60  # nothing is left to encode
    assert first.index.cells.count() == again.index.cells.count() > 0


def test_build_job_rejects_repeated_or_null_keys(spark, scratch_dir):
    for rows in ([(1, "t"), (1, "u")], [(None, "t")]):
        items = load_items(spark, spark.createDataFrame(rows, "item_id bigint, title string"))
        with pytest.raises(ValueError):
            build_job(spark, items, FX.responses_view(spark, SF_SMALL), os.path.join(scratch_dir, "bad"))


def test_probe_reads_only_probed_cells_of_stored_index(spark, scratch_dir):
    from nearfield.operators.index import knn_ivf

    e = FX.embeddings_table(spark, SF_SMALL)
    idx = build_index(e, nlist=16, centroids=FX.supplied_centroids(spark, SF_SMALL, 16))
    path = os.path.join(scratch_dir, "index")
    save_index(idx, path)
    back = load_index(spark, path)
    q = e.where(F.col("item_id").isin(3, 77)).select(F.col("item_id").alias("query_id"), "embedding")
    res = knn_ivf(q, back, 5, 1, exclude_self=True, max_queries=2)
    plan = res._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "dynamicpruningexpression(" in plan
    mem = knn_ivf(q, idx, 5, 1, exclude_self=True, max_queries=2)
    assert sorted(map(tuple, res.collect())) == sorted(map(tuple, mem.collect()))


def test_sources_and_sinks_round_trip(spark, scratch_dir):
    from nearfield.operators import enrich as E
    from nearfield.sources.catalog import (
        load_embeddings,
        load_responses,
        read_enrichment,
        write_embeddings,
        write_enrichment,
    )

    resp_path = os.path.join(scratch_dir, "responses")
    FX.responses_view(spark, SF_SMALL).withColumnRenamed("item_id", "sku").write.parquet(resp_path)
    responses = load_responses(spark, resp_path, key="sku")
    enr = E.enrich(E.needs_enrichment(FX.items_view(spark, SF_SMALL)), responses)
    write_enrichment(enr, os.path.join(scratch_dir, "enrichment"))
    back = read_enrichment(spark, os.path.join(scratch_dir, "enrichment"))
    by_key = lambda rows: sorted(map(tuple, rows), key=lambda r: r[0])
    assert by_key(back.collect()) == by_key(enr.collect())
    emb = FX.embeddings_table(spark, SF_SMALL)
    write_embeddings(emb, os.path.join(scratch_dir, "emb"))
    got = load_embeddings(spark, os.path.join(scratch_dir, "emb"))
    assert got.schema == emb.schema or got.dtypes == emb.dtypes
    assert got.count() == emb.count() and pending(emb, got).count() == 0


def test_index_integrity_counts_rows_under_a_hot_duplicate_key(spark):
    from nearfield.operators.reports import index_integrity

    # Key 1 holds most rows on both sides: rows are counted, pairs never formed.
    cells = spark.createDataFrame([(1,)] * 300 + [(2,), (3,)], "item_id bigint")
    emb = spark.createDataFrame([(1,)] * 200 + [(2,), (4,)], "item_id bigint")
    r = index_integrity(cells, emb).first()
    assert (r.n_indexed, r.n_embedded, r.n_missing, r.n_extra, r.ok) == (302, 202, 1, 1, False)
    same = index_integrity(cells.where("item_id <> 3"), cells.where("item_id <> 3")).first()
    assert (same.n_missing, same.n_extra, same.ok) == (0, 0, True)
