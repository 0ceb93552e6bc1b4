"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` each.

Every query reads the driver tables (or views Spark derives from them) in
full; names and column aliases match ``nearfield.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.text import embedding_input, is_present, truncate_words, word_count
from nearfield.functions.vectors import l2_sq
from nearfield.operators import enrich as E
from nearfield.operators import reports as R
from nearfield.operators.embed import PythonHashEncoder, embed, hash_embed, hash_vector
from nearfield.operators.index import assign_cells, build_index, knn_ivf, vector_stats
from nearfield.operators.knn import SearchConfig, knn_exact, recall_at_k
from nearfield.operators.titles import search_titles
from nearfield.operators.tree import assign_in_tree, grow, train_in_levels
from nearfield.plans.jobs import build_job, first_matches, similar_items
from nearfield.sources import fixtures as FX
from nearfield.session import cut_lineage, shared_folder
from nearfield.sources.catalog import (
    embedding_schema,
    load_embeddings,
    load_items,
    load_responses,
    materialize,
    pending,
    read_enrichment,
    write_embeddings,
    write_enrichment,
)
from nearfield.sources.runs import KeyedRuns
from nearfield.sources.store import load_index, save_index

Query = Callable[[SparkSession, str], DataFrame]


def _items(spark, sf):
    return FX.items_view(spark, sf)


def _prepared(spark, sf, cap=None):
    kw = {} if cap is None else {"max_review_words": cap}
    return E.prepare_items(_items(spark, sf), FX.responses_view(spark, sf), **kw)


def q_tier_distribution(spark, sf):
    return R.tier_distribution(E.with_tier(_items(spark, sf)), "initial_tier")


def q_presence_flags(spark, sf):
    t = E.with_tier(_items(spark, sf))
    return t.select(
        "item_id",
        is_present("title").alias("title_present"),
        is_present("genres").alias("genres_present"),
        is_present("description").alias("description_present"),
        is_present("review_text").alias("review_present"),
        "initial_tier",
    )


def q_truncate_words(spark, sf):
    i = _items(spark, sf)
    return i.select(
        "item_id",
        word_count("review_text").alias("review_words"),
        truncate_words("review_text", 16).alias("review_16"),
    )


def _embedding_input(cap):
    def run(spark, sf):
        t = E.with_tier(_items(spark, sf))
        text = embedding_input(
            F.col("title"), F.col("genres"), F.col("description"), F.col("review_text"),
            max_review_words=cap, tier=F.col("initial_tier"),
        )
        return t.select("item_id", "initial_tier", text.alias("embedding_input"))

    return run


def q_needs_enrichment(spark, sf):
    return E.needs_enrichment(_items(spark, sf))


def q_parse_top_result(spark, sf):
    from nearfield.functions.json import top_result, top_result_fields

    r = FX.responses_view(spark, sf).select("item_id", top_result("body").alias("top"))
    f = top_result_fields(F.col("top"))
    return r.select("item_id", *[c.alias(n) for n, c in f.items()])


def q_enrich(spark, sf):
    return E.enrich(E.needs_enrichment(_items(spark, sf)), FX.responses_view(spark, sf))


def q_merge_enrichment(spark, sf):
    items = E.with_tier(_items(spark, sf))
    enr = E.enrich(items.where(F.col("initial_tier") == 4), FX.responses_view(spark, sf))
    return E.merge_enrichment(items, enr)


def q_prepare_items(spark, sf):
    return _prepared(spark, sf)


def q_prepare_items_cap16(spark, sf):
    return _prepared(spark, sf, 16)


def q_tier_distribution_after(spark, sf):
    return R.tier_distribution(_prepared(spark, sf), "embedding_tier")


def q_field_coverage(spark, sf):
    return R.field_coverage(_prepared(spark, sf))


def q_gap_report(spark, sf):
    return R.gap_report(_prepared(spark, sf))


def q_need_report(spark, sf):
    return R.need_report(E.with_tier(_items(spark, sf)))


def text_queries() -> dict[str, Query]:
    return {
        "tier_distribution": q_tier_distribution,
        "presence_flags": q_presence_flags,
        "truncate_words": q_truncate_words,
        "embedding_input": _embedding_input(256),
        "embedding_input_cap16": _embedding_input(16),
        "needs_enrichment": q_needs_enrichment,
        "parse_top_result": q_parse_top_result,
        "enrich": q_enrich,
        "merge_enrichment": q_merge_enrichment,
        "prepare_items": q_prepare_items,
        "prepare_items_cap16": q_prepare_items_cap16,
        "tier_distribution_after": q_tier_distribution_after,
        "field_coverage": q_field_coverage,
        "gap_report": q_gap_report,
        "need_report": q_need_report,
    }


# ------------------------------------------------------------------ vectors
# Fixed parameters of the vector queries.
DIM = 64
K_NEIGHBOURS = 5
SUPPLIED_CELLS = 16
SEEDS = ["the", "der", "zzz-none"]
# Forces the tiled strategy with default tile sizes.
TILED = SearchConfig(max_broadcast_bytes=0)
# Forces the tiled strategy with tiles small enough to split every cell.
TINY_TILES = SearchConfig(item_tile_rows=64, query_tile_rows=32, max_broadcast_bytes=0)


def _emb(spark, sf):
    return FX.embeddings_table(spark, sf)


def _supplied_index(spark, sf):
    return build_index(_emb(spark, sf), centroids=FX.supplied_centroids(spark, sf, SUPPLIED_CELLS), nlist=SUPPLIED_CELLS)


def _queries_from(df):
    return df.select(F.col("item_id").alias("query_id"), "embedding")


def _rounded(df, digits=6):
    return df.withColumn("distance", F.round("distance", digits))


def q_validate_vectors(spark, sf):
    return vector_stats(_emb(spark, sf), DIM)


def q_l2_distance(spark, sf):
    a = _emb(spark, sf).alias("a")
    b = _emb(spark, sf).alias("b")
    j = a.join(b, F.col("b.item_id") == F.col("a.item_id") + 1)
    return j.select(
        F.col("a.item_id").alias("item_id"),
        F.col("b.item_id").alias("next_id"),
        F.round(l2_sq("a.embedding", "b.embedding"), 6).alias("distance"),
    )


def _hash_vectors(spark, sf):
    return hash_embed(_prepared(spark, sf), DIM)


def q_hash_embed(spark, sf):
    return _hash_vectors(spark, sf)


def q_embed_python_encoder(spark, sf):
    return embed(_prepared(spark, sf), lambda: PythonHashEncoder(DIM), DIM)


def q_assign_cells(spark, sf):
    a = assign_cells(_emb(spark, sf), FX.supplied_centroids(spark, sf, SUPPLIED_CELLS))
    return a.select("item_id", "cell_id")


def _knn_exact(strategy, cfg=None):
    def run(spark, sf):
        e = _emb(spark, sf)
        kw = {"cfg": cfg} if cfg else {}
        return _rounded(knn_exact(_queries_from(e), e, K_NEIGHBOURS, exclude_self=True, strategy=strategy, **kw))

    return run


def _knn_ivf(nprobe, strategy="auto", cfg=None):
    def run(spark, sf):
        kw = {"cfg": cfg} if cfg else {}
        idx = _supplied_index(spark, sf)
        res = knn_ivf(_queries_from(_emb(spark, sf)), idx, K_NEIGHBOURS, nprobe, exclude_self=True, strategy=strategy, **kw)
        return _rounded(res)

    return run


def q_recall_at_k(spark, sf):
    e = _emb(spark, sf)
    ivf = knn_ivf(_queries_from(e), _supplied_index(spark, sf), K_NEIGHBOURS, 1, exclude_self=True)
    exact = knn_exact(_queries_from(e), e, K_NEIGHBOURS, exclude_self=True)
    return recall_at_k(ivf, exact).withColumn("recall", F.round("recall", 6))


def q_cell_sizes(spark, sf):
    return R.cell_sizes(_supplied_index(spark, sf).cells)


def q_index_integrity(spark, sf):
    return R.index_integrity(_supplied_index(spark, sf).cells, _emb(spark, sf))


def q_search_titles(spark, sf):
    return search_titles(E.embeddable(_prepared(spark, sf)), SEEDS)


def _vector_base(spark, sf, prepared):
    """What the reports on items and vectors need, written once as a table: key, title, tier and hashed vector
    (null without an embedding text), read by the columns each step takes. No text is kept. The items are
    counted while they are written."""
    seen = Observation()
    base = prepared.select("item_id", "title_final", "embedding_tier", hash_vector("embedding_input", DIM).alias("embedding"))
    path = _shared(spark, "base")
    base.observe(seen, *R.item_counts("embedding")).write.parquet(path)
    return spark.read.schema(base.schema).parquet(path), seen


def _base_vectors(base):
    return base.where(F.col("embedding").isNotNull()).select("item_id", "embedding")


def _lowest_index(vectors):
    """An index whose centroids are the vectors of the 16 smallest item ids."""
    number = F.regexp_replace(F.col("item_id").cast("string"), "^B", "").cast("int")  # the key's number is the cell's
    lowest = vectors.orderBy("item_id").limit(SUPPLIED_CELLS)
    cents = lowest.select(number.alias("cell_id"), F.col("embedding").alias("centroid"))
    return build_index(vectors, centroids=cents, nlist=SUPPLIED_CELLS, validate=False, dim=DIM)


def q_build_hash_index(spark, sf):
    vectors = cut_lineage(_hash_vectors(spark, sf))
    return _lowest_index(vectors).cells.select("item_id", "cell_id")


def _similar(spark, sf, prepared):
    base, _ = _vector_base(spark, sf, prepared)
    vectors = _base_vectors(base)
    titles = base.where(F.col("embedding").isNotNull()).select("item_id", "title_final")
    return similar_items(titles, vectors, _lowest_index(vectors), SEEDS, K_NEIGHBOURS, nprobe=1)


def q_similar_items(spark, sf):
    return _similar(spark, sf, _prepared(spark, sf))


def _text_key(df):
    return df.withColumn("item_id", F.concat(F.lit("B"), F.col("item_id").cast("string")))


def q_similar_items_string_keys(spark, sf):
    items, responses = _text_key(_items(spark, sf)), _text_key(FX.responses_view(spark, sf))
    return _similar(spark, sf, E.prepare_items(items, responses))


def q_knn_exact_string_keys(spark, sf):
    e = _text_key(_emb(spark, sf))
    return _rounded(knn_exact(_queries_from(e), e, K_NEIGHBOURS, exclude_self=True))


def q_assign_cells_fallback(spark, sf):
    """The form for centroids past the broadcast bound."""
    a = assign_cells(_emb(spark, sf), FX.supplied_centroids(spark, sf, SUPPLIED_CELLS), cfg=TILED)
    return a.select("item_id", "cell_id")


def q_run_summary(spark, sf):
    base, seen = _vector_base(spark, sf, _prepared(spark, sf))
    return R.observed_summary(seen.get, _lowest_index(_base_vectors(base)).cells)


def _shared(spark, name):
    """A new folder where all executors write and read."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_load_items(spark, sf):
    """Documents as a catalogue with its own key name, one text column absent and one of floats."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rank = F.when(F.col("doc_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("doc_id").cast("double"))
    src = d.select(F.col("doc_id").alias("sku"), F.col("text").alias("description"), F.col("lang").alias("genres"), rank.alias("title"))
    return load_items(spark, src, key="sku").withColumn("title", F.col("title").cast("double").cast("bigint"))


def _load_responses(fmt):
    def run(spark, sf):
        path = _shared(spark, f"responses-{fmt}")
        FX.responses_view(spark, sf).withColumnRenamed("item_id", "sku").write.format(fmt).save(path)
        return load_responses(spark, path, key="sku", fmt=fmt)

    return run


def q_embeddings_round_trip(spark, sf):
    path = _shared(spark, "embeddings")
    write_embeddings(_emb(spark, sf), path)
    return load_embeddings(spark, path)


def q_pending_embeddings(spark, sf):
    todo = E.embeddable(_prepared(spark, sf)).select("item_id", "embedding_input")
    return pending(todo, _emb(spark, sf))


def _trained_index(spark, sf):
    return build_index(_emb(spark, sf), nlist=SUPPLIED_CELLS, seed=7, max_iter=10)


def q_build_index_trained(spark, sf):
    return _index_facts(_trained_index(spark, sf), SUPPLIED_CELLS)


def _index_facts(index, max_cells):
    """What holds for any trained index: all rows are in it, in at most ``max_cells`` cells,
    each in its nearest one (found again by the exact search over the centroids)."""
    cells = cut_lineage(index.cells)
    near = knn_exact(
        cells.select(F.col("item_id").alias("query_id"), "embedding"),
        index.centroids.select(F.col("cell_id").alias("item_id"), F.col("centroid").alias("embedding")),
        1,
        strategy="tiled",
    )
    both = cells.join(near.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("nearest")), "item_id", "left")
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count_distinct("cell_id") <= max_cells).alias("cells_in_bound"),
        F.count_if(~F.col("cell_id").eqNullSafe(F.col("nearest"))).alias("n_not_nearest"),
    )


def q_knn_ivf_trained(spark, sf):
    """Probing every cell of a trained index is exact search."""
    e = _emb(spark, sf)
    res = knn_ivf(_queries_from(e), _trained_index(spark, sf), K_NEIGHBOURS, SUPPLIED_CELLS, exclude_self=True)
    return _rounded(res)


# A training whose every step is met: nodes are split, and split again, before the last fits.
LEVELS = {"fit_cells": 6, "fan_out": 3, "fit_rows": 400}
MANY_CELLS = 60


def _two_level_index(spark, sf):
    e = _emb(spark, sf)
    centroids = cut_lineage(train_in_levels(e, MANY_CELLS, seed=7, **LEVELS))
    return build_index(e, nlist=MANY_CELLS, centroids=centroids, cfg=TILED)


def q_build_index_two_level(spark, sf):
    """As ``build_index_trained``, the cells trained level by level and assigned through their groups."""
    return _index_facts(_two_level_index(spark, sf), MANY_CELLS)


def q_knn_ivf_two_level(spark, sf):
    """Probing every cell of an index trained level by level is exact search."""
    index = _two_level_index(spark, sf)
    return _rounded(knn_ivf(_queries_from(_emb(spark, sf)), index, K_NEIGHBOURS, MANY_CELLS, exclude_self=True))


def q_assign_cells_tree(spark, sf):
    """Nearest cells of more centroids than most groups hold, through the groups."""
    tree = grow(FX.supplied_centroids(spark, sf, MANY_CELLS))
    return assign_in_tree(_emb(spark, sf), tree).select("item_id", "cell_id")


def _knn_stored(prune, strategy="auto", cfg=None):
    """Save, load and search: the neighbours of the index that was saved."""

    def run(spark, sf):
        path = _shared(spark, "index")
        cents = FX.supplied_centroids(spark, sf, SUPPLIED_CELLS)
        save_index(build_index(_emb(spark, sf), centroids=cents, nlist=SUPPLIED_CELLS, validate="write", dim=DIM), path)
        kw = {"cfg": cfg} if cfg else {}
        queries = _queries_from(_emb(spark, sf))
        return _rounded(knn_ivf(queries, load_index(spark, path), K_NEIGHBOURS, 4, exclude_self=True, strategy=strategy, prune=prune, **kw))

    return run


def q_enrichment_round_trip(spark, sf):
    path = _shared(spark, "enrichment")
    write_enrichment(E.enrich(E.needs_enrichment(_items(spark, sf)), FX.responses_view(spark, sf)), path)
    return read_enrichment(spark, path)


def q_materialized_stage(spark, sf):
    """A stage built once: the second call reads the finished table and must not build."""
    path = _shared(spark, "stage")

    def again():
        raise AssertionError("a finished stage was built again")

    materialize(spark, path, lambda: E.needs_enrichment(_items(spark, sf)))
    return materialize(spark, path, again)


# Whole texts that a bucket of a landed catalogue is meant to hold.
TEXTS_PER_BUCKET = 20_000


class _Killed(Exception):
    pass


def q_build_job_resumed(spark, sf):
    """A build that dies while it encodes, its second run, and what the third finds to do: the cells of a clean build."""
    # The catalogue as a landed table, bucketed by key: the joins of all runs leave its texts where they lie.
    view, responses, out = _items(spark, sf), FX.responses_view(spark, sf), _shared(spark, "job")
    # with fewer buckets than a shuffle has partitions, joins would deal the texts anew
    rows = max(view.count(), TEXTS_PER_BUCKET * int(spark.conf.get("spark.sql.shuffle.partitions")))
    landed = KeyedRuns(spark, _shared(spark, "items"), view.schema, ["item_id"], rows, rows_per_bucket=TEXTS_PER_BUCKET)
    landed.append(view)
    (items,) = landed.finished()
    vectors = cut_lineage(hash_embed(E.prepare_items(items, responses), DIM))
    number = F.col("item_id").cast("int").alias("cell_id")
    cents = cut_lineage(vectors.orderBy("item_id").limit(SUPPLIED_CELLS).select(number, F.col("embedding").alias("centroid")))

    def die():
        raise _Killed

    try:
        build_job(spark, items, responses, out, dim=DIM, centroids=cents, encoder_factory=die)
    except Exception as e:
        if _Killed.__name__ not in str(e):
            raise
    else:
        raise AssertionError("the first run was to die")

    def must_not():
        def encode(texts):
            raise AssertionError(f"{len(texts)} texts were encoded again")

        return encode

    build_job(spark, items, responses, out, dim=DIM, centroids=cents)
    done = build_job(spark, items, responses, out, dim=DIM, centroids=cents, encoder_factory=must_not)
    return done.index.cells.select("item_id", "cell_id")


def q_pending_runs(spark, sf):
    """Keys left to do on a store of two finished runs and one that died: what is done is read bucket by bucket."""
    todo = E.embeddable(_prepared(spark, sf)).select("item_id", "embedding_input")
    root = _shared(spark, "runs")
    runs = KeyedRuns(spark, root, embedding_schema(), ["item_id"])
    for part in (0, 1):
        runs.append(_emb(spark, sf).where(F.col("item_id") % 2 == part))
    # a folder that has files but no marker, as a killed run leaves it: all items, none of them done
    write_embeddings(todo.select("item_id", F.lit(None).cast("array<float>").alias("embedding")), f"{root}/run=00002/_temporary")
    return runs.pending(todo)


#: Every string of three letters.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
MANY_SEEDS = [a + b + c for a in LETTERS for b in LETTERS for c in LETTERS]


def q_first_matches_many(spark, sf):
    """The first title of each of 17,576 seeds, in one pass over the titles."""
    return first_matches(search_titles(E.embeddable(_prepared(spark, sf)), MANY_SEEDS))


def vector_queries() -> dict[str, Query]:
    return {
        "validate_vectors": q_validate_vectors,
        "l2_distance": q_l2_distance,
        "hash_embed": q_hash_embed,
        "embed_python_encoder": q_embed_python_encoder,
        "assign_cells": q_assign_cells,
        "knn_exact": _knn_exact("auto"),
        "knn_exact_tiled": _knn_exact("tiled", TILED),
        "knn_ivf_nprobe1": _knn_ivf(1),
        "knn_ivf_nprobe4": _knn_ivf(4),
        "knn_ivf_nprobe4_tiled": _knn_ivf(4, "tiled", TINY_TILES),
        "knn_ivf_nprobe16": _knn_ivf(16),
        "recall_at_k": q_recall_at_k,
        "cell_sizes": q_cell_sizes,
        "index_integrity": q_index_integrity,
        "search_titles": q_search_titles,
        "build_hash_index": q_build_hash_index,
        "similar_items": q_similar_items,
        "similar_items_string_keys": q_similar_items_string_keys,
        "knn_exact_string_keys": q_knn_exact_string_keys,
        "assign_cells_fallback": q_assign_cells_fallback,
        "load_items": q_load_items,
        "load_responses_parquet": _load_responses("parquet"),
        "load_responses_json": _load_responses("json"),
        "embeddings_round_trip": q_embeddings_round_trip,
        "run_summary": q_run_summary,
        "pending_embeddings": q_pending_embeddings,
        "build_index_trained": q_build_index_trained,
        "knn_ivf_trained": q_knn_ivf_trained,
        "build_index_two_level": q_build_index_two_level,
        "knn_ivf_two_level": q_knn_ivf_two_level,
        "assign_cells_tree": q_assign_cells_tree,
        "knn_ivf_stored": _knn_stored(False),
        "knn_ivf_stored_pruned": _knn_stored(True),
        "knn_ivf_stored_pruned_tiled": _knn_stored(True, "tiled", TINY_TILES),
        "enrichment_round_trip": q_enrichment_round_trip,
        "materialized_stage": q_materialized_stage,
        "build_job_resumed": q_build_job_resumed,
        "pending_runs": q_pending_runs,
        "first_matches_many": q_first_matches_many,
    }


def all_queries() -> dict[str, Query]:
    q = dict(text_queries())
    q.update(vector_queries())
    return q


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The headline query used by ``entry()``: the similar-items report."""
    return q_similar_items(spark, sf)
