"""End-to-end jobs: build (Q2), similar-items report (Q3), run report (Q4).

The build job is resumable at two stages, with exactly-once rows per key:
each run writes its new rows to a fresh run folder (``sources.runs``), and the
next run processes only keys missing from the finished folders. A run killed
half way therefore loses at most its own unfinished folder.

What is stored is what was found, so a rerun equals a clean run on the same
inputs: an item whose response lands later is looked up again until one is
found, and a vector is kept under its item and the digest of its text, so a
changed text is encoded anew and the old vector is no longer taken.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import enrich as E
from nearfield.operators import reports as R
from nearfield.operators.embed import Encoder, embed, hash_embed
from nearfield.operators.index import IvfIndex, build_index, knn_ivf
from nearfield.operators.knn import DEFAULT_CONFIG
from nearfield.operators.titles import search_titles
from nearfield.session import cut_lineage
from nearfield.sources.catalog import check_keys, embedding_schema, enrichment_schema, key_type
from nearfield.sources.runs import KeyedRuns
from nearfield.sources.store import index_bytes, load_index, save_index

# Shown when a neighbour has no title (fixed value).
UNKNOWN_TITLE = "(unknown)"
DEFAULT_K = 5
DISTANCE_DIGITS = 4
# Generous size of a key in a broadcast table.
ROW_BYTES = 512


# ------------------------------------------------------------ title search
def first_matches(matches: DataFrame) -> DataFrame:
    """``(seed, seed_item_id)``: the smallest matching item id per seed."""
    return matches.groupBy("seed").agg(F.min("item_id").alias("seed_item_id"))


# --------------------------------------------------------- similar items
def similar_items(
    titles: DataFrame,
    vectors: DataFrame,
    index: IvfIndex,
    seeds: list[str],
    k: int = DEFAULT_K,
    nprobe: int = 1,
    literal: bool = False,
) -> DataFrame:
    """Q3: ``(seed, seed_item_id, seed_title, rank, item_id, title, distance)``.

    ``titles`` needs ``(item_id, title_final)`` of the embeddable items only, so
    no text of any item takes part.

    For each seed, the first embeddable item whose title matches, then its k
    nearest indexed items (itself excluded) by squared L2 distance rounded to
    4 decimals. Seeds without a match produce no rows.
    """
    titles = titles.select("item_id", "title_final")
    first = first_matches(search_titles(titles, seeds, literal))
    # The sides marked below hold at most len(seeds) or len(seeds) * k rows: while
    # that many stay under the broadcast bound, the big tables are never shuffled
    # here; past it the joins are left to the optimizer.
    small = len(seeds) * k * ROW_BYTES <= DEFAULT_CONFIG.max_broadcast_bytes
    sent = F.broadcast if small else (lambda df: df)
    seed_ids = sent(first.select(F.col("seed_item_id").alias("item_id")).distinct())
    q = vectors.join(seed_ids, "item_id").select(F.col("item_id").alias("query_id"), "embedding")
    # The queries are rows of the index, which were checked when it was built.
    nbrs = knn_ivf(q, index, k, nprobe, exclude_self=True, max_queries=len(seeds), validate=False)
    seed_titles = titles.join(seed_ids, "item_id").select(
        F.col("item_id").alias("seed_item_id"), F.col("title_final").alias("seed_title")
    )
    nbr_titles = titles.join(sent(nbrs.select("item_id").distinct()), "item_id")
    out = (
        first.join(seed_titles, "seed_item_id", "left")
        .join(nbrs, F.col("seed_item_id") == F.col("query_id"))
        .join(nbr_titles, "item_id", "left")
    )
    return out.select(
        "seed",
        "seed_item_id",
        "seed_title",
        "rank",
        "item_id",
        F.coalesce(F.col("title_final"), F.lit(UNKNOWN_TITLE)).alias("title"),
        F.round("distance", DISTANCE_DIGITS).alias("distance"),
    )


# ------------------------------------------------------------ build job
def append_missing(runs: KeyedRuns, todo: DataFrame, build) -> None:
    """Build the rows of ``todo`` whose keys ``runs`` doesn't have yet, as a new run."""
    runs.append(build(runs.pending(todo)))


@dataclass
class BuildResult:
    prepared: DataFrame
    embeddings: DataFrame
    index: IvfIndex
    integrity: DataFrame
    summary: DataFrame
    index_path: str
    embeddings_path: str
    elapsed_seconds: float


def build_job(
    spark: SparkSession,
    items: DataFrame,
    responses: DataFrame,
    out_dir: str,
    dim: int = 64,
    nlist: int | None = None,
    centroids: DataFrame | None = None,
    encoder_factory: Callable[[], Encoder] | None = None,
    max_review_words: int = 256,
    seed: int = 42,
) -> BuildResult:
    """Q2 + Q4: prepare, enrich (resumable), embed (resumable), index, verify.

    ``encoder_factory`` plugs a batch encoder (``() -> Encoder``); by default
    the hashing encoder is used. ``nlist`` defaults to the square root of the
    number of vectors. Null or repeated item keys raise ``ValueError``.
    """
    began = time.time()
    root = out_dir.rstrip("/")
    n_items = check_keys(items)
    key = key_type(items)
    tiered = E.with_tier(items)
    # Keys are written and meet what is done; of the texts, which may come from a join, each step below
    # reads those that it needs once.
    weak = cut_lineage(tiered.where(F.col("initial_tier") == 4).select("item_id"))
    enriched = KeyedRuns(spark, f"{root}/enrichment", enrichment_schema(key), ["item_id"], n_items)
    # Found results only: an item without one stays due for the next run.
    append_missing(enriched, weak, lambda due: due.join(E.top_results(responses), "item_id"))
    # Items that are no longer weak keep their own fields, as in a clean run.
    prepared = E.finalize(E.merge_enrichment(tiered, enriched.of(weak)), max_review_words)
    texts = E.embeddable(prepared).select("item_id", F.md5("embedding_input").alias("text_md5"), "embedding_input")
    keys = cut_lineage(texts.select("item_id", "text_md5"))
    embeddings_path = f"{root}/embeddings"
    embedded = KeyedRuns(spark, embeddings_path, embedding_schema(key).add("text_md5", "string"), ["item_id", "text_md5"], n_items)

    def encode(due: DataFrame) -> DataFrame:
        due = cut_lineage(due)
        # Texts stay where the items are: only keys, which are unique, are dealt to buckets and back.
        missing = texts.limit(0) if due.isEmpty() else texts.join(due.select("item_id"), "item_id", "left_semi")
        if encoder_factory is None:
            return hash_embed(missing, dim, carry=["text_md5"])
        return embed(missing, encoder_factory, dim, carry=["text_md5"])

    append_missing(embedded, keys, encode)
    # Only the vectors of the present texts count.
    embeddings = embedded.of(keys).select("item_id", "embedding")
    # The vectors are checked while the index is written: no scan of their own.
    index = build_index(embeddings, nlist=nlist, centroids=centroids, seed=seed, validate="write", dim=dim)
    index_path = f"{root}/index"
    save_index(index, index_path)
    index = load_index(spark, index_path)
    integrity = R.index_integrity(index.cells, embeddings)
    elapsed = round(time.time() - began, 3)
    figures = {"index_bytes": float(index_bytes(spark, index_path)), "elapsed_seconds": elapsed}
    summary = R.run_summary(prepared, index.cells, figures=figures)
    return BuildResult(prepared, embeddings, index, integrity, summary, index_path, embeddings_path, elapsed)
