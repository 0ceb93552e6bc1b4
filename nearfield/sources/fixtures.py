"""Catalogue fixtures derived from the driver tables.

``items`` and ``responses`` are *views* over ``documents``/``conversations``
and ``part``: every row of the base tables flows through, so the work grows
with the tables. The modulo rules only decide which fields are blank; no row
is dropped. The DuckDB text of the same views lives in
``nearfield.plans.oracle`` and must stay equal to these definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.vectors import to_float_vector

# Tables smaller than this are left in one task: spreading them costs more
# (an extra stage) than it saves.
SPREAD_MIN_BYTES = 256 << 10


def spread(df: DataFrame, min_bytes: int = SPREAD_MIN_BYTES) -> DataFrame:
    """Round-robin repartition of a given table that arrives in fewer splits
    than there are cores (one file with a single row group), so that heavy
    per-row work does not stay on one core. Tuning of these fixtures only:
    tables at scale arrive in many splits and are left as they are."""
    want = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    # Splits and estimated size from the JVM plan (no job runs).
    have = plan.executedPlan().execute().getNumPartitions()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    return df if have >= want or size < min_bytes else df.repartition(want)


def table(spark: SparkSession, sf_dir: str, name: str, min_bytes: int | None = None) -> DataFrame:
    """A driver table, spread over the cores when it arrives in too few splits."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if min_bytes is None else spread(df, min_bytes=min_bytes)


def user_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per conversation: the largest user text (partial aggregate,
    so a conversation holding a third of all turns is combined map-side)."""
    conv = table(spark, sf_dir, "conversations")
    return (
        conv.where(F.col("role") == "user")
        .groupBy("conv_id")
        .agg(F.max("text").alias("review_text"))
    )


def items_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``items(item_id, title, genres, description, review_text)``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    r = user_reviews(spark, sf_dir)
    j = d.join(r, d["doc_id"] == r["conv_id"], "left")
    m10, m7, m5 = F.col("doc_id") % 10, F.col("doc_id") % 7, F.col("doc_id") % 5
    title = (
        F.when(m10.isin(0, 1), F.lit(None).cast("string"))
        .when(m10 == 2, F.lit("  "))
        # First line; substring_index stops at the first newline instead of
        # splitting the whole text (same result as split_part(text, '\n', 1)).
        .otherwise(F.substring_index(F.col("text"), "\n", 1))
    )
    genres = (
        F.when(m7 == 0, F.lit(None).cast("string"))
        .when(m7 == 1, F.lit(""))
        .otherwise(F.concat(F.col("lang"), F.lit("|"), F.col("source")))
    )
    # The description is the whole document text (never a prefix).
    description = F.when(m5 == 0, F.lit(None).cast("string")).otherwise(F.col("text"))
    return j.select(
        F.col("doc_id").alias("item_id"),
        title.alias("title"),
        genres.alias("genres"),
        description.alias("description"),
        F.col("review_text"),
    )


def responses_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``responses(item_id, body)``: landed search responses, some malformed
    (``p_partkey % 13 = 0``), some empty (``% 4 = 0``), the rest with two
    results of which only the first counts."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    good = F.concat(
        F.lit('{"results":[{"title":"'),
        F.col("p_name"),
        F.lit('","overview":"'),
        F.col("p_brand"),
        F.lit(" "),
        F.col("p_type"),
        F.lit('","genre_ids":['),
        F.col("p_size").cast("string"),
        F.lit(","),
        (key % 20).cast("string"),
        F.lit(']},{"title":"second"}]}'),
    )
    body = (
        F.when(key % 13 == 0, F.lit("not json"))
        .when(key % 4 == 0, F.lit('{"results":[]}'))
        .otherwise(good)
    )
    return p.select(key.alias("item_id"), body.alias("body"))


def embeddings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver vectors as ``(item_id, embedding)``."""
    # Vector rows carry heavy per-row work (distances), so even a small file
    # is spread when it arrives in fewer splits than there are cores.
    e = table(spark, sf_dir, "embeddings", min_bytes=0)
    return e.select(F.col("vec_id").alias("item_id"), to_float_vector("embedding").alias("embedding"))


def supplied_centroids(spark: SparkSession, sf_dir: str, nlist: int = 16) -> DataFrame:
    """Fixed centroids: the driver vectors with ``vec_id < nlist``."""
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") < nlist).select(
        F.col("vec_id").cast("int").alias("cell_id"),
        F.col("embedding").cast("array<float>").alias("centroid"),
    )
