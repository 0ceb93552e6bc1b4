"""Catalogue sources and sinks: items, responses, enrichment, embeddings.

All readers return lazy DataFrames with only the needed columns selected, so
Catalyst prunes the parquet scan (``ReadSchema``) and pushes filters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_COLUMNS = ("title", "genres", "description", "review_text")


def enrichment_schema(key: T.DataType = T.LongType()) -> T.StructType:
    """Landed enrichment rows; keys are whole numbers or strings."""
    return T.StructType(
        [
            T.StructField("item_id", key, False),
            T.StructField("e_title", T.StringType()),
            T.StructField("e_description", T.StringType()),
            T.StructField("e_genres", T.StringType()),
        ]
    )


def embedding_schema(key: T.DataType = T.LongType()) -> T.StructType:
    return T.StructType(
        [
            T.StructField("item_id", key, False),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
        ]
    )


def key_type(df: DataFrame, key: str = "item_id") -> T.DataType:
    """The stored type of a key column: string, or bigint for whole numbers."""
    return T.StringType() if isinstance(df.schema[key].dataType, T.StringType) else T.LongType()


def _as_df(spark: SparkSession, src: str | DataFrame) -> DataFrame:
    return spark.read.parquet(src) if isinstance(src, str) else src


def normalize_items(df: DataFrame, key: str = "item_id") -> DataFrame:
    """Key renamed to ``item_id``; absent text columns supplied as null;
    non-string text columns (e.g. floating NaN junk) cast to string with NaN
    mapped to null."""
    if key not in df.columns:
        raise KeyError(f"key column '{key}' not found; columns are {df.columns}")
    types = dict(df.dtypes)
    cols = [F.col(key).alias("item_id")]
    for c in TEXT_COLUMNS:
        if c not in df.columns:
            cols.append(F.lit(None).cast("string").alias(c))
        elif types[c] in ("float", "double"):
            cols.append(F.when(~F.isnan(F.col(c)), F.col(c).cast("string")).alias(c))
        elif types[c] != "string":
            cols.append(F.col(c).cast("string").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def load_items(spark: SparkSession, src: str | DataFrame, key: str = "item_id") -> DataFrame:
    """Items ``(item_id, title, genres, description, review_text)`` from a
    parquet path or a DataFrame; raises ``KeyError`` when the key is absent."""
    return normalize_items(_as_df(spark, src), key)


def check_keys(items: DataFrame) -> int:
    """Fail on null or duplicate keys (one aggregate; opt-in, it shuffles keys); returns their number."""
    r = items.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("item_id").alias("n_key"),
        F.count_distinct("item_id").alias("n_distinct"),
    ).first()
    if r["n_key"] != r["n"]:
        raise ValueError(f"{r['n'] - r['n_key']} rows have a null item_id")
    if r["n_distinct"] != r["n_key"]:
        raise ValueError(f"{r['n_key'] - r['n_distinct']} duplicate item_id values")
    return r["n"]


def load_responses(
    spark: SparkSession, src: str | DataFrame, key: str = "item_id", fmt: str = "parquet", key_as: str = "bigint"
) -> DataFrame:
    """Landed search responses ``(item_id, body)`` from parquet, JSON lines
    (``fmt="json"``, keys read as ``key_as``) or a DataFrame."""
    if isinstance(src, str) and fmt == "json":
        df = spark.read.schema(f"`{key}` {key_as}, body string").json(src)
    elif fmt not in ("parquet", "json"):
        raise ValueError(f"unknown response format {fmt!r}")
    else:
        df = _as_df(spark, src)
    return df.select(F.col(key).alias("item_id"), F.col("body").cast("string"))


def write_enrichment(df: DataFrame, path: str) -> None:
    schema = enrichment_schema(key_type(df))
    df.select([F.col(f.name).cast(f.dataType) for f in schema.fields]).write.mode("overwrite").parquet(path)


def read_enrichment(spark: SparkSession, path: str, key: T.DataType = T.LongType()) -> DataFrame:
    return spark.read.schema(enrichment_schema(key)).parquet(path)


def write_embeddings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    schema = embedding_schema(key_type(df))
    df.select([F.col(f.name).cast(f.dataType) for f in schema.fields]).write.mode(mode).parquet(path)


def load_embeddings(spark: SparkSession, path: str, key: T.DataType = T.LongType()) -> DataFrame:
    return spark.read.schema(embedding_schema(key)).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def is_complete(spark: SparkSession, path: str) -> bool:
    """A finished Spark write leaves a ``_SUCCESS`` marker."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def materialize(
    spark: SparkSession, path: str, builder: Callable[[], DataFrame], schema: T.StructType | None = None
) -> DataFrame:
    """Reuse a finished stage output, else build it, write it and read it back.

    Only a complete write (``_SUCCESS``) counts, so a stage killed half-way is
    rebuilt instead of being taken as done.
    """
    if not is_complete(spark, path):
        builder().write.mode("overwrite").parquet(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def pending(items: DataFrame, done: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows of ``items`` whose key is not yet in ``done`` (left anti-join)."""
    return items.join(done.select(key), key, "left_anti")
