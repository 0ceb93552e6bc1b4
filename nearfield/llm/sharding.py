"""Longest-processing-time sharding of documents, equal texts kept together.

Groups of equal texts are sized by a partial aggregate on a 64-bit digest of
the text (two texts with one digest would merely travel together). Groups of
at least one part in ``shards * units`` of all bytes are scheduled on their
own: there can be no more than ``shards * units`` of them. All smaller groups
are bundled by digest into as many bundles. So the driver sorts at most
``2 * shards * units`` sizes by descending size and deals each to the
least-loaded shard through a heap, whatever the size of the input. Ties go by
digest, and to the smaller shard.

Slots number the rows of a shard from 0 without gaps: rows are numbered inside
blocks of a shard (by id and digest, about ``block_rows`` over all shards) and
the blocks' counts give each block its first slot, so no task holds a shard.

Null text counts as no bytes and groups with empty text. Rows with equal ids
get different slots; null ids are carried. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nearfield.llm.common import cut


def longest_first(sizes: list[tuple], shards: int) -> dict:
    """Deal ``(key, size)`` by descending size to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard_by_size(
    docs: DataFrame,
    shards: int = 24,
    units: int = 1024,
    block_rows: int = 20_000,
    row_bytes: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``size`` (UTF-8 bytes and ``row_bytes``), ``text_crc32``, ``shard``, ``slot``."""
    if shards < 1 or units < 1 or block_rows < 1:
        raise ValueError("shards, units and block_rows must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + row_bytes).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.xxhash64(text).alias("h"),
        )
    )
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bundles = shards * units
    least = max(1, -(-total // bundles))
    groups = rows.groupBy("h").agg(F.sum("size").alias("size"))
    # at most `bundles` groups reach `least` bytes, and there are `bundles` bundles
    sizes = (
        groups.select(
            (F.col("size") >= least).alias("alone"),
            F.when(F.col("size") >= least, F.col("h")).otherwise(_bundle(bundles)).alias("unit"),
            "size",
        )
        .groupBy("alone", "unit")
        .agg(F.sum("size").alias("size"))
        .collect()
    )
    dealt = longest_first([((r.alone, r.unit), r["size"]) for r in sizes], shards)
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("unit", T.LongType()), T.StructField("to", T.IntegerType())])
    of = {alone: spark.createDataFrame([(u, s) for (a, u), s in dealt.items() if a == alone], schema) for alone in (True, False)}
    blocks = max(1, -(-count // block_rows))
    placed = (
        rows.join(F.broadcast(of[True].select(F.col("unit").alias("h"), F.col("to").alias("own"))), "h", "left")
        .withColumn("unit", _bundle(bundles))
        .join(F.broadcast(of[False]), "unit", "left")
        .withColumn("shard", F.coalesce("own", "to"))
        .withColumn("block", F.pmod(F.xxhash64("id", "h"), F.lit(blocks)))
        .select("id", "size", "crc", "h", "shard", "block")
    )
    first = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "h")) - 1
    return (
        placed.withColumn("inside", inside)
        .join(first, ["shard", "block"])
        .select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
            (F.col("first") + F.col("inside")).alias("slot"),
        )
    )


def _bundle(bundles: int):
    return F.pmod(F.xxhash64("h"), F.lit(bundles))
