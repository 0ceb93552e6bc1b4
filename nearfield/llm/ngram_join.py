"""Similarity join of documents on word shingles: MinHash LSH forest, then exact Jaccard.

A text's shingles are the runs of ``words`` lower-cased words (a shorter text
is one shingle), as 64-bit hashes. Documents with the same set of shingles form
one node; all further work is per node, so exact copies cost nothing.

Candidates come from an LSH forest (see ``lsh_forest``): sorted tries of MinHash
paths whose matched prefixes are shortened from ``max_depth`` values on until the
links found, by their own estimated similarities, are the wanted share
(``target``) of all. Nodes tied there to a common leader, each found alike by its
signature, form groups; sharing a prefix alone forms none.
Each group's members then bring their shingle sets once, and all their pairs
are verified exactly in tiles (see ``tiles``), which counts links and joins
classes without writing pairs, so large groups of near copies neither overfill
a task nor lose a link.

Sets are made again from the text for candidates only, so the sets of other
documents are never stored or moved.

Texts without a word link with nothing. Null text counts as empty, null ids
rank above all others, repeated rows are copies of each other. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from nearfield.llm.common import cut, per_process, release, slices
from nearfield.llm.components import components
from nearfield.llm.lsh_forest import forest_ties, signatures
from nearfield.llm.tiles import link_tiles

_WORD = re.compile(r"\w+")
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def shingles(text: str, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    found = _WORD.findall(text.lower())
    n = len(found)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    size = min(words, n)
    if not size:
        return h
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):  # order matters: a polynomial in an odd multiplier, then a finaliser
        out = out * np.uint64(_MIX[0]) + h[i : n - size + 1 + i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(_MIX[1])
    out ^= out >> np.uint64(32)
    return np.unique(out)


def similar_sets(payloads: list[bytes], similarity: float) -> np.ndarray:
    """Boolean matrix of pairs of sets (sorted 64-bit hashes) with Jaccard similarity at or above the threshold."""
    sets = [np.frombuffer(p, "<u8") for p in payloads]
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    if n == 2:
        common = np.zeros((2, 2))
        common[0, 1] = common[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        common = np.zeros((n, n))
        _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), size.astype(np.int64))
        shared = seen[column] > 1
        column, row = column[shared], row[shared]
        if len(column):
            column = np.unique(column, return_inverse=True)[1]
            order = np.argsort(column, kind="stable")
            column, row = column[order], row[order]
            step = max(64, min(4096, (8 << 20) // n))
            for lo in range(0, int(column[-1]) + 1, step):
                a, b = np.searchsorted(column, [lo, lo + step])
                dense = np.zeros((n, step), dtype=np.float32)
                dense[row[a:b], column[a:b] - lo] = 1
                common += dense @ dense.T
    return common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9


def join_similar(
    docs: DataFrame,
    similarity: float = 0.8,
    words: int = 5,
    tries: int = 32,
    max_depth: int = 8,
    target: float = 0.99999,
    block_rows: int = 1024,
    block_shingles: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``class_id`` (smallest id of its class), ``n_links`` (other documents
    linked directly, copies included), ``kept`` (one row per class), ``text_hash``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    id_type = src.schema["id"].dataType
    noted = pa.schema([("id", to_arrow_type(id_type)), ("h", pa.int64()), ("node", pa.binary()), ("size", pa.int64()),
                       ("sig", pa.binary())])

    def sign(batches):
        hashes = per_process(("word hashes",), WordHashes)
        for batch in batches:
            for ids, hs, texts in slices(batch, 256, ["id", "h", "text"]):
                sets = [shingles(t, words, hashes) for t in texts]
                some = [i for i, s in enumerate(sets) if len(s)]
                sigs = [None] * len(sets)
                if some:
                    for i, own in zip(some, signatures([sets[i] for i in some], tries, max_depth)):
                        sigs[i] = own
                # a text without words is a node of its own
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, noted[0].type), pa.array(hs, pa.int64()), pa.array(nodes, pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())], schema=noted)

    rows = cut(src.mapInArrow(sign, f"id {id_type.simpleString()}, h bigint, node binary, size bigint, sig binary"))
    # the smallest (id, text) of a node stands for it; null ids come last
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first")
    nodes = cut(
        rows.where("size > 0").groupBy("node").agg(first, F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    )
    ties = forest_ties(nodes.select("node", "sig"), similarity, tries, max_depth, target)
    groups = components(ties)
    release(docs.sparkSession)
    members = cut(
        groups.join(nodes, "node").select(
            "node", F.col("component").alias("grp"), F.col("n").alias("weight"), "size", "first.id", "first.h"
        )
    )
    wanted = members.select(F.col("node").alias("node_"), F.col("id").alias("id_"), F.col("h").alias("h_"))
    held = pa.schema([("node", pa.binary()), ("payload", pa.binary())])

    def collect_sets(batches):
        hashes = per_process(("word hashes",), WordHashes)
        for batch in batches:
            for nodes_, texts in slices(batch, 256, ["node_", "text"]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes_, pa.binary()), pa.array([shingles(t, words, hashes).tobytes() for t in texts], pa.binary())], schema=held)

    sets = (
        src.join(wanted, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")))
        .select("node_", "text")
        .mapInArrow(collect_sets, "node binary, payload binary")
        .dropDuplicates(["node"])  # rows that repeat an id and its text
    )
    tiles = cut(
        link_tiles(members.select("node", "grp", "weight", "size"), sets, lambda p: similar_sets(p, similarity), block_rows, block_shingles)
    )
    release(docs.sparkSession)
    links = tiles.groupBy("node").agg(F.sum("links").alias("links"))
    # a group of one tile is settled in it; only larger groups need their tiles joined
    within = tiles.where("tiles = 1").select("node", F.col("root").alias("class"))
    across = components(tiles.where("tiles > 1").select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = within.union(across.select("node", F.col("component").alias("class")))
    # nodes of any class: those without a link are a class of their own
    found = nodes.select("node", "first", "n").join(links, "node", "left").join(classes, "node", "left")
    found = found.select("node", "n", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class", "node").alias("class"))
    heads = cut(classes.join(nodes.select("node", "first"), "node").groupBy("class").agg(F.min("first").alias("head")))
    head = F.coalesce("head", "first")
    per_node = found.join(heads, "class", "left").select(
        "node", head["id"].alias("class_id"), head["h"].alias("class_h"), (F.col("links") + F.col("n") - 1).alias("n_links")
    )
    worded = rows.where("size > 0").select("id", "h", "node").join(per_node, "node")
    turn = F.row_number().over(Window.partitionBy("id", "h").orderBy(F.lit(0)))
    worded = worded.withColumn("turn", turn).select(
        "id", "class_id", "n_links",
        (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h")) & (F.col("turn") == 1)).alias("kept"), "h",
    )
    wordless = rows.where("size = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(True).alias("kept"), "h")
    return worded.union(wordless).select(F.col("id").alias(id_col), "class_id", "n_links", "kept", F.col("h").alias("text_hash"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each class."""
    verdicts = join_similar(docs, id_col=id_col, text_col=text_col, **params)
    # an id as two columns that are never null
    keys = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(id_col).isNull().alias("none")
    kept = verdicts.where("kept").select(*keys, F.col("text_hash").alias("h"))
    own = docs.select(F.struct("*").alias("row"), *keys, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    met = own.join(kept, ["key", "none", "h"], "left_semi")
    # rows that repeat an id and its words stay once, wordless ones all; the window has the
    # join's partitioning, so rows move once
    turn = F.row_number().over(Window.partitionBy("key", "none", "h").orderBy(F.lit(0)))
    wordless = ~F.coalesce(F.col(f"row.{text_col}"), F.lit("")).rlike(r"(?U)\w")
    return met.withColumn("turn", turn).where((F.col("turn") == 1) | wordless).select("row.*")
