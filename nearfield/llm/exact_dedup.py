"""Exact deduplication by Grace hashing.

Every task first collapses the copies it meets in an open-addressing table of
whole contents (bounded by ``table_bytes``; a full table is handed on and
started anew), so a text that makes up a third of all rows leaves each task
once. The collapsed records are then partitioned by content hash into Spark's
shuffle files. A task takes its partition's records into one table; when its
contents outgrow ``table_bytes``, table and remaining records are partitioned
by the next digit of the hash into spill files, and each of these is treated
the same way until it fits. Entries are equal only when their complete
contents are. Copies are absorbed on arrival, so only distinct contents need
room; one content larger than the bound is a bucket of its own.

Of equal texts (identical after lower-casing A-Z) the row with the largest id
stays; if that id occurs several times with that text, one of these rows
stays. Ids are whole numbers or any other type that Python orders as Spark does
(strings by code point); their type is kept. Null text counts as empty, null ids
rank lowest. Every row gets a result row. An empty table gives an empty result; other columns are ignored.

Spill files are unlinked temporary files of one task attempt: nobody else
reads them, and a lost task starts again from the shuffle files.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from nearfield.llm.common import cut, slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FANOUT = 16
_HEAD = "<qqqq"  # hash, content bytes, count, bytes of the largest id


class ContentTable:
    """Open addressing (linear probing, at most half full) over complete contents."""

    def __init__(self):
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.counts: list[int] = []
        self.largest: list[int | None] = []
        self.bytes = 0

    def add(self, h: int, content: bytes, count: int, largest: int | None) -> None:
        mask = len(self.slots) - 1
        at = (h * 0x9E3779B97F4A7C15 >> 20) & mask
        while (i := int(self.slots[at])) >= 0:
            if self.hashes[i] == h and self.contents[i] == content:
                self.counts[i] += count
                if self.largest[i] is None or (largest is not None and largest > self.largest[i]):
                    self.largest[i] = largest
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.counts.append(count)
        self.largest.append(largest)
        self.bytes += len(content) + 200  # with what an entry takes besides
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for i, h in enumerate(self.hashes):
            at = (h * 0x9E3779B97F4A7C15 >> 20) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i

    def records(self):
        return zip(self.hashes, self.contents, self.counts, self.largest)


def grace(records, table_bytes: int, level: int = 0):
    """Distinct contents of ``(hash, content, count, largest id)`` records, spilling what outgrows the bound.

    Levels use digits of the hash from bit 40 upwards; past the last digit a bucket stays whole.
    """
    table = ContentTable()
    spill = None
    shift = 40 + 4 * level
    for record in records:
        if spill is not None:
            _put(spill, record, shift)
            continue
        table.add(*record)
        if table.bytes > table_bytes and len(table.hashes) > 1 and shift < 64:
            spill = [tempfile.TemporaryFile() for _ in range(FANOUT)]
            for r in table.records():
                _put(spill, r, shift)
            table = ContentTable()
    if spill is None:
        yield from table.records()
        return
    for f in spill:
        with f:
            f.seek(0)
            yield from grace(_read(f), table_bytes, level + 1)


def _put(files, record, shift: int) -> None:
    h, content, count, largest = record
    f = files[(h >> shift) % FANOUT]
    shown = pickle.dumps(largest)
    f.write(struct.pack(_HEAD, h, len(content), count, len(shown)))
    f.write(content)
    f.write(shown)


def _read(f):
    while head := f.read(struct.calcsize(_HEAD)):
        h, size, count, shown = struct.unpack(_HEAD, head)
        yield h, f.read(size), count, pickle.loads(f.read(shown))


def exact_groups(
    docs: DataFrame,
    table_bytes: int = 64 << 20,
    partition_bytes: int = 32 << 20,
    max_partitions: int = 50_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    spark = docs.sparkSession
    norm = _normalised(text_col)
    src = docs.select(F.col(id_col).alias("id"), norm.alias("content"))
    rows = cut(
        docs.select(F.col(id_col).alias("id"), F.sha2(norm, 256).alias("sha"), F.octet_length(norm).alias("size"))
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    partitions = min(max_partitions, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // partition_bytes)))
    id_type = src.schema["id"].dataType
    in_arrow, in_sql = to_arrow_type(id_type), id_type.simpleString()
    partial = pa.schema([("h", pa.int64()), ("content", pa.binary()), ("n", pa.int64()), ("id", in_arrow)])

    def collapse(batches):
        table = ContentTable()

        def emit():
            done = table
            for lo in range(0, len(done.hashes), 512):
                cols = (done.hashes, done.contents, done.counts, done.largest)
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 512], f.type) for c, f in zip(cols, partial)], schema=partial)

        for batch in batches:
            for hashes, contents, ids in slices(batch, 512, ["h", "content", "id"]):
                for h, content, doc in zip(hashes, contents, ids):
                    table.add(h, content, 1, doc)
                if table.bytes > table_bytes:
                    yield from emit()
                    table = ContentTable()
        yield from emit()

    final = pa.schema([("sha", pa.string()), ("keep_id", in_arrow), ("group_size", pa.int64())])

    def merge(batches):
        records = (r for b in batches for part in slices(b, 512, ["h", "content", "n", "id"]) for r in zip(*part))
        out = []
        for _, content, count, largest in grace(records, table_bytes):
            out.append((hashlib.sha256(content).hexdigest(), largest, count))
            if len(out) == 4096:
                yield _batch(out, final)
                out = []
        if out:
            yield _batch(out, final)

    groups = (
        src.withColumn("h", F.xxhash64("content"))
        .mapInArrow(collapse, f"h bigint, content binary, n bigint, id {in_sql}")
        .repartition(partitions, "h")
        .mapInArrow(merge, f"sha string, keep_id {in_sql}, group_size bigint")
    )
    # of rows that repeat an id with one text, the first is the one that may stay
    turn = F.row_number().over(Window.partitionBy("sha", "id").orderBy(F.lit(0)))
    listed = rows.select("id", "sha").withColumn("turn", turn)
    return listed.join(groups, "sha").select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group of equal texts."""
    verdicts = exact_groups(docs, id_col=id_col, text_col=text_col, **limits)
    keys = _keys(id_col, isinstance(docs.schema[id_col].dataType, IntegralType))
    kept = verdicts.where("kept").select(*keys, F.col("text_sha256").alias("sha"))
    own = docs.select(F.struct("*").alias("row"), *keys, F.sha2(_normalised(text_col), 256).alias("sha"))
    met = own.join(kept, ["key", "none", "sha"], "left_semi")
    # an id repeated with one text is one document; the window has the join's partitioning, so rows move once
    turn = F.row_number().over(Window.partitionBy("key", "none", "sha").orderBy(f"row.{text_col}"))
    return met.withColumn("turn", turn).where("turn = 1").select("row.*")


def _keys(id_col: str, whole: bool):
    """An id as two columns that are never null."""
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)) if whole else F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return key.alias("key"), F.col(id_col).isNull().alias("none")


def _normalised(text_col: str):
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER).cast("binary")


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
