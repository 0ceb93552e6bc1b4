"""Groups compared in tiles: every pair of a group's members meets in exactly one task's tile.

A group of n members is cut into blocks by hash, and each pair of blocks is a
tile, so a group holding a third of all rows spreads over many tasks and no
task holds more than two blocks. A tile gives one row per member: how much
weight it is linked to, and the smallest member its links reach inside the
tile. Pairs are never written out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut

RESULT = "node binary, root binary, links bigint, tiles int"


def link_tiles(members: DataFrame, payload: DataFrame, linked, block_rows: int, block_size: int) -> DataFrame:
    """``(node, root, links, tiles)`` per member and tile.

    ``members``: (node, grp, weight, size); ``payload``: (node, payload binary). ``linked`` takes
    a list of payloads and returns the boolean matrix of links. Blocks hold about ``block_rows``
    members or ``block_size`` of ``size`` in total.
    """
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum("size") / block_size), F.lit(1))
    # written, so that the join reads plain shuffles and a large group can be split over tasks
    groups = cut(members.groupBy("grp").agg(blocks.cast("int").alias("blocks")))
    dealt = (
        members.join(groups, "grp")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .join(payload, "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
            "node", "block", "weight", "payload", (F.col("blocks") * (F.col("blocks") + 1) / 2).cast("int").alias("tiles"),
        )
    )
    schema = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("links", pa.int64()), ("tiles", pa.int32())])

    def kernel(batches):
        for rows in _runs(batches):
            if len(rows) < 2:
                continue
            rows.sort(key=lambda r: r["node"])
            block = np.array([r["block"] for r in rows])
            links = linked([r["payload"] for r in rows])
            np.fill_diagonal(links, False)
            if rows[0]["lo"] != rows[0]["hi"]:  # pairs inside a block belong to that block's own tile
                links &= block[:, None] != block[None, :]
            roots = smallest_reachable(links)
            weights = links @ np.array([r["weight"] for r in rows], dtype=np.float64)
            some = np.flatnonzero(links.any(1)).tolist()
            if some:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[i]["node"] for i in some], pa.binary()), pa.array([rows[roots[i]]["node"] for i in some], pa.binary()),
                     pa.array([int(weights[i]) for i in some], pa.int64()), pa.array([rows[0]["tiles"]] * len(some), pa.int32())],
                    schema=schema)

    return dealt.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi").mapInArrow(kernel, RESULT)


def _runs(batches):
    """The rows of each tile from batches that are sorted by tile."""
    held, key = [], None
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            for row in batch.slice(lo, 1024).to_pylist():
                now = (row["grp"], row["lo"], row["hi"])
                if now != key:
                    if held:
                        yield held
                    held, key = [], now
                held.append(row)
    if held:
        yield held


def smallest_reachable(links: np.ndarray) -> np.ndarray:
    """Per row of a symmetric boolean matrix the smallest row its links reach."""
    n = len(links)
    label = np.arange(n)
    while True:
        new = label.copy()
        for lo in range(0, n, 256):
            part = links[lo : lo + 256]
            new[lo : lo + 256] = np.minimum(label[lo : lo + 256], np.where(part, label[None, :], n).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new
