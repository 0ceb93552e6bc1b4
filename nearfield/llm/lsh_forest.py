"""An LSH forest over MinHash signatures, as sorted prefix tries.

Each node (a set) has a path of ``depth`` MinHash values in each of ``tries``
tries. A trie is the sorted list of its paths: nodes with a common prefix are
neighbours in it, and the longer of the prefixes that a path shares with its two
neighbours is the depth at which the node leaves its nearest relatives. One sort
serves all depths; paths that share too little with anyone are left out.

The join starts with the longest prefixes and then shortens them as far as needed.
At each depth the groups of equal prefixes whose members are not yet tied to each
other are worked through: every member not tied to it meets the group's smallest node (its leader), and the
share of equal values in both signatures estimates their similarity. Members
that are alike are tied to the leader. Where a group also has members that are
not, these and the members that could be similar to one of them meet each other,
in tiles of signatures. So whatever shares a prefix and is similar ends up tied,
and pages that merely share a template are not tied.

The estimates say how much is still to be found: a pair of similarity ``s`` meets
at depth ``d`` with probability ``1 - (1 - s ** d) ** tries``, so each pair found
stands for one over that many, and what any shorter prefix would find of them is
known. Prefixes are shortened to where the share found reaches the target, and
further if the links met there say so; one pair at the threshold itself is always reckoned with, so
that few or no pairs found never end the search early.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, release
from nearfield.llm.tiles import link_tiles

VALUE = 2  # bytes of a MinHash value
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
NODE_PAIR = "node binary, lead binary, similarity double"


def signatures(sets: list[np.ndarray], tries: int, depth: int) -> list[bytes]:
    """Per set (64-bit hashes, not empty) its paths, one trie after another, 16 bits a MinHash value."""
    rng = np.random.default_rng(20240229)
    factors = rng.integers(0, 1 << 63, tries * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, tries * depth, dtype=np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    every = np.concatenate(sets)
    out = np.empty((len(sets), tries * depth), dtype="<u2")
    for v in range(tries * depth):
        low = np.minimum.reduceat(every * factors[v] + shifts[v], starts)
        out[:, v] = ((low ^ (low >> np.uint64(31))) * _MIX >> np.uint64(48)).astype("<u2")
    return [row.tobytes() for row in out]


def meeting(similarity: float, depth: int, tries: int) -> float:
    """Probability that two sets share a prefix of ``depth`` values in some trie."""
    return 1 - (1 - similarity**depth) ** tries


def least_depth(similarity: float, tries: int, max_depth: int, target: float) -> int:
    """The longest prefix at which even pairs of just ``similarity`` meet with probability ``target``."""
    for depth in range(max_depth, 0, -1):
        if meeting(similarity, depth, tries) >= target:
            return depth
    raise ValueError("more tries are needed for this recall")


def matched_paths(nodes: DataFrame, tries: int, depth: int, least: int) -> DataFrame:
    """``(trie, path, node, depth)``: the paths of ``nodes (node, sig)`` that share a prefix of ``least``
    values or more with a neighbour in their sorted trie, and how long a one."""
    width = VALUE * depth
    paths = nodes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("trie")).select(
        "trie", F.expr(f"substring(sig, trie * {width} + 1, {width})").alias("path"), "node"
    )
    order = ("trie", "path", "node")
    schema = pa.schema([("trie", pa.int32()), ("path", pa.binary()), ("node", pa.binary()), ("depth", pa.int32())])

    def kernel(batches):
        held = None  # the last row, whose next neighbour is yet to come, and what it shares with the one before
        for batch in batches:
            if not batch.num_rows:
                continue
            tries_, paths_, nodes_ = (batch.column(i).to_pylist() for i in range(3))
            if held is not None:
                tries_, paths_, nodes_ = ([h, *x] for h, x in zip(held[:3], (tries_, paths_, nodes_)))
            P = np.frombuffer(b"".join(paths_), dtype="<u2").reshape(len(paths_), depth)
            T = np.array(tries_)
            same = np.cumprod(P[1:] == P[:-1], axis=1).sum(1) * (T[1:] == T[:-1])
            # a partition's outer rows may have a neighbour in the next one: they count as matched in full
            back = np.concatenate([[depth if held is None else held[3]], same])
            deep = np.maximum(back[:-1], same)
            held = (tries_[-1], paths_[-1], nodes_[-1], int(back[-1]))
            yield rows(tries_, paths_, nodes_, deep)
        if held is not None:
            yield rows(*([h] for h in held[:3]), np.array([depth]))

    def rows(tries_, paths_, nodes_, deep):
        some = np.flatnonzero(deep >= least).tolist()
        columns = ([tries_[i] for i in some], [paths_[i] for i in some], [nodes_[i] for i in some], deep[some].tolist())
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    laid = paths.repartitionByRange(*order).sortWithinPartitions(*order)
    return laid.mapInArrow(kernel, "trie int, path binary, node binary, depth int")


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, lead, similarity)``: the share of equal values in the signatures of each pair."""
    schema = pa.schema([("node", pa.binary()), ("lead", pa.binary()), ("similarity", pa.float64())])

    def kernel(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).mean(1))], schema=schema)

    # both joins read shuffles of their own, so that the pairs of a common leader can be split over tasks
    met = pairs.join(nodes.select("node", F.col("sig").alias("own")), "node")
    met = met.join(nodes.select(F.col("node").alias("lead"), F.col("sig").alias("other")), "lead").select("node", "lead", "own", "other")
    return met.mapInArrow(kernel, NODE_PAIR)


def alike_matrix(sigs: list[bytes], alike: float) -> np.ndarray:
    """Boolean matrix of pairs of signatures whose share of equal values is ``alike`` at least."""
    S = np.frombuffer(b"".join(sigs), "<u2").reshape(len(sigs), -1)
    return np.stack([(S == row).mean(1) >= alike for row in S])


def _ties_at(
    matched: DataFrame, nodes: DataFrame, depth: int, roots: DataFrame | None, alike: float, reach: float, block_rows: int = 1024
) -> tuple[DataFrame | None, DataFrame | None]:
    """What the prefixes of ``depth`` values bring: estimated pairs (node, leader), and further ties (a, b) of
    members that a leader couldn't judge. ``roots (node, root)`` are the groups tied so far: only members of
    different ones meet."""
    prefix = F.expr(f"substring(path, 1, {VALUE * depth})").alias("key")
    entries = matched.where(F.col("depth") >= depth).select("trie", prefix, "node")
    if roots is None:
        entries = entries.withColumn("root", F.col("node"))
    else:
        entries = cut(entries.join(roots, "node", "left").withColumn("root", F.least(F.coalesce("root", "node"), "node")))
    first = F.min(F.struct("node", "root")).alias("first")
    lead = entries.groupBy("trie", "key").agg(first, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    lead = cut(lead.select("trie", "key", F.col("first.node").alias("lead"), F.col("first.root").alias("lead_root")))
    met = entries.join(lead, ["trie", "key"]).where("node != lead")
    met = cut(met.select("trie", "key", "node", "lead", (F.col("root") != F.col("lead_root")).alias("apart")))
    apart = met.where("apart")
    if apart.isEmpty():
        return None, None
    pairs = cut(estimated(apart.select("node", "lead").distinct(), nodes))
    if pairs.where(F.col("similarity") < alike).isEmpty():
        return pairs, None  # no leader has met a stranger
    marked = cut(met.drop("apart").join(pairs, ["node", "lead"], "left"))
    strange = marked.where(F.col("similarity") < alike).select("trie", "key").distinct()
    # a member alike enough that nobody similar to it can be a stranger to the leader has met all it needs to
    left = marked.where(F.col("similarity").isNull() | (F.col("similarity") < reach)).join(strange, ["trie", "key"], "left_semi").select("trie", "key", "node")
    left = cut(left.withColumn("grp", F.concat(F.col("trie").cast("string").cast("binary"), F.lit(":").cast("binary"), "key")))
    # groups of the same members, as small ones are in many tries, are looked at once
    members = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("node").cast("decimal(20,0)")), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")))
    once = left.groupBy("grp").agg(members.alias("who")).where("who.col1 > 1").groupBy("who").agg(F.min("grp").alias("grp"))
    left = cut(left.join(once.select("grp"), "grp").select("node", "grp", F.lit(1).alias("weight"), F.lit(1).alias("size")))
    if left.isEmpty():
        return pairs, None
    tiles = link_tiles(left, nodes.select("node", F.col("sig").alias("payload")), lambda p: alike_matrix(p, alike), block_rows, block_rows)
    return pairs, cut(tiles.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a != b").distinct())


def forest_ties(nodes: DataFrame, similarity: float, tries: int, max_depth: int, target: float, found: dict | None = None) -> DataFrame:
    """``(a, b)``: nodes of ``nodes (node, sig)`` tied to leaders they are alike with (a tie may come twice), so that similar ones
    share a component with probability ``target`` at least. ``found`` gets the depth reached and the recall reckoned."""
    least = least_depth(similarity, tries, max_depth, target)
    noise = 3 * (0.25 / (tries * max_depth)) ** 0.5  # of an estimate, three standard deviations
    alike = max(noise, similarity - 0.3)
    reach = alike + (1 - similarity) + 2 * noise  # by the triangle inequality of Jaccard distances
    matched = cut(matched_paths(nodes, tries, max_depth, least))
    pairs = ties = None
    roots, depth = None, max_depth
    while True:
        more, others = _ties_at(matched, nodes, depth, roots, alike, reach)
        release(nodes.sparkSession)
        pairs = pairs.unionByName(more) if pairs is not None and more is not None else pairs if more is None else more
        ties = ties.unionByName(others) if ties is not None and others is not None else ties if others is None else others
        reckoned = _recall(pairs, similarity, tries, depth, least)
        if found is not None:
            found.update(depth=depth, recall=reckoned[depth])
        if reckoned[depth] >= target or depth == least:
            break
        # the longest prefix that is reckoned to reach the target; lengths between would only cost jobs
        depth = max((d for d in reckoned if reckoned[d] >= target), default=least)
        if pairs is not None:
            # the smallest node tied to stands for the group: near copies nearly all share it, and where two
            # members don't, they only meet once more than needed
            roots = _tied(pairs, ties, alike).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    if pairs is None:
        return nodes.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b"))
    return _tied(pairs, ties, alike)


def _recall(pairs: DataFrame | None, similarity: float, tries: int, depth: int, least: int) -> dict[int, float]:
    """The share of all links that is found at each depth from ``depth`` to ``least``, by the links found at ``depth``."""
    depths = range(depth, least - 1, -1)
    sums = [0.0] * len(depths)
    stands_for = 0.0
    if pairs is not None:
        chance = {d: 1 - F.pow(1 - F.pow(F.least(F.lit(1.0), "similarity"), F.lit(d)), F.lit(tries)) for d in depths}
        total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
        links = pairs.where(F.col("similarity") >= similarity)
        stands_for, *sums = links.agg(total(1 / chance[depth]), *[total(chance[d] / chance[depth]) for d in depths]).first()
    return {d: (found + meeting(similarity, d, tries)) / (stands_for + 1) for d, found in zip(depths, sums)}


def _tied(pairs: DataFrame, ties: DataFrame | None, alike: float) -> DataFrame:
    led = pairs.where(F.col("similarity") >= alike).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    return led if ties is None else led.unionByName(ties)
