"""Embedding near-duplicates by E8 lattice hashing.

Equal vectors form one node. In each of ``tables`` tables a node's direction is
projected onto ``blocks`` random orthonormal 8-dimensional spaces, scaled and
shifted, and each is decoded to the nearest point of the E8 lattice; the points
together are the node's cell. A node is compared with the nodes of its own
cells and of ``probes`` neighbouring cells per table: those reached through the
minimal vectors of the lattice that lie nearest to where the projection fell.
Every candidate is verified by its cosine in double precision.

Candidates of ordinary cells are written as pairs once and verified by a join
with the vectors. A cell that more than ``hot_cell`` nodes lie in or probe is
never paired. Each of its nodes is verified against the smallest one; where that
links all, as with near copies, the cell is done. In any other hot cell the nodes
meet each other in tiles (see ``tiles``). Only links found so, never a shared cell
alone, tie nodes into groups, and all pairs of a group are then compared in tiles
once more, to count links. So near copies that make up a third of all rows
neither overfill a task nor lose a link, and vectors that merely lie close chain
into no group.

``cell`` is the scale of the lattice for unit vectors of 64 dimensions (other
dimensions are scaled alike). How many unrelated nodes one meets in a cell depends
on the vectors: embeddings often share a mean direction, or topics. So ``blocks`` and
``cell`` are by default those of least work (``fitted_scale``): on a sample of at
most ``sample_nodes`` nodes, without links among them, the meetings in a table are
counted for a row of scales and carried on to all nodes. ``tables`` follows from the
wanted ``recall``: the chance that a pair right at the threshold meets in one table
is measured on random pairs, and nearer pairs meet more often.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing and are kept. Vectors of different length do not link. Repeated
rows count as linked to each other; null ids rank above all others. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations, product
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nearfield.llm.common import cut, per_process, slices
from nearfield.llm.components import components
from nearfield.llm.tiles import link_tiles


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for (i, j), (a, b) in product(combinations(range(8), 2), product((1.0, -1.0), repeat=2)):
        v = np.zeros(8)
        v[[i, j]] = a, b
        out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: where rounding leaves it odd, the worst entry goes the other way."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    rows = np.flatnonzero(near.sum(1) % 2 != 0)
    near[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: the better of D8 and D8 shifted by one half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


class Lattice:
    """Cells and neighbouring cells of directions of one dimension."""

    def __init__(self, dim: int, tables: int, blocks: int, probes: int, cell: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        width = 8 * blocks
        self.dim, self.blocks, self.probes = dim, blocks, probes
        self.minimal = minimal_vectors()
        self.bases, self.shifts = [], []
        for _ in range(tables):
            raw = rng.normal(size=(dim, width))
            basis = np.linalg.qr(raw)[0] if dim >= width else raw / np.sqrt(dim)
            self.bases.append(basis * (np.sqrt(dim / 64) / cell))
            self.shifts.append(rng.uniform(0, 1, width))
        self.mixer = rng.integers(0, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _key(self, table: int, points: np.ndarray) -> np.ndarray:
        key = np.rint(2 * points).astype(np.int64).view(np.uint64) @ self.mixer
        key = (key ^ np.uint64(self.dim * 1009 + table)) * np.uint64(0x9E3779B97F4A7C15)
        return (key ^ (key >> np.uint64(32))).view(np.int64)

    def cells(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per unit vector its cell in each table, and the cells to probe besides."""
        own, near = [], []
        rows = np.arange(len(units))[:, None]
        for t, (basis, shift) in enumerate(zip(self.bases, self.shifts)):
            x = units @ basis + shift
            points = np.concatenate([nearest_e8(x[:, 8 * b : 8 * b + 8]) for b in range(self.blocks)], axis=1)
            own.append(self._key(t, points))
            # squared distance to a neighbour's centre, less the distance to the own one: 2 - 2 <residual, minimal vector>
            gains = np.concatenate([(x - points)[:, 8 * b : 8 * b + 8] @ self.minimal.T for b in range(self.blocks)], axis=1)
            best = np.argpartition(-gains, self.probes - 1, axis=1)[:, : self.probes] if self.probes else np.zeros((len(x), 0), int)
            for p in range(self.probes):
                moved = points.copy()
                at = 8 * (best[:, p] // 240)
                moved[rows, at[:, None] + np.arange(8)] += self.minimal[best[:, p] % 240]
                near.append(self._key(t, moved))
        return np.stack(own, axis=1), np.stack(near, axis=1) if near else np.zeros((len(units), 0), np.int64)


def meeting_probability(dim: int, threshold: float, blocks: int, probes: int, cell: float, seed: int, pairs: int = 2000) -> float:
    """The share of random pairs at cosine ``threshold`` that meet in one table, over eight tables."""
    rng = np.random.default_rng([seed, dim, 1])
    a, b = rng.normal(size=(2, pairs, max(dim, 2)))
    a /= np.sqrt((a * a).sum(1))[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * b / np.sqrt((b * b).sum(1))[:, None]
    lattice = Lattice(max(dim, 2), 8, blocks, probes, cell, seed)
    (own_a, near_a), (own_b, near_b) = lattice.cells(a), lattice.cells(b)
    near_a, near_b = near_a.reshape(pairs, 8, probes), near_b.reshape(pairs, 8, probes)
    met = (own_a == own_b) | (near_a == own_b[:, :, None]).any(2) | (near_b == own_a[:, :, None]).any(2)
    return float(met.mean())


#: Relative work of a candidate pair (two vectors moved and compared) and of a key of a node.
PAIR_WORK, KEY_WORK = 10.0, 1.0
CELLS = (0.5, 0.42, 0.35, 0.3, 0.25, 0.21, 0.18)


def meetings(units: np.ndarray, lattice: Lattice) -> int:
    """Pairs of the vectors that meet in a table, over all tables."""
    own, near = lattice.cells(units)
    total = 0
    for t in range(own.shape[1]):
        keys, counts = np.unique(own[:, t], return_counts=True)
        total += int((counts * (counts - 1) // 2).sum())
        asked = near[:, t * lattice.probes : (t + 1) * lattice.probes].ravel()
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        total += int(counts[at][keys[at] == asked].sum())
    return total


def fitted_scale(units: np.ndarray, n: int, threshold: float, recall: float, probes: int, seed: int, blocks_tried=(2, 3, 4)) -> tuple[int, float, int]:
    """``(blocks, cell, tables)`` of least work for ``n`` nodes like the ``units`` (rows of length one)."""
    dim = units.shape[1]
    close = units @ units.T >= threshold
    units = units[~np.tril(close, -1).any(1)]  # unrelated ones only: what is linked should meet
    pairs = max(1, len(units) * (len(units) - 1) // 2)
    best = None
    for blocks in blocks_tried:
        share = 1.0
        for i, cell in enumerate(CELLS):
            lattice = Lattice(dim, 4, blocks, probes, cell, seed)
            met = meetings(units, lattice)
            # too few to count: they fall with a cell's volume at least as fast as between the last two scales
            shrunk = share * (cell / CELLS[max(0, i - 1)]) ** (8 * blocks)
            share = met / (4 * pairs) if met >= 10 else min(share, max(shrunk, met / (4 * pairs)))
            p = meeting_probability(dim, threshold, blocks, probes, cell, seed, pairs=500)
            tables = max(1, ceil(log(1 - recall) / log(1 - min(max(p, 1e-6), 0.999))))
            work = tables * ((1 + probes) * KEY_WORK + share * n * PAIR_WORK)
            if best is None or work < best[0]:
                best = (work, blocks, cell, tables)
            if tables * (1 + probes) * KEY_WORK > best[0]:
                break  # smaller cells only need more tables
    return best[1:]


def cosines(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Row-wise cosine in double precision of float vectors (pairs of equal length)."""
    out = np.empty(len(a))
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = _unit(x), _unit(y)
        out[i] = x @ y if len(x) == len(y) else -1.0
    return out


def _unit(raw: bytes) -> np.ndarray:
    v = np.frombuffer(raw, "<f8")
    v = v / np.abs(v).max()  # so that squares neither overflow nor vanish
    return v / np.sqrt(v @ v)


def link_embeddings(
    vectors: DataFrame,
    threshold: float = 0.9,
    tables: int | None = None,
    blocks: int | None = None,
    probes: int = 4,
    cell: float | None = None,
    recall: float = 0.96,
    hot_cell: int = 128,
    sample_nodes: int = 2048,
    block_rows: int = 1024,
    seed: int = 8,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` (smallest id reachable), ``kept``."""
    src = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    id_type = src.schema["id"].dataType
    id_name = id_type.simpleString()
    noted = pa.schema([("id", to_arrow_type(id_type)), ("node", pa.binary()), ("payload", pa.binary())])

    def note(batches):
        for batch in batches:
            for ids, vs in slices(batch, 2048, ["id", "v"]):
                nodes, payloads = [], []
                for v in vs:
                    x = np.array([np.nan if c is None else c for c in v or ()], dtype="<f8") + 0.0
                    valid = len(x) > 0 and np.isfinite(x).all() and x.any()
                    payloads.append(x.tobytes() if valid else None)
                    nodes.append(hashlib.blake2b(payloads[-1], digest_size=16).digest() if valid else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, noted[0].type), pa.array(nodes, pa.binary()), pa.array(payloads, pa.binary())], schema=noted)

    rows = cut(src.mapInArrow(note, f"id {id_name}, node binary, payload binary"))
    nodes = cut(rows.where("node is not null").groupBy("node").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("n")))
    n, dim = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("payload")), F.lit(8)) / 8).first()
    if cell is None and blocks is None and tables is None and n:
        rate = min(1.0, 1.25 * sample_nodes / n)
        some = nodes.where((F.octet_length("payload") == int(dim) * 8) & (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(rate * (1 << 30))))
        sample = [_unit(bytes(r.payload)) for r in some.select("payload").limit(sample_nodes).collect()]
        if len(sample) >= 64 and dim >= 2:
            blocks, cell, tables = fitted_scale(np.stack(sample), n, threshold, recall, probes, seed)
    blocks = blocks or 2
    if cell is None:
        cell = min(0.5, 0.25 * (50_000 / max(1, n)) ** (1 / (8 * blocks)))
    if tables is None:
        met = meeting_probability(int(dim), threshold, blocks, probes, cell, seed)
        tables = max(1, ceil(log(1 - recall) / log(1 - min(met, 0.999))))
    keyed = pa.schema([("node", pa.binary()), ("own", pa.list_(pa.int64())), ("near", pa.list_(pa.int64()))])

    def hash_cells(batches):
        for batch in batches:
            for ids, payloads in slices(batch, 1024, ["node", "payload"]):
                by_dim: dict[int, list[int]] = {}
                for i, p in enumerate(payloads):
                    by_dim.setdefault(len(p) // 8, []).append(i)
                for dim, which in by_dim.items():
                    args = (dim, tables, blocks, probes, cell, seed)
                    lattice = per_process(("lattice", *args), lambda: Lattice(*args))
                    own, near = lattice.cells(np.stack([_unit(payloads[i]) for i in which]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i] for i in which], pa.binary()), pa.array(own.tolist(), keyed[1].type),
                         pa.array(near.tolist(), keyed[2].type)], schema=keyed)

    cells = cut(nodes.select("node", "payload").mapInArrow(hash_cells, "node binary, own array<bigint>, near array<bigint>"))
    index = cells.select("node", F.explode("own").alias("key"))
    near = cells.select("node", F.explode("near").alias("key"))
    # cells with company: at least one node in it, and another in it or probing it
    lying = index.groupBy("key").agg(F.count(F.lit(1)).alias("n_in"), F.min("node").alias("low"))
    near = near.join(lying.select("key", "n_in", "low"), "key")
    probing = near.groupBy("key").agg(F.count(F.lit(1)).alias("n_near"))
    busy = (
        lying.join(probing, "key", "left").withColumn("met", F.col("n_in") + F.coalesce("n_near", F.lit(0)))
        .where("met > 1").select("key", "low", (F.col("met") > hot_cell).alias("hot"))
    )
    busy = cut(busy)
    inside = index.join(busy, "key")
    outside = near.select("node", "key").join(busy, "key")
    vec_a, vec_b = (nodes.select(F.col("node").alias(c), F.col("payload").alias(f"vec_{c}"), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    checked = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64())])

    def verify(batches):
        for batch in batches:
            for a, b, n_a, n_b, x, y in slices(batch, 4096, ["a", "b", "n_a", "n_b", "vec_a", "vec_b"]):
                hit = np.flatnonzero(cosines(x, y) >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in hit], f.type) for c, f in zip((a, b, n_a, n_b), checked)], schema=checked)

    def verified(pairs):
        both = pairs.join(vec_a, "a").join(vec_b, "b").select("a", "b", "n_a", "n_b", "vec_a", "vec_b")
        return cut(both.mapInArrow(verify, "a binary, b binary, n_a bigint, n_b bigint"))

    def close(payloads):
        dims = {len(p) for p in payloads}
        if len(dims) == 1:
            units = np.stack([_unit(p) for p in payloads])
            return units @ units.T >= threshold
        units = [_unit(p) for p in payloads]
        return np.array([[len(x) == len(y) and x @ y >= threshold for y in units] for x in units])

    # hot cells: all nodes but the smallest, each verified against it
    hot = cut(inside.union(outside.select(inside.columns)).where("hot and node != low").select("key", "node", "low"))
    led = verified(cut(hot.select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())).select("a", "b")
    linked_to_low = led.select(F.col("a").alias("node"), F.col("b").alias("low"), F.lit(True).alias("linked"))
    mixed = cut(hot.join(linked_to_low, ["node", "low"], "left").where("linked is null").select("key").distinct())
    strangers = cut(hot.join(mixed, "key", "left_semi").select("node", F.col("key").alias("grp"), F.lit(1).alias("weight"), F.lit(1).alias("size")))
    met = cut(link_tiles(strangers, nodes.select("node", "payload"), close, block_rows, block_rows))
    ties = led.union(met.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a != b"))
    groups = cut(components(ties.distinct()))
    grouped = groups.select("node", F.col("component").alias("grp"))
    members = grouped.join(nodes, "node").select("node", "grp", F.col("n").alias("weight"), F.lit(1).cast("bigint").alias("size"))

    tiles = cut(link_tiles(members, nodes.select("node", "payload"), close, block_rows, block_rows))
    # pairs of ordinary cells, once each, without those that a tile compares
    in_cell = inside.where("not hot").select("key", F.col("node").alias("b"))
    asks = inside.union(outside.select(inside.columns)).where("not hot").select("key", F.col("node").alias("a"))
    pairs = asks.join(in_cell, "key").where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    group_a, group_b = (grouped.select(F.col("node").alias(c), F.col("grp").alias(f"grp_{c}")) for c in ("a", "b"))
    pairs = pairs.join(group_a, "a", "left").join(group_b, "b", "left")
    pairs = pairs.where("grp_a is null or grp_b is null or grp_a != grp_b").select("a", "b")
    linked = verified(pairs)
    counts = (
        linked.select(F.col("a").alias("node"), F.col("n_b").alias("links"))
        .union(linked.select(F.col("b").alias("node"), F.col("n_a").alias("links")))
        .union(tiles.select("node", "links"))
        .groupBy("node").agg(F.sum("links").alias("links"))
    )
    edges = linked.select("a", "b").union(tiles.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = components(edges).select("node", F.col("component").alias("class"))
    sized = nodes.select("node", "n").join(counts, "node", "left").join(classes, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("class", "node").alias("class")
    )
    valid = rows.where("node is not null").select("id", "node").join(sized, "node")
    lowest = valid.groupBy("class").agg(F.min("id").alias("component_id"))
    valid = valid.join(lowest, "class").select("id", "n_links", "component_id")
    alone = rows.where("node is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return valid.union(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
