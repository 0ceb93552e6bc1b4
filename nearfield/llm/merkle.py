"""Merkle manifest of a dataset, kept as append logs in postorder, with proofs.

Every row is a leaf, a sha256 digest of its fields. The leaves of a part (rows
of one ``part`` value) ascend by id; every run of ``arity`` consecutive nodes,
the last one shorter, is hashed into a node of the next level until one node,
the subroot, remains. The subroots, ordered by part, make a tree of their own,
whose last node is the root.

Rows get their place in the part from a range partitioning and the counts of
its partitions, so no part passes through one task. Aligned builders (runs of
``arity ** levels`` leaves, dealt over the tasks) append each node to their log
when it is complete: a leaf on arrival, a parent right after its last child.
A builder's log is one row of bytes, its segment; the segments' last nodes are
the leaves of the next, ``arity ** levels`` times smaller round. What stands
before a node in the log is known from the sizes of complete subtrees alone
(``postorder``), so a proof reads its siblings at computed positions; a round's
segments hand the proof of their last node down to the round below. A proof is
the siblings' digests, from the leaf's run to the root; ``fold`` recomputes the
root from a leaf, its place and its proof.

A null field counts as such, not as empty; empty and very long texts are hashed
whole. Null ids come first in their part, the null part comes first. Rows that
repeat an id are ordered by their digests, and rows repeated in full are leaves
of their own with interchangeable places. An empty table has no root and gives
an empty result. Other columns are ignored unless they are among the fields.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from nearfield.llm.common import cut, slices

DIGEST = 32


def leaf_digest(*fields):
    """Column: sha256 of the fields, each ``-`` if null, else UTF-8 byte count, ``:`` and value."""
    texts = [F.col(f).cast("string") if isinstance(f, str) else f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def node_digest(run: bytes) -> bytes:
    """The parent of a run of concatenated digests: sha256 of their lowercase hex text."""
    return hashlib.sha256(run.hex().encode()).digest()


def level_sizes(n: int, arity: int) -> list[int]:
    """Nodes of each level of a tree over ``n`` leaves, leaves first."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // arity))
    return sizes


def postorder(level: int, index: int, n: int, arity: int) -> int:
    """Position of a node in the log of a tree over ``n`` leaves: all nodes that end
    before its first leaf, then its own subtree, of which it is the last."""
    span = arity**level
    first, last = index * span, min((index + 1) * span, n)
    before, width = 0, 1
    while width <= first:
        before += first // width
        width *= arity
    subtree = sum(-(-(last - first) // arity**j) for j in range(level + 1))
    return before + subtree - 1


def append_log(leaves: list[bytes], levels: int, arity: int) -> bytes:
    """The nodes up to ``levels`` above the leaves, each appended when it is complete."""
    log, waiting = [], [[] for _ in range(levels + 1)]

    def append(level: int, digest: bytes) -> None:
        log.append(digest)
        if level < levels:
            waiting[level].append(digest)
            if len(waiting[level]) == arity:
                close(level)

    def close(level: int) -> None:
        run, waiting[level] = b"".join(waiting[level]), []
        append(level + 1, node_digest(run))

    for leaf in leaves:
        append(0, leaf)
    for level in range(levels):
        if waiting[level]:
            close(level)
    return b"".join(log)


def segment_proofs(nodes: bytes, m: int, levels: int, arity: int, above: bytes) -> list[bytes]:
    """Per leaf of a segment of ``m`` leaves its siblings inside it, level by level, then those ``above`` its last node."""
    sizes = [m]
    for _ in range(levels):
        sizes.append(-(-sizes[-1] // arity))
    below = [above]
    for level in range(levels - 1, -1, -1):
        at = [DIGEST * postorder(level, i, m, arity) for i in range(sizes[level])]
        now = []
        for first in range(0, sizes[level], arity):
            run = b"".join(nodes[p : p + DIGEST] for p in at[first : first + arity])
            rest = below[first // arity]
            now += [run[:k] + run[k + DIGEST :] + rest for k in range(0, len(run), DIGEST)]
        below = now
    return below


def fold(digest: bytes, siblings: bytes, index: int, n: int, arity: int) -> tuple[bytes, bytes]:
    """The last node of a tree over ``n`` leaves recomputed from one leaf, and the siblings that were not used."""
    at = 0
    while n > 1:
        first = index // arity * arity
        take = DIGEST * (min(arity, n - first) - 1)
        run, k = siblings[at : at + take], DIGEST * (index - first)
        digest = node_digest(run[:k] + digest + run[k:])
        at, index, n = at + take, index // arity, -(-n // arity)
    return digest, siblings[at:]


@dataclass
class Manifest:
    """``rounds``: the written segments, ``key, part, n, leaves, builder, m, nodes, ids, carried`` (``n``: nodes
    that the round starts from in the part, ``m``: in the segment); ``parts``: ``key, part, n, subroot, place,
    parts, above`` (proof of the subroot); ``root``: None without rows."""

    rounds: list[DataFrame]
    parts: DataFrame
    root: bytes | None
    arity: int
    levels: int


def build(
    rows: DataFrame,
    leaf_col: str = "leaf",
    part_col: str = "lang",
    id_col: str = "doc_id",
    carry: str | None = None,
    arity: int = 8,
    levels: int = 3,
) -> Manifest:
    """Logs, subroots and root of ``rows``: one leaf (32 bytes) per row. ``carry`` names a binary
    column that travels with the leaf into its proof. A builder holds ``arity ** levels`` leaves."""
    part = F.col(part_col)
    carried = F.lit(None).cast("binary") if carry is None else F.col(carry)
    # null parts are told from empty ones by the key, which is never null and keeps their order
    key = F.coalesce(F.concat(F.lit("="), part.cast("string")), F.lit("")).alias("key")
    leaves = rows.select(key, part.alias("part"), F.col(id_col).alias("id"), F.col(leaf_col).alias("digest"), carried.alias("carried"))
    ranked, longest = _ranked(leaves)
    rounds = _rounds(ranked, longest, arity, levels)
    top = F.expr(f"substring(nodes, -{DIGEST}, {DIGEST})")
    last = [s.where(F.col("n") <= arity**levels).select("key", "part", "leaves", top.alias("digest")) for s in rounds]
    subroots = last[0]
    for more in last[1:]:
        subroots = subroots.unionByName(more)
    subroots = cut(subroots)
    counted = F.col("leaves").alias("n"), F.col("digest").alias("subroot")
    if subroots.isEmpty():
        zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("binary")
        parts = subroots.select("key", "part", *counted, zero.alias("place"), zero.alias("parts"), none.alias("above"))
        return Manifest(rounds, parts, None, arity, levels)
    # the tree over the parts is built and read in the same way, as one part of its own
    listed, n_parts = _ranked(
        subroots.select(F.lit("").alias("key"), F.lit("").alias("part"), F.col("key").alias("id"), "digest", F.lit(None).cast("binary").alias("carried"))
    )
    above = _rounds(listed, n_parts, arity, levels)
    root = above[-1].select(top).first()[0]
    nothing = F.lit(None).cast("binary").alias("subroot"), F.lit(0).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("parts")
    proofs = _proofs(above, above[-1].select("key", F.lit(bytearray()).alias("siblings"), *nothing), arity, levels).select(
        F.col("id").alias("key"), F.col("index").alias("place"), F.col("siblings").alias("above")
    )
    parts = cut(
        subroots.join(proofs, "key").select(
            "key", "part", *counted, "place", F.lit(n_parts).cast("bigint").alias("parts"), "above"
        )
    )
    return Manifest(rounds, parts, bytes(root), arity, levels)


def _ranked(leaves: DataFrame) -> tuple[DataFrame, int]:
    """Each leaf with its ``index`` in its part and the part's size ``n``, and the largest size."""
    order = ["key", "id", "digest", "carried", "tag"]
    # rows equal in all else are dealt by a tag, so that no group of copies falls to one task
    tagged = cut(leaves.withColumn("tag", F.monotonically_increasing_id()))
    laid = cut(tagged.repartitionByRange(*order).sortWithinPartitions(*order).drop("tag").withColumn("at", F.monotonically_increasing_id()))
    laid = laid.withColumn("task", F.shiftright("at", 33))  # the upper bits of the number are its partition's
    runs = laid.groupBy("key", "task").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("rows"))
    by_key = Window.partitionBy("key")
    upto = by_key.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut(
        runs.select(
            "key", "task", "low", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("before"), F.sum("rows").over(by_key).alias("n")
        )
    )
    longest = runs.agg(F.max("n")).first()[0] or 0
    ranked = laid.join(runs, ["key", "task"]).withColumn("index", F.col("at") - F.col("low") + F.col("before"))
    return ranked.select("key", "part", "id", "digest", "carried", "index", "n"), longest


def _rounds(ranked: DataFrame, longest: int, arity: int, levels: int) -> list[DataFrame]:
    """The written segments of all rounds; ``n`` is the part's size in the round, ``leaves`` in the first one."""
    span = arity**levels
    out = [cut(_segments(ranked.withColumn("leaves", F.col("n")), arity, levels))]
    while longest > span:
        longest = -(-longest // span)
        up = out[-1].where(F.col("n") > span).select(
            "key", "part", F.lit(None).cast(ranked.schema["id"].dataType).alias("id"),
            F.expr(f"substring(nodes, -{DIGEST}, {DIGEST})").alias("digest"), F.lit(None).cast("binary").alias("carried"),
            F.col("builder").alias("index"), F.ceil(F.col("n") / span).alias("n"), "leaves",
        )
        out.append(cut(_segments(up, arity, levels)))
    return out


def _segments(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """One row per builder: its log, and the ids and carried values of its leaves."""
    span = arity**levels
    part_type, id_type = nodes.schema["part"].dataType, nodes.schema["id"].dataType
    dealt = nodes.withColumn("builder", F.floor(F.col("index") / span)).repartition("key", "builder").sortWithinPartitions("key", "builder", "index")
    schema = pa.schema([
        ("key", pa.string()), ("part", to_arrow_type(part_type)), ("n", pa.int64()), ("leaves", pa.int64()), ("builder", pa.int64()),
        ("m", pa.int64()), ("nodes", pa.binary()), ("ids", pa.list_(to_arrow_type(id_type))), ("carried", pa.list_(pa.binary())),
    ])

    def segment(head, members):
        key, part, n, leaves, builder = head
        digests, ids, carried = zip(*members)
        nodes = append_log(digests, min(levels, len(level_sizes(n, arity)) - 1), arity)
        values = (key, part, n, leaves, builder, len(members), nodes, list(ids), list(carried))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    def kernel(batches):
        head, members = None, []
        for batch in batches:
            for cols in slices(batch, 4096, ["key", "part", "n", "leaves", "builder", "digest", "id", "carried"]):
                for *now, digest, id_, carried in zip(*cols):
                    if head is None or now[0] != head[0] or now[4] != head[4]:
                        if members:
                            yield segment(head, members)
                        head, members = now, []
                    members.append((digest, id_, carried))
        if members:
            yield segment(head, members)

    return dealt.mapInArrow(
        kernel,
        f"key string, part {part_type.simpleString()}, n bigint, leaves bigint, builder bigint, m bigint, nodes binary, "
        f"ids array<{id_type.simpleString()}>, carried array<binary>",
    )


def log(manifest: Manifest) -> DataFrame:
    """Every node of every part's tree: ``part, position, level, index, digest``; ``position`` counts in completion order."""
    m, span = manifest, manifest.arity**manifest.levels
    out = None
    for number, segments in enumerate(m.rounds):
        part_type = segments.schema["part"].dataType
        schema = pa.schema([
            ("part", to_arrow_type(part_type)), ("position", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.binary()),
        ])

        def kernel(batches, number=number, schema=schema, arity=m.arity, levels=m.levels):
            for batch in batches:
                for cols in slices(batch, 64, ["part", "n", "leaves", "builder", "m", "nodes"]):
                    for part, n, leaves, builder, size, nodes in zip(*cols):
                        rows = []
                        for level in range(min(levels, len(level_sizes(n, arity)) - 1) + 1):
                            if level == 0 and number:
                                continue  # these stand in the log already, as last nodes of the round below
                            width = arity ** (levels - level)
                            for i in range(-(-size // arity**level)):
                                at = DIGEST * postorder(level, i, size, arity)
                                index, over = builder * width + i, number * levels + level
                                rows.append((part, postorder(over, index, leaves, arity), over, index, nodes[at : at + DIGEST]))
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        rows = segments.select("part", "n", "leaves", "builder", "m", "nodes").mapInArrow(
            kernel, f"part {part_type.simpleString()}, position bigint, level int, index bigint, digest binary"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: ``part, id, leaf, carried, index, n, subroot, place, parts, siblings`` (its proof)."""
    m = manifest
    return _proofs(m.rounds, m.parts.select("key", "subroot", "place", "parts", F.col("above").alias("siblings")), m.arity, m.levels).select(
        "part", "id", "leaf", "carried", "index", F.col("leaves").alias("n"), "subroot", "place", "parts", "siblings"
    )


#: What a proof says of its part, handed down with the siblings, so that no leaf is shuffled by its part.
OF_PART = ["subroot", "place", "parts"]


def _proofs(rounds: list[DataFrame], top: DataFrame, arity: int, levels: int) -> DataFrame:
    """Proofs of the first round's leaves; ``top`` has those of the parts' last nodes, ``(key, siblings)`` and ``OF_PART``."""
    span = arity**levels
    top = top.select("key", F.lit(0).cast("bigint").alias("builder"), "siblings", *OF_PART, F.lit(True).alias("last"))
    above = top
    for segments in reversed(rounds):
        # a part's last segment gets what stands above the part, any other its last node's proof from the round above
        handed = _extract(segments.withColumn("last", F.col("n") <= span).join(above, ["key", "builder", "last"]), arity, levels)
        above = top.unionByName(handed.select("key", F.col("index").alias("builder"), "siblings", *OF_PART, F.lit(False).alias("last")))
    return handed


def _extract(met: DataFrame, arity: int, levels: int) -> DataFrame:
    span = arity**levels
    part_type, id_type = met.schema["part"].dataType, met.schema["ids"].dataType.elementType
    schema = pa.schema([
        ("key", pa.string()), ("part", to_arrow_type(part_type)), ("leaves", pa.int64()), ("index", pa.int64()), ("id", to_arrow_type(id_type)),
        ("leaf", pa.binary()), ("carried", pa.binary()), ("siblings", pa.binary()), ("subroot", pa.binary()), ("place", pa.int64()),
        ("parts", pa.int64()),
    ])
    taken = ["key", "part", "leaves", *OF_PART, "n", "builder", "m", "nodes", "ids", "carried", "siblings"]

    def kernel(batches):
        for batch in batches:
            for cols in slices(batch, 16, taken):
                for key, part, leaves, subroot, place, parts, n, builder, m, nodes, ids, carried, above in zip(*cols):
                    own = segment_proofs(nodes, m, min(levels, len(level_sizes(n, arity)) - 1), arity, above)
                    at = [DIGEST * postorder(0, i, m, arity) for i in range(m)]
                    digests = [nodes[p : p + DIGEST] for p in at]
                    columns = ([key] * m, [part] * m, [leaves] * m, range(builder * span, builder * span + m), ids, digests, carried, own,
                               [subroot] * m, [place] * m, [parts] * m)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return met.select(taken).mapInArrow(
        kernel,
        f"key string, part {part_type.simpleString()}, leaves bigint, index bigint, id {id_type.simpleString()}, leaf binary, carried binary, "
        "siblings binary, subroot binary, place bigint, parts bigint",
    )


def verify(proofs: DataFrame, leaf_col: str = "leaf", arity: int = 8) -> DataFrame:
    """``proofs`` with ``folded_root``: the root recomputed from ``leaf_col``, the leaf's place and its proof. A row
    equals the one that the manifest was built from if this is the manifest's root."""
    names = proofs.columns
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in proofs.schema.fields] + [("folded_root", pa.binary())])

    def kernel(batches):
        for batch in batches:
            folded = []
            for cols in slices(batch, 1024, [leaf_col, "siblings", "index", "n", "place", "parts"]):
                for leaf, siblings, index, n, place, parts in zip(*cols):
                    subroot, rest = fold(leaf, siblings, index, n, arity)
                    folded.append(fold(subroot, rest, place, parts, arity)[0])
            columns = [batch.column(batch.schema.get_field_index(c)).cast(schema.field(c).type) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(folded, pa.binary())], schema=schema)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema.fields)
    return proofs.mapInArrow(kernel, f"{kinds}, folded_root binary")
