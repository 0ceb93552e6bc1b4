"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Each task encodes the documents of its input split and keeps a pool of about
``pool_tokens`` tokens. Runs of ``max_len`` ids of long documents fill a
sequence of their own; all shorter pieces of the pool are taken by descending
length, and each goes to the sequence of lowest estimated cost among those
with room for it. The cost of a sequence is the sum over its pieces of
``linear * n + quadratic * n * n``, as attention stays inside a document. A
piece that fits nowhere is cut: its head fills the cheapest sequence with any
room, and its tail is dealt as a shorter piece. A pool opens only as many
sequences as its tokens fill completely and hands the rest to the next pool,
so only the last sequence of a task carries padding (under ``max_len`` ids).

No shuffle: texts never move, memory is one pool and one Arrow batch, and a
task that is run again on the same split gives the same rows. A different
split of the input gives another packing, equally full.

Null text counts as empty and yields the single end id. Repeated rows are
packed each time they occur. Null ids are carried. An empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nearfield.llm.common import per_process, slices


class Encoder:
    """The byte-level BPE of a rank file; ``specials`` are recognised in texts.

    Its splitting pattern has no room for blanks by the hundred thousand in one
    run; such a text goes through the tokenizer file of the same vocabulary.
    """

    def __init__(self, ranks_path: str, specials: tuple[tuple[str, int], ...], tokenizer_path: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding(
            "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(specials)
        )
        self.allowed = {s for s, _ in specials}
        self.tokenizer_path = tokenizer_path

    def encode(self, text: str) -> list[int]:
        try:
            return self.ranks.encode(text, allowed_special=self.allowed)
        except ValueError:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(self.tokenizer_path)
            own.no_truncation()
            own.no_padding()
            return own.encode(text, add_special_tokens=False).ids


def sequence_cost(lengths, linear: float, quadratic: float):
    """Estimated cost of pieces: a linear and a quadratic (attention) share."""
    n = np.asarray(lengths, dtype=np.float64)
    return linear * n + quadratic * n * n


def assign_pool(
    lengths: list[int], sequences: int, max_len: int, linear: float = 1.0, quadratic: float = 1.0
) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Deal pieces of one pool by descending length to ``sequences`` sequences.

    Returns placed parts ``(piece, start in piece, length, sequence, offset)``
    and parts that found no room ``(piece, start in piece, length)``. Equal
    lengths keep their input order; equal costs go to the smaller sequence.
    """
    room = np.full(sequences, max_len, dtype=np.int64)
    cost = np.zeros(sequences)
    queue = [(-n, i, 0) for i, n in enumerate(lengths)]
    heapq.heapify(queue)
    placed = []
    while queue:
        neg, piece, start = queue[0]
        length = -neg
        fits = room >= length
        if not fits.any():
            fits = room > 0
            if not fits.any():
                break
        heapq.heappop(queue)
        to = int(np.argmin(np.where(fits, cost, np.inf)))
        n = min(length, int(room[to]))
        placed.append((piece, start, n, to, max_len - int(room[to])))
        room[to] -= n
        cost[to] += linear * n + quadratic * n * n
        if n < length:
            heapq.heappush(queue, (n - length, piece, start + n))
    return placed, [(piece, start, -neg) for neg, piece, start in sorted(queue)]


def pack(
    docs: DataFrame,
    ranks_path: str | None = None,
    tokenizer_path: str | None = None,
    specials: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),),
    end_id: int = 0,
    max_len: int = 1024,
    pool_tokens: int = 1 << 20,
    linear: float = 1.0,
    quadratic: float = 1.0 / 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, ``start`` in its document, ``ids`` (binary, little-endian
    unsigned 32-bit), ``length``, ``doc_tokens`` (with the end id), ``sequence_id``,
    ``offset`` in the sequence.
    """
    if max_len < 1:
        raise ValueError("max_len must be positive")
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    whole_path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    pool_tokens = max(pool_tokens, max_len)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_arrow = to_arrow_type(src.schema["id"].dataType)
    out_schema = pa.schema(
        [("id", id_arrow), ("start", pa.int64()), ("ids", pa.binary()), ("length", pa.int64()),
         ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    )

    def kernel(batches):
        enc = per_process(("packing", path, specials, whole_path), lambda: Encoder(path, specials, whole_path))
        base = TaskContext.get().partitionId() << 40
        used = 0
        pool, pooled = [], 0  # pieces (id, start, ids, doc_tokens) shorter than max_len

        def emit(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out_schema)], schema=out_schema)

        def deal(last: bool):
            nonlocal used, pool, pooled
            sequences = -(-pooled // max_len) if last else pooled // max_len
            placed, left = assign_pool([len(p[2]) for p in pool], sequences, max_len, linear, quadratic)
            rows = [
                (pool[i][0], pool[i][1] + at, pool[i][2][at : at + n].tobytes(), n, pool[i][3], base + used + s, off)
                for i, at, n, s, off in placed
            ]
            used += sequences
            pool = [(pool[i][0], pool[i][1] + at, pool[i][2][at : at + n], pool[i][3]) for i, at, n in left]
            pooled = sum(n for _, _, n in left)
            return emit(rows)

        for batch in batches:
            for keys, texts in slices(batch, 256, ["id", "text"]):
                whole = []
                for key, text in zip(keys, texts):
                    ids = np.append(np.asarray(enc.encode(text), dtype="<u4"), np.uint32(end_id))
                    n = len(ids)
                    full = n // max_len * max_len
                    for at in range(0, full, max_len):
                        whole.append((key, at, ids[at : at + max_len].tobytes(), max_len, n, base + used, 0))
                        used += 1
                    if full < n:
                        pool.append((key, full, ids[full:], n))
                        pooled += n - full
                if whole:
                    yield emit(whole)
                if pooled >= pool_tokens:
                    yield deal(False)
        if pool:
            yield deal(True)

    id_type = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(
        kernel,
        f"id {id_type}, start bigint, ids binary, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    ).withColumnRenamed("id", id_col)
