"""NumPy kernels that run inside Spark tasks (Arrow batches in, Arrow out).

These are the only hot loops that leave the JVM: bulk squared-L2 top-k and
the hashed-token fold of the offline encoder. Spark partitions and shuffles
the work; each call sees one bounded batch or tile.

Top-k is exact. A BLAS pass (``|x|^2 - 2 q.x``) shortlists every
candidate within a safe error margin of the k-th value, the shortlist is
re-scored with the direct sum of squared differences, and ties are broken by
the smaller id, so results agree with any exact engine. Ids are integers or
strings. A vector with a non-finite element raises ``ValueError`` instead of
hiding its neighbours.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of the differences of pairs that are re-scored exactly per step.
EXACT_BLOCK_BYTES = 8 << 20
# Entries of the query x item score matrix held at once (about 16 MB).
SCORE_BLOCK = 1 << 21
# Relative error margin of the BLAS shortlist, far above float64 rounding.
REL_MARGIN = 1e-8
# Items whose least score stands for them when a query's k-th value is bounded.
GROUP_ITEMS = 64
# Texts turned into Python strings at once by the hashed-token fold.
FOLD_SLICE_ROWS = 1024


def as_list_array(col) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    return col


def to_matrix(col, dim: int | None = None, dtype=np.float64) -> np.ndarray:
    """``array<float>`` Arrow column -> matrix (rows x dim), in double precision unless told."""
    arr = as_list_array(col)
    n = len(arr)
    if n == 0:
        return np.zeros((0, dim or 0), dtype=dtype)
    if arr.null_count:
        raise ValueError("null vector in input; filter or validate first")
    lengths = pc.list_value_length(arr).to_numpy(zero_copy_only=False)
    d = int(lengths[0]) if dim is None else dim
    if (lengths != d).any():
        raise ValueError(f"vectors of mixed dimension (expected {d})")
    values = arr.flatten().to_numpy(zero_copy_only=False)
    return values.astype(dtype, copy=False).reshape(n, d)


def to_ids(col) -> np.ndarray:
    """Ids as int64, or as Python strings in an object array (code point order, as Spark's)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        raise ValueError(f"{col.null_count} null ids")
    if pa.types.is_integer(col.type):
        return col.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    out = np.empty(len(col), dtype=object)
    out[:] = col.cast(pa.string()).to_pylist()
    return out


def ranks(*ids: np.ndarray) -> list[np.ndarray]:
    """Ids as integers of the same order: themselves, or their ranks over all arrays given."""
    if all(i.dtype.kind == "i" for i in ids):
        return list(ids)
    # Python's sort: object arrays of strings
    order = {v: k for k, v in enumerate(sorted({v for i in ids for v in i.tolist()}))}
    return [np.fromiter((order[v] for v in i.tolist()), np.int64, len(i)) for i in ids]


def check_finite(M: np.ndarray, what: str) -> None:
    bad = int((~np.isfinite(M)).any(axis=1).sum())
    if bad:
        raise ValueError(f"{bad} {what} vectors hold non-finite elements; remove them or validate first")


def _exact(Q, X, rows, cols) -> np.ndarray:
    out = np.empty(len(rows), dtype=np.float64)
    step = max(1, EXACT_BLOCK_BYTES // (8 * max(1, X.shape[1])))
    for s in range(0, len(rows), step):
        e = s + step
        diff = Q[rows[s:e]]
        diff -= X[cols[s:e]]
        out[s:e] = np.einsum("ij,ij->i", diff, diff)
    return out


def _kth_bound(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row a value that at least k of its scores don't exceed (infinite, where there are fewer than k).

    The k-th least of the least values of groups of items: no smaller than the k-th score, and
    close to it, for one pass over the scores."""
    n, nx = scores.shape
    full = nx - nx % GROUP_ITEMS
    if full // GROUP_ITEMS < 4 * k:
        return np.partition(scores, k - 1, axis=1)[:, k - 1] if k < nx else np.full(n, np.inf)
    least = scores[:, :full].reshape(n, -1, GROUP_ITEMS).min(axis=2)
    return np.partition(least, k - 1, axis=1)[:, k - 1]


def topk(
    Q: np.ndarray,
    qids: np.ndarray,
    X: np.ndarray,
    xids: np.ndarray,
    k: int,
    exclude_self: bool = False,
):
    """Exact k nearest rows of ``X`` for each row of ``Q``.

    Returns ``(q_index, x_id, distance)`` arrays ordered by query, then by
    ``(distance, x_id)``; at most k rows per query. ``Q`` may be in single
    precision: it is widened a block at a time.
    """
    empty = (np.zeros(0, np.int64), xids[:0], np.zeros(0, np.float64))
    nq, nx = len(Q), len(X)
    if nq == 0 or nx == 0 or k <= 0:
        return empty
    check_finite(Q, "query")
    check_finite(X, "item")
    qrank, xrank = ranks(qids, xids)
    xn = np.einsum("ij,ij->i", X, X)
    xmax = float(xn.max())
    step = max(1, SCORE_BLOCK // nx)
    if exclude_self:
        by_id = np.argsort(xrank, kind="stable")
        sorted_ids = xrank[by_id]
    out_q, out_x, out_d = [], [], []
    for s in range(0, nq, step):
        Qc = Q[s : s + step].astype(np.float64, copy=False)
        qn = np.einsum("ij,ij->i", Qc, Qc)
        # squared distances less the query's own norm, which ranks nothing
        approx = Qc @ X.T
        approx *= -2.0
        approx += xn
        if exclude_self:
            own = qrank[s : s + step]
            first, last = (np.searchsorted(sorted_ids, own, side) for side in ("left", "right"))
            n = last - first
            at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
            approx[np.repeat(np.arange(len(own)), n), by_id[at]] = np.inf
        thresh = _kth_bound(approx, min(k, nx))
        margin = REL_MARGIN * (qn + xmax) + 1e-12
        cand = approx <= (thresh + margin)[:, None]
        if not np.isfinite(thresh).all():
            cand &= np.isfinite(approx)
        rows, cols = np.nonzero(cand)
        if len(rows) == 0:
            continue
        d = _exact(Qc, X, rows, cols)
        order = np.lexsort((xrank[cols], d, rows))
        rows, cx, d = rows[order], xids[cols[order]], d[order]
        start = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
        rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
        keep = rank < k
        out_q.append(rows[keep] + s)
        out_x.append(cx[keep])
        out_d.append(d[keep])
    if not out_q:
        return empty
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_d)


def merge_topk(q: np.ndarray, x: np.ndarray, d: np.ndarray, k: int):
    """Keep the k best ``(distance, x)`` rows per ``q`` from candidate arrays."""
    if len(q) == 0:
        return q, x, d
    order = np.lexsort((ranks(x)[0], d, q))
    q, x, d = q[order], x[order], d[order]
    start = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    keep = rank < k
    return q[keep], x[keep], d[keep]


def fold_spaced_texts(texts, dim: int) -> pa.Array:
    """Dense ``array<float>`` per row of hashed, signed token counts.

    Each text arrives lower-cased with every whitespace character already
    mapped to a plain space (done in the JVM), so tokens are the non-empty
    pieces of a split on ``" "``. A token's md5 hex digest picks the bucket
    (hex chars 1-8 as an integer, mod ``dim``) and the sign (hex char 9
    below ``8`` is +). Splitting and counting run in Arrow and NumPy; Python
    sees each distinct token of a slice once. A null text gives an all-zero
    vector.
    """
    arr = as_list_array(texts).cast(pa.string())
    n = len(arr)
    dense = np.zeros(n * dim, dtype=np.float64)
    known: dict[str, tuple[int, float]] = {}
    # One slice at a time, so a batch of long texts is never held twice in full.
    for s in range(0, n, FOLD_SLICE_ROWS):
        pieces = pc.split_pattern(arr.slice(s, FOLD_SLICE_ROWS), " ")
        tokens = pc.list_flatten(pieces).dictionary_encode()
        row = pc.list_parent_indices(pieces).to_numpy(zero_copy_only=False) + s
        words = tokens.dictionary.to_pylist()
        for w in words:
            if w not in known:
                h = hashlib.md5(w.encode("utf-8")).hexdigest()
                known[w] = (int(h[:8], 16) % dim, (-1.0 if h[8] >= "8" else 1.0) if w else 0.0)
        if not words:
            continue
        bucket, sign = (np.array(c) for c in zip(*[known[w] for w in words]))
        code = tokens.indices.to_numpy(zero_copy_only=False)
        lo, hi = s * dim, min(n, s + FOLD_SLICE_ROWS) * dim
        dense[lo:hi] = np.bincount((row - s) * dim + bucket[code], weights=sign[code], minlength=hi - lo)
    offsets = pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(dense.astype(np.float32)))
