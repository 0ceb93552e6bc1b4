"""Text embedding: a pluggable batch encoder and a built-in hashing encoder.

``embed`` runs any encoder over Arrow batches (``mapInArrow``): the encoder
is built once per task, fed ``batch_size`` texts at a time and must return a
float32 ``(n, dim)`` matrix; no normalisation is applied.

``hash_embed`` is the offline encoder: tokens are the non-empty pieces of
the lower-cased, stripped text split on whitespace; each token's md5 picks a
bucket (hex chars 1-8 as an integer, mod dim) and a sign (hex char 9 below
``8`` is +). The vector element is the signed token count. Lower-casing and
whitespace mapping run in the JVM; splitting, hashing (each distinct token
once) and the fold into a dense vector run in one Arrow UDF, with no shuffle. Measured
about a quarter faster than per-token md5 in JVM higher-order functions,
which Spark evaluates interpreted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.text import WS_CHARS
from nearfield.operators import kernels as K
from nearfield.operators.knn import id_column

Encoder = Callable[[Sequence[str]], np.ndarray]
DEFAULT_BATCH = 512


def spaced_lower(text: Column) -> Column:
    """Lower-cased text with every whitespace character mapped to a plain
    space (a JVM character translation, no regex), so a split on ``" "``
    with empty pieces dropped equals splitting the stripped text on
    whitespace runs."""
    return F.translate(F.lower(text), WS_CHARS, " " * len(WS_CHARS))


def _fold_udf(dim: int):
    @F.arrow_udf("array<float>")
    def fold(texts: pa.Array) -> pa.Array:
        return K.fold_spaced_texts(texts, dim)

    return fold


def hash_vector(text_col: str, dim: int) -> Column:
    """The hashed vector of a text column; null for a null text."""
    text = F.col(text_col)
    return F.when(text.isNotNull(), _fold_udf(dim)(spaced_lower(text)))


def hash_embed(
    df: DataFrame, dim: int, text_col: str = "embedding_input", id_col: str = "item_id", carry: Sequence[str] = ()
) -> DataFrame:
    """``(item_id, embedding)`` and the columns of ``carry`` for every row with a non-null text."""
    src = df.where(F.col(text_col).isNotNull())
    return src.select(
        F.col(id_col).alias("item_id"), _fold_udf(dim)(spaced_lower(F.col(text_col))).alias("embedding"), *carry
    )


def embed(
    df: DataFrame,
    encoder_factory: Callable[[], Encoder],
    dim: int,
    text_col: str = "embedding_input",
    id_col: str = "item_id",
    batch_size: int = DEFAULT_BATCH,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Run a batch encoder over the texts; ``(item_id, embedding)`` and the columns of ``carry``.

    Rows with a null text are skipped. The output dimension is checked on
    every batch.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    src = df.where(F.col(text_col).isNotNull()).select(id_column(df, id_col).alias("item_id"), F.col(text_col), *carry)

    def run(batches):
        encoder = None
        for rb in batches:
            for s in range(0, rb.num_rows, batch_size):
                part = rb.slice(s, batch_size)
                if encoder is None:
                    encoder = encoder_factory()
                vecs = np.asarray(encoder(part.column(text_col).to_pylist()), dtype=np.float32)
                if vecs.shape != (part.num_rows, dim):
                    raise ValueError(f"encoder returned shape {vecs.shape}, expected ({part.num_rows}, {dim})")
                offsets = pa.array(np.arange(0, vecs.size + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id"), pa.ListArray.from_arrays(offsets, pa.array(vecs.reshape(-1))), *[part.column(c) for c in carry]],
                    names=["item_id", "embedding", *carry],
                )

    types = dict(src.dtypes)
    carried = "".join(f", `{c}` {types[c]}" for c in carry)
    return src.mapInArrow(run, f"item_id {types['item_id']}, embedding array<float>{carried}")


class PythonHashEncoder:
    """The hashing encoder in the form ``embed`` takes (texts in, matrix out);
    agrees with ``hash_embed`` on texts whose lower-casing is the same in
    Python and Java."""

    def __init__(self, dim: int):
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        spaced = pa.array([" ".join(t.lower().split()) for t in texts], pa.string())
        return K.to_matrix(K.fold_spaced_texts(spaced, self.dim), self.dim).astype(np.float32)
