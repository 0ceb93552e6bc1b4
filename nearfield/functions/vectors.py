"""Vector column helpers (``array<float>`` columns).

Spark has no built-in vector distance, so ``l2_sq`` is a higher-order
function expression: exact, JVM-side, and fine for a handful of pairs per
row. Bulk distance work (kNN, cell assignment) uses the Arrow kernels in
``nearfield.operators.kernels`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VECTOR_TYPE = "array<float>"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_float_vector(col: Column | str) -> Column:
    """Cast any numeric array to ``array<float>`` (float32 elements)."""
    return _c(col).cast(VECTOR_TYPE)


def l2_sq(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance, accumulated in double precision.

    Null when either side is null or the dimensions differ.
    """
    a, b = _c(a), _c(b)
    diffs = F.zip_with(
        a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.when(
        F.size(a) == F.size(b), F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, v: acc + v)
    )


def bad_vector(col: Column | str, dim: int) -> Column:
    """True for a null vector, a wrong dimension, or a null / NaN element."""
    c = _c(col)
    return (
        c.isNull()
        | (F.size(c) != dim)
        | F.exists(c, lambda x: x.isNull() | F.isnan(x))
    )
