"""Column-expression functions (pure Catalyst, no Python workers)."""

from nearfield.functions.json import parse_top_result, top_result, top_result_fields
from nearfield.functions.text import (
    coalesce_present,
    embedding_input,
    embedding_tier,
    is_present,
    strip,
    tier_label,
    truncate_words,
    word_count,
)
from nearfield.functions.vectors import bad_vector, l2_sq, to_float_vector

__all__ = [
    "bad_vector",
    "coalesce_present",
    "embedding_input",
    "embedding_tier",
    "is_present",
    "l2_sq",
    "parse_top_result",
    "strip",
    "tier_label",
    "to_float_vector",
    "top_result",
    "top_result_fields",
    "truncate_words",
    "word_count",
]
