"""Parsing of landed catalogue-search responses.

A response body is JSON ``{"results": [{"title", "overview", "genre_ids"}]}``.
Only the first result counts. Parsing happens on the map side (``from_json``
in PERMISSIVE mode), so only three short strings per item ever reach a
shuffle, never the raw body.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_TYPE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("overview", T.StringType()),
        T.StructField("genre_ids", T.ArrayType(T.LongType())),
    ]
)
RESPONSE_TYPE = T.StructType([T.StructField("results", T.ArrayType(RESULT_TYPE))])

# Separator between genre ids in the enrichment genres string (fixed value).
GENRE_ID_SEPARATOR = "|"


def top_result(body: Column | str) -> Column:
    """First search result as a struct; null when the body is null, malformed
    or has no results."""
    b = F.col(body) if isinstance(body, str) else body
    return F.get(F.from_json(b, RESPONSE_TYPE).getField("results"), 0)


def top_result_fields(top: Column) -> dict[str, Column]:
    """Enrichment fields of a parsed top result.

    A found result with a missing field yields ``""`` for it; genre ids are
    joined by ``|`` without name resolution. No result yields nulls.
    """
    found = top.isNotNull()
    ids = F.coalesce(top.getField("genre_ids"), F.array().cast("array<bigint>"))
    return {
        "e_title": F.when(found, F.coalesce(top.getField("title"), F.lit(""))),
        "e_description": F.when(found, F.coalesce(top.getField("overview"), F.lit(""))),
        "e_genres": F.when(
            found,
            F.array_join(F.transform(ids, lambda x: x.cast("string")), GENRE_ID_SEPARATOR),
        ),
    }


def parse_top_result(body: Column | str) -> Column:
    """Struct ``(e_title, e_description, e_genres)``; null when nothing found."""
    top = top_result(body)
    fields = top_result_fields(top)
    return F.when(top.isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))
