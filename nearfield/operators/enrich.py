"""Tiering and enrichment of weak items (Q1, item preparation).

Plan shape: the items are read once. Responses are parsed and narrowed
map-side, filtered to found results and reduced to one result per item with
a partial aggregate, so a key repeated across a third of the responses
cannot fan out the join. The items then meet that table in one left join on
``item_id``, and only tier-4 items take its fields. When the response table
is small, adaptive execution broadcasts it and the items never shuffle. At
scale, the items are already hash-partitioned on the key by the review
join, so only the response side shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.json import top_result, top_result_fields
from nearfield.functions.text import (
    DEFAULT_MAX_REVIEW_WORDS,
    coalesce_present,
    embedding_input,
    is_present,
    strip,
    tier_from_flags,
)

ENRICHED = ("e_title", "e_description", "e_genres")


def with_tier(items: DataFrame, name: str = "initial_tier", prefix: str = "") -> DataFrame:
    """Add the tier of ``{prefix}title`` / genres / description and the review.

    Presence flags are projected first and the tier from them, so each field
    is stripped once per row (Catalyst keeps the non-cheap flags in their own
    projection instead of re-inlining them).
    """
    fields = (prefix + "title", prefix + "genres", prefix + "description", "review_text")
    flags = [f"_p{i}" for i in range(4)]
    staged = items.select("*", *[is_present(F.col(c)).alias(f) for c, f in zip(fields, flags)])
    return staged.select(*items.columns, tier_from_flags(*[F.col(f) for f in flags]).alias(name))


def needs_enrichment(items: DataFrame) -> DataFrame:
    """Items whose initial tier is 4 (only the tier is computed, no text)."""
    return with_tier(items).where(F.col("initial_tier") == 4)


def top_results(responses: DataFrame) -> DataFrame:
    """``(item_id, e_title, e_description, e_genres)`` of found first results,
    one row per item (the smallest result when several responses landed)."""
    parsed = responses.select("item_id", top_result(F.col("body")).alias("top")).where(
        F.col("top").isNotNull()
    )
    fields = top_result_fields(F.col("top"))
    narrow = parsed.select("item_id", *[c.alias(n) for n, c in fields.items()])
    return one_per_item(narrow)


def one_per_item(enrichment: DataFrame) -> DataFrame:
    """One enrichment row per item: the smallest ``(e_title, e_description,
    e_genres)`` record that holds anything (records of nulls only say that
    nothing was found). A partial aggregate on the join key, so a key repeated
    in a third of all rows is combined map-side and adds no shuffle before the
    join on ``item_id``."""
    found = F.coalesce(*ENRICHED).isNotNull()
    return enrichment.where(found).groupBy("item_id").agg(F.min(F.struct(*ENRICHED)).alias("e")).select("item_id", "e.*")


def enrich(weak: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per weak item with its enrichment fields (null when not found)."""
    return weak.select("item_id").join(top_results(responses), "item_id", "left")


def _finals(df: DataFrame) -> DataFrame:
    pairs = (("title", "e_title"), ("genres", "e_genres"), ("description", "e_description"))
    t, g, d = (coalesce_present(F.col(c), F.col(e)) for c, e in pairs)
    return df.select(
        "item_id",
        t.alias("title_final"),
        g.alias("genres_final"),
        d.alias("description_final"),
        "review_text",
        "initial_tier",
    )


def merge_enrichment(items: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Items left-joined to an enrichment table, with blank-aware final fields.

    Every item keeps exactly one row, also when the enrichment table repeats
    a key (the smallest record wins); the review never comes from enrichment.
    """
    base = items if "initial_tier" in items.columns else with_tier(items)
    joined = base.join(one_per_item(enrichment.select("item_id", *ENRICHED)), "item_id", "left")
    return _finals(joined)


def finalize(df: DataFrame, max_review_words: int = DEFAULT_MAX_REVIEW_WORDS) -> DataFrame:
    """Add ``embedding_tier`` and ``embedding_input`` from the final fields.

    Three narrow projections: stripped fields, then presence flags and tier,
    then the text from the stripped fields.
    """
    fields = ("title_final", "genres_final", "description_final", "review_text")
    stripped = [f"_s{i}" for i in range(4)]
    s1 = df.select("*", *[strip(F.col(c)).alias(n) for c, n in zip(fields, stripped)])
    tier = tier_from_flags(*[F.coalesce(F.length(F.col(n)) > 0, F.lit(False)) for n in stripped])
    s2 = s1.select("*", tier.alias("embedding_tier"))
    text = embedding_input(
        *[F.col(n) for n in stripped],
        max_review_words=max_review_words,
        tier=F.col("embedding_tier"),
        stripped=True,
    )
    return s2.select(*df.columns, "embedding_tier", text.alias("embedding_input"))


def prepare_items(
    items: DataFrame, responses: DataFrame, max_review_words: int = DEFAULT_MAX_REVIEW_WORDS
) -> DataFrame:
    """Q1: ``(item_id, title_final, genres_final, description_final,
    review_text, initial_tier, embedding_tier, embedding_input)``."""
    tiered = with_tier(items)
    # One pass over the items: every item meets the one-row-per-item response
    # table, and only tier-4 items take its fields (the others see nulls,
    # which leave their own fields unchanged). The items are read once.
    joined = tiered.join(top_results(responses), "item_id", "left")
    weak = F.col("initial_tier") == 4
    masked = joined.select(*tiered.columns, *[F.when(weak, F.col(e)).alias(e) for e in ENRICHED])
    return finalize(_finals(masked), max_review_words)


def gaps(prepared: DataFrame) -> DataFrame:
    """Items still without an embedding text after enrichment."""
    return prepared.where(F.col("embedding_input").isNull())


def embeddable(prepared: DataFrame) -> DataFrame:
    """Items with an embedding text."""
    return prepared.where(F.col("embedding_input").isNotNull())
