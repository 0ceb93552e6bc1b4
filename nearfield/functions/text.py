"""Text rules for item completeness, as native Catalyst column expressions.

Every function here takes and returns ``Column`` objects, so a whole rule
set compiles into one projection inside whole-stage codegen: no Python
worker is involved. The rules follow Python string semantics (``str.strip``
and ``str.split`` with no argument), which differ from Spark's ``trim`` and
Java's ``\\s``; the explicit whitespace set below closes that gap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# The 29 BMP code points Python treats as whitespace in str.strip/str.split:
# U+0009-U+000D, U+001C-U+0020, U+0085, U+00A0, U+1680, U+2000-U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000.
WS_CODE_POINTS: tuple[int, ...] = (
    tuple(range(0x09, 0x0E))
    + tuple(range(0x1C, 0x21))
    + (0x85, 0xA0, 0x1680)
    + tuple(range(0x2000, 0x200B))
    + (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
# The same set as one regex class; Java regex and RE2 both accept it.
WS_CLASS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WS_RUN = WS_CLASS + "+"
# Separator between the parts of an embedding text.
PART_SEPARATOR = " | "
# Default word cap on the review part.
DEFAULT_MAX_REVIEW_WORDS = 256
# Human labels of the four tiers.
TIER_LABELS = {
    1: "Full (title+genres+desc+review)",
    2: "Good (title+genres+desc)",
    3: "Thin (title+genres)",
    4: "Bridge (enrichment)",
}
# ---------------------------------------------------------------------------

WS_CHARS = "".join(chr(c) for c in WS_CODE_POINTS)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Remove Python-whitespace from both ends (``str.strip()``).

    ``trim(str, chars)`` treats ``chars`` as a set, so this is a codegen'd
    character scan rather than a regex.
    """
    return F.trim(_c(col), F.lit(WS_CHARS))


def is_present(col: Column | str) -> Column:
    """True when the value is non-null and holds a non-whitespace character."""
    return F.coalesce(F.length(strip(col)) > 0, F.lit(False))


def word_count(col: Column | str) -> Column:
    """Number of Python ``str.split()`` words; null stays null."""
    s = strip(col)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, WS_RUN)))


def truncate_words(col: Column | str, max_words: int) -> Column:
    """First ``max_words`` words joined by single spaces.

    Text already within the limit is returned unchanged, inner spacing and
    outer whitespace included. A negative limit is rejected (Python would
    slice from the end, which no caller wants).
    """
    if max_words < 0:
        raise ValueError(f"max_words must be >= 0, got {max_words}")
    c = _c(col)
    s = strip(c)
    # At most one piece past the limit, which holds the rest of the text.
    words = F.split(s, WS_RUN, max_words + 1)
    return F.when((s == "") | (F.size(words) <= max_words), c).otherwise(
        F.array_join(F.slice(words, 1, max_words), " ")
    )


def tier_from_flags(t: Column, g: Column, d: Column, r: Column) -> Column:
    """Tier 1..4 from four presence flags (title, genres, description, review)."""
    return (
        F.when(t & g & d & r, F.lit(1))
        .when(t & g & d, F.lit(2))
        .when(t & g, F.lit(3))
        .otherwise(F.lit(4))
    )


def embedding_tier(title, genres, description, review) -> Column:
    """Tier 1..4 from the presence of the four fields.

    1 = title, genres, description and review; 2 = first three; 3 = title and
    genres; 4 = anything else (a review without description is ignored,
    genres without title count for nothing).
    """
    return tier_from_flags(*(is_present(x) for x in (title, genres, description, review)))


def embedding_input(
    title,
    genres,
    description,
    review,
    max_review_words: int = DEFAULT_MAX_REVIEW_WORDS,
    tier: Column | None = None,
    stripped: bool = False,
) -> Column:
    """The text fed to the encoder: stripped parts joined by ``" | "``.

    Parts by tier: title and genres always, description for tiers 1-2, the
    word-capped review for tier 1. Null for tier 4. ``tier`` may be passed
    when it is already computed, and ``stripped=True`` when the four inputs
    are already stripped, to avoid re-deriving either.
    """
    if tier is None:
        tier = embedding_tier(title, genres, description, review)
    s = (lambda c: _c(c)) if stripped else strip
    review_part = truncate_words(s(review), max_review_words)
    return F.when(
        tier < 4,
        F.concat_ws(
            PART_SEPARATOR,
            s(title),
            s(genres),
            F.when(tier <= 2, s(description)),
            F.when(tier == 1, review_part),
        ),
    )


def coalesce_present(primary, fallback) -> Column:
    """Primary when present, else fallback when present, else null (no strip)."""
    p, f = _c(primary), _c(fallback)
    return F.coalesce(F.when(is_present(p), p), F.when(is_present(f), f))


def tier_label(col: Column | str) -> Column:
    """Human label of a tier number; unknown tiers map to ``""``."""
    c = _c(col)
    expr = F.lit("")
    for tier in sorted(TIER_LABELS, reverse=True):
        expr = F.when(c == tier, F.lit(TIER_LABELS[tier])).otherwise(expr)
    return expr
