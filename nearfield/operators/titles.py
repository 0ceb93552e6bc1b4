"""Titles searched for many seeds at once.

Few seeds are one regular expression each. Seeds that hold no regular
expression, beyond a few, go into one Aho-Corasick automaton: a title is folded
and walked once, however many seeds there are. Folding follows the case rules
of the regular expressions (``(?iu)``: each character's lower case of its upper
case, one to one), so both ways find the same.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# Plain seeds from which on the automaton is used.
MANY_SEEDS = 32
# Rows a result batch holds about.
BATCH_ROWS = 16_384
_PATTERN = re.compile(r"[\\^$.|?*+()\[\]{}]")


class Folding(dict):
    """A ``str.translate`` table, filled as characters are met."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        up = c.upper()
        up = up if len(up) == 1 else c
        # U+0130 is the one letter whose lower case is longer than itself; its first character is the simple one
        low = up.lower()[0] if len(up.lower()) == 1 or up == "İ" else up
        self[code] = ord(low)
        return self[code]


def is_plain(seed: str) -> bool:
    """Whether a seed matches just itself as a regular expression."""
    return not _PATTERN.search(seed)


def quote(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def search_titles(items: DataFrame, seeds: list[str], literal: bool = False, title_col: str = "title_final") -> DataFrame:
    """``(seed, item_id, title)`` for every item whose title matches a seed.

    Seeds are case-insensitive regular expressions (``literal=True`` quotes
    them). The seed list is a parameter, so matching is one pass over the
    titles — no join — and a null title never matches. A seed given twice
    counts once.
    """
    if not seeds:
        raise ValueError("at least one seed is required")
    seeds = list(dict.fromkeys(seeds))
    plain = [s for s in seeds if literal or is_plain(s)]
    many = plain if len(plain) >= MANY_SEEDS else []
    few = [s for s in seeds if not many or s not in set(many)]
    parts = ([_by_automaton(items, many, title_col)] if many else []) + ([_by_patterns(items, few, literal, title_col)] if few else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _by_patterns(items: DataFrame, seeds: list[str], literal: bool, title_col: str) -> DataFrame:
    title = F.col(title_col)
    hits = [F.when(title.rlike("(?iu)" + (quote(s) if literal else s)), F.lit(s)) for s in seeds]
    return items.select(
        F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("seed"), F.col("item_id"), title.alias("title")
    )


def _by_automaton(items: DataFrame, seeds: list[str], title_col: str) -> DataFrame:
    src = items.where(F.col(title_col).isNotNull()).select("item_id", F.col(title_col).alias("title"))
    id_type = to_arrow_type(src.schema["item_id"].dataType)
    schema = pa.schema([("seed", pa.string()), ("item_id", id_type), ("title", pa.string())])

    def walk(batches):
        import ahocorasick

        fold = Folding()
        by_word: dict[str, list[int]] = {}
        for i, s in enumerate(seeds):
            by_word.setdefault(s.translate(fold), []).append(i)
        everywhere = by_word.pop("", [])  # an empty seed is part of every title
        automaton = ahocorasick.Automaton()
        for word, own in by_word.items():
            automaton.add_word(word, own)
        automaton.make_automaton()
        for batch in batches:
            ids, titles = batch.column("item_id").cast(id_type), batch.column("title").cast(pa.string())
            rows, found = [], []

            def taken():
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([pa.array([seeds[i] for i in found], pa.string()), ids.take(at), titles.take(at)], schema=schema)

            for row, title in enumerate(titles.to_pylist()):
                hit = set(everywhere)
                if by_word:
                    for _, own in automaton.iter(title.translate(fold)):
                        hit.update(own)
                rows += [row] * len(hit)
                found += sorted(hit)
                if len(rows) >= BATCH_ROWS:
                    yield taken()
                    rows, found = [], []
            if rows:
                yield taken()

    return src.mapInArrow(walk, f"seed string, item_id {src.schema['item_id'].dataType.simpleString()}, title string")
