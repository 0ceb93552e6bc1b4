"""Many seeds at once against one regular expression each."""

import random
import sys

import pytest

from nearfield.operators import titles as TT
from nearfield.operators.titles import Folding, is_plain, search_titles


def both(spark, monkeypatch, titles, seeds, literal):
    items = spark.createDataFrame(list(enumerate(titles)), "item_id bigint, title_final string")
    got = []
    for least in (1, 10**9):
        monkeypatch.setattr(TT, "MANY_SEEDS", least)
        got.append(sorted(map(tuple, search_titles(items, seeds, literal).collect())))
    return got


TITLES = ["The Matrix", "the THE the", None, "", "Straße", "STRASSE", "İstanbul", "istanbul", "ıstanbul", "ſun", "Kelvin K", "ΣΊΣΥΦΟΣ", "σίσυφος", "ǅ",
          "a.b*c", "aXbYc", "𐐀𐐨", "line\nbreak", "\\Qx\\E", "ŉ", "ﬁ fi", "x" * 100_000 + "needle"]
SEEDS = ["the", "THE", "matrix", "straße", "ß", "ss", "İ", "i", "ı", "I", "s", "k", "σ", "ς", "ǆ", "a.b*c", "𐐨", "e\nb", "\\Qx\\E", "ŉ", "ﬁ", "needle", "", "zzz", "the"]


@pytest.mark.parametrize("literal", [True, False])
def test_automaton_and_patterns_find_the_same(spark, monkeypatch, literal):
    seeds = SEEDS if literal else [s for s in SEEDS if "\\Q" not in s] + ["^the", "m.trix"]
    many, few = both(spark, monkeypatch, TITLES, seeds, literal)
    assert many == few and ("the", 0, "The Matrix") in many and len(many) > 40


def test_random_titles(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abAB éÉ") for _ in range(n))
    many, few = both(spark, monkeypatch, [word(12) for _ in range(150)], list({word(rng.randrange(1, 4)) for _ in range(80)}), True)
    assert many == few and many


def test_folding_is_that_of_the_patterns(spark):
    """Every character with a case, against the character rules that the patterns use."""
    char, fold = spark.sparkContext._jvm.java.lang.Character, Folding()
    cased = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (chr(c).upper() != chr(c) or chr(c).lower() != chr(c))]
    assert len(cased) > 2500
    # characters newer than the runtime's tables are as they are there
    odd = [hex(c) for c in cased if fold[c] != char.toLowerCase(char.toUpperCase(c)) and char.isDefined(c) and char.toUpperCase(c) != c]
    assert odd == []


def test_plain_seeds():
    assert is_plain("the end, 2 - 3") and not any(is_plain(s) for s in ("a.b", "^a", "a|b", "(a)", "a\\d", "[a]", "a{2}", "a+"))
