"""Properties of the text rules on random input."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.functions import text as TX

# Letters, Python whitespace (incl. non-ASCII and control separators) and
# characters that look blank but are not whitespace.
ALPHABET = ["a", "b", "\u00e9", "/", " ", "\t", "\n", "\u00a0", "\u3000", "\u2003", "\x1c", "\x85", "\u200b", "\ufeff"]
field = st.one_of(st.none(), st.text(alphabet=st.sampled_from(ALPHABET), max_size=10))
row = st.tuples(field, field, field, field)
COLUMNS = ("t", "g", "d", "r")


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, min_size=1, max_size=60), cap=st.integers(min_value=1, max_value=4))
def test_rules_keep_their_properties(spark, rows, cap):
    cols = [F.col(c) for c in COLUMNS]
    filled = [F.lit("full")] + cols[1:], cols[:1] + [F.lit("full")] + cols[2:], cols[:2] + [F.lit("full")] + cols[3:], cols[:3] + [F.lit("full")]
    got = spark.createDataFrame(rows, "t string, g string, d string, r string").select(
        TX.embedding_tier(*cols).alias("tier"),
        TX.embedding_input(*cols, max_review_words=cap).alias("text"),
        TX.truncate_words(F.col("r"), cap).alias("cut"),
        TX.word_count(F.col("r")).alias("words"),
        *[TX.strip(c).alias(f"s{i}") for i, c in enumerate(cols)],
        *[TX.embedding_tier(*f).alias(f"with{i}") for i, f in enumerate(filled)],
    ).collect()
    parts = {1: 4, 2: 3, 3: 2}
    for (*_, review), out in zip(rows, got):
        assert all(out[f"with{i}"] <= out["tier"] for i in range(4))  # filling a field never harms
        assert (out["text"] is None) == (out["tier"] == 4)
        if out["text"] is not None:
            pieces = out["text"].split(TX.PART_SEPARATOR)
            assert len(pieces) == parts[out["tier"]] and all(p and p == p.strip() for p in pieces)
            assert pieces[:2] == [out["s0"], out["s1"]]
        if review is None:
            assert out["cut"] is None and out["words"] is None
        else:
            assert len(out["cut"].split()) == min(cap, out["words"]) and out["words"] == len(review.split())
            assert out["cut"] == review or out["cut"].split() == review.split()[:cap]
        assert all(out[f"s{i}"] is None or out[f"s{i}"] == out[f"s{i}"].strip() for i in range(4))
