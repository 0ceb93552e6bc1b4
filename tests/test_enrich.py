"""Response parsing, enrichment joins and preparation invariants."""

from pyspark.sql import functions as F

from nearfield.functions.json import parse_top_result
from nearfield.operators import enrich as E
from nearfield.sources import fixtures as FX

from paths import SF_MID


def test_parse_top_result_cases(spark):
    bodies = [
        ("not json",),
        ('{"results":[]}',),
        (None,),
        ('{"results":[{"title":"a"}]}',),
        ('{"results":[{"title":"a","overview":"o","genre_ids":[12,7]},{"title":"b"}]}',),
    ]
    got = spark.createDataFrame(bodies, "body string").select(parse_top_result("body").alias("r")).collect()
    assert got[0]["r"] is None and got[1]["r"] is None and got[2]["r"] is None
    assert got[3]["r"].asDict() == {"e_title": "a", "e_description": "", "e_genres": ""}
    assert got[4]["r"].asDict() == {"e_title": "a", "e_description": "o", "e_genres": "12|7"}


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, title string, genres string, description string, review_text string")


def test_enrich_one_row_per_weak_item_and_duplicates(spark):
    items = _items(spark, [(1, "T", None, None, "r"), (2, None, None, None, None), (3, "T", "g", "d", None)])
    resp = spark.createDataFrame(
        [
            (1, '{"results":[{"title":"X","overview":"ov","genre_ids":[1]}]}'),
            (1, '{"results":[{"title":"A","overview":"ov","genre_ids":[2]}]}'),
            (1, "not json"),
            (3, '{"results":[{"title":"Z","overview":"z","genre_ids":[3]}]}'),
        ],
        "item_id bigint, body string",
    )
    enr = E.enrich(E.needs_enrichment(items), resp).orderBy("item_id").collect()
    assert [r["item_id"] for r in enr] == [1, 2]
    assert enr[0]["e_title"] == "A"  # smallest of several found results
    assert enr[1]["e_title"] is None
    prepared = {r["item_id"]: r for r in E.prepare_items(items, resp).collect()}
    assert prepared[1]["title_final"] == "T" and prepared[1]["genres_final"] == "2"
    assert prepared[1]["embedding_tier"] == 1  # the review was kept: tier 4 -> 1
    assert prepared[3]["genres_final"] == "g"  # strong items are never enriched


def test_prepare_invariants(spark):
    items = FX.items_view(spark, SF_MID)
    prepared = E.prepare_items(items, FX.responses_view(spark, SF_MID))
    r = prepared.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("embedding_tier") == 4) != F.col("embedding_input").isNull()).alias("bad_null"),
        F.count_if(F.col("embedding_tier") > F.col("initial_tier")).alias("raised"),
        F.count_distinct("item_id").alias("keys"),
    ).first()
    assert r["n"] == items.count() == r["keys"]
    assert r["bad_null"] == 0 and r["raised"] == 0
    tiers = {x["embedding_tier"]: x["count"] for x in prepared.groupBy("embedding_tier").count().collect()}
    before = {x["initial_tier"]: x["count"] for x in prepared.groupBy("initial_tier").count().collect()}
    assert before == {1: 43, 2: 386, 3: 71, 4: 500}
    assert tiers == {1: 75, 2: 685, 3: 71, 4: 169}


def test_merge_keeps_row_count(spark):
    items = E.with_tier(FX.items_view(spark, SF_MID))
    enr = E.enrich(items.where(F.col("initial_tier") == 4), FX.responses_view(spark, SF_MID))
    assert E.merge_enrichment(items, enr).count() == items.count()


def test_merge_keeps_one_row_under_a_hot_repeated_key(spark):
    items = _items(spark, [(1, None, "g", "d", None), (2, "t", "g", "d", None)])
    rows = [(1, f"title {i:03d}", "desc", "7") for i in range(200)] + [(3, "x", "y", "z")]
    enr = spark.createDataFrame(rows, "item_id bigint, e_title string, e_description string, e_genres string")
    out = {r["item_id"]: r for r in E.merge_enrichment(items, enr).collect()}
    assert len(out) == 2 and out[1]["title_final"] == "title 000" and out[2]["title_final"] == "t"


def test_check_keys_rejects_null_and_duplicate(spark):
    import pytest

    from nearfield.sources.catalog import check_keys

    ok = _items(spark, [(1, "a", None, None, None), (2, "b", None, None, None)])
    check_keys(ok)
    with pytest.raises(ValueError, match="duplicate"):
        check_keys(_items(spark, [(1, "a", None, None, None), (1, "b", None, None, None)]))
    with pytest.raises(ValueError, match="null"):
        check_keys(_items(spark, [(None, "a", None, None, None)]))


def test_search_titles_regex_and_literal(spark):
    from nearfield.plans.jobs import first_matches, search_titles

    items = spark.createDataFrame(
        [(1, "The Dark"), (2, "a.b"), (3, "axb"), (4, None), (5, "ÉTÉ été")], "item_id bigint, title_final string"
    )
    regex = {(r["seed"], r["item_id"]) for r in search_titles(items, ["the", "a.b", "été"]).collect()}
    assert regex == {("the", 1), ("a.b", 2), ("a.b", 3), ("été", 5)}
    literal = {(r["seed"], r["item_id"]) for r in search_titles(items, ["a.b"], literal=True).collect()}
    assert literal == {("a.b", 2)}
    firsts = {r["seed"]: r["seed_item_id"] for r in first_matches(search_titles(items, ["a.b"])).collect()}
    assert firsts == {"a.b": 2}


def test_reports_on_empty_input_give_null_percent(spark):
    from nearfield.operators import reports as R

    empty = spark.createDataFrame([], "item_id bigint, embedding_input string")
    r = R.gap_report(empty).first()
    assert r["n_items"] == 0 and r["gap_pct"] is None


def test_item_descriptions_are_whole_texts(spark):
    items = FX.items_view(spark, SF_MID).where(F.col("description").isNotNull())
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select(F.col("doc_id").alias("item_id"), "text")
    r = items.join(docs, "item_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("description") != F.col("text")).alias("differ")
    ).first()
    assert r["n"] > 0 and r["differ"] == 0


def test_a_found_record_beats_a_null_one(spark):
    items = _items(spark, [(1, None, None, None, None), (2, None, None, None, None)])
    enr = spark.createDataFrame(
        [(1, None, None, None), (1, "Found", "d", "7"), (2, None, None, None)],
        "item_id bigint, e_title string, e_description string, e_genres string",
    )
    got = sorted(map(tuple, E.merge_enrichment(items, enr).select("item_id", "title_final", "genres_final").collect()), key=lambda r: r[0])
    assert got == [(1, "Found", "7"), (2, None, None)]
