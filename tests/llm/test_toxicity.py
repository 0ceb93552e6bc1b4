import random

import pytest
from nearfield.llm.queries import all_queries
from nearfield.llm.toxicity import FEATURES, SEEDS, features_of, fit, score_documents, terms_of
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_query_on_the_given_table(spark):
    import zlib

    rows = all_queries()["op5_toxicity"](spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    fresh = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    clean = [p for p, y in fresh if y == 0]
    assert sum(p == y for p, y in fresh) >= 0.93 * len(fresh) and sum(clean) <= 0.06 * len(clean)


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "the", "and", "of"]
    rows = []
    for i in range(n):
        w = [rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(5, 60))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "snarfol", "snarfest"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out_accuracy_and_odd_rows(spark, clashing):
    rows = corpus()
    extra = [(9001, None), (9002, ""), (9003, "snarfing snarfol you snarfly " * 3000), (None, "an idiot, you snarfol snarfing"), (None, "alpha beta")]
    docs = clashing([(k, t) for k, t, _ in rows] + extra + [(9004, "alpha"), (9004, "alpha")])
    labels = spark.createDataFrame([(k, y, 1) for k, _, y in rows] + [(None, 1, 1), (9001, None, 1), (3, 0, 1)], "doc_id bigint, toxic int, quality int")
    out = score_documents(docs, labels, trees=8).collect()
    assert len(out) == docs.count() and out[0].asDict().keys() >= {"doc_id", "text", "score", "toxicity_score_"}
    truth = {k: y for k, _, y in rows}
    assert sum(r.toxicity_predicted_ == truth[r.doc_id] for r in out if r.doc_id in truth) >= 0.98 * len(truth)
    assert {r.toxicity_predicted_ for r in out if r.doc_id in (9001, 9002, 9004)} == {0}
    assert next(r for r in out if r.doc_id == 9003).toxicity_predicted_ == 1
    assert score_documents(docs.limit(0), labels).collect() == []
    again = score_documents(spark.createDataFrame(out), labels, trees=2)
    assert sorted(again.columns) == sorted(out[0].asDict()) and again.count() == len(out)


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)]])
def test_without_labels_the_seeds_decide(spark, docs_of, labels):
    docs = docs_of([(1, "calm words"), (2, "idiot idiot"), (3, None)])
    model = fit(docs, spark.createDataFrame(labels, "doc_id bigint, label int"))
    got = {r.doc_id: r.toxicity_predicted_ for r in model.transform(docs).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_features():
    made = dict(zip(FEATURES, features_of("You IDIOT! st*pid 1d1ot snarfol", frozenset(SEEDS), frozenset(["snar-"]), 5)))
    assert made["seeds"] > 0 and made["learned"] > made["seeds"] and made["learned_kinds"] == 1
    assert made["near_second_person"] > 0 and made["undone"] > 0 and made["obfuscated"] > 0 and made["exclamations"] > 0
    assert features_of("", frozenset(SEEDS), frozenset(), 5) == [0.0] * len(FEATURES)
    assert terms_of("snarfol") == ("snarfol", "snar-", "snarf-", "snarfo-") and terms_of("abc") == ("abc",)


def test_sample_bound(spark, docs_of):
    rows = corpus(2000)
    docs = docs_of([(k, t) for k, t, _ in rows])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, label int")
    model = fit(docs, labels, max_rows=500, trees=3)
    out = model.transform(docs).join(labels, "doc_id").agg(F.avg((F.col("toxicity_predicted_") == F.col("label")).cast("int"))).first()[0]
    assert out >= 0.97


def test_long_tokens_cost_linear_time():
    import time

    began = time.time()
    for text in ("a" * 1_000_000, "a1" * 500_000, "!" * 1_000_000, "idiot you " * 100_000):
        assert len(features_of(text, frozenset(SEEDS), frozenset(), 5)) == len(FEATURES)
    assert time.time() - began < 30
