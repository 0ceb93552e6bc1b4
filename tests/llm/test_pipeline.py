"""Every stage and run() against a plain restatement on the smallest table."""

import corpus_pipeline
import __spark_entry__ as entry
from nearfield.llm.secret_scan import find_secrets
from nearfield.llm.toxicity import score_documents

from truth_of_packing import check as check_packing
from truth_of_pairs import brute as near_brute

SF = "/root/testdata/sf0.001"


def test_run_equals_its_stages_restated(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in score_documents(docs, labels).where("toxicity_predicted_ = 1").collect()}
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    last = {}
    for k in sorted(left):
        last["".join(c.lower() if c.isascii() else c for c in left[k])] = k
    left = {k: left[k] for k in last.values()}
    classes = near_brute(list(left.items()))
    left = {k: t for k, t in left.items() if classes[k][0] == k}
    masked = {r.doc_id: r.masked for r in find_secrets(docs).collect()}
    rows = entry.queries()["pipeline"](spark, SF).collect()
    check_packing(rows, [(k, masked[k]) for k in left])


def test_stages_keep_the_columns_and_odd_rows(spark, docs_of):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "secret scans", "packing"]
    near = " ".join(f"word{i}" for i in range(100))
    docs = docs_of([(1, None), (2, ""), (3, near), (4, near.upper()), (5, near + " more"), (6, "token = 'abcdefabcdef0123' in"),
                    (None, "no id"), (7, "twice the same"), (7, "twice the same")])
    kept, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, kept, SF)
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        kept = spark.createDataFrame(now.collect(), docs.schema)
        sizes.append(kept.count())
    assert sizes == [9, 6, 5, 5]
    texts = {r.doc_id: r for r in kept.collect()}
    assert texts[6].text == "[SECRET]' in" and texts[6].n_chars == len(texts[6].text)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {r.doc_id for r in packed} == {2, 4, 6, 7, None}


def test_empty_documents(spark, docs_of):
    kept = docs_of([])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, kept, SF)
        assert now.columns == kept.columns
        kept = spark.createDataFrame(now.collect(), kept.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect() == []
