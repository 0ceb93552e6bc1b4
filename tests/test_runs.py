"""Run folders bucketed by key."""

import os

import pytest
from pyspark.sql import types as T

from nearfield.sources.runs import KeyedRuns, run_folders

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def rows(spark, keys, value):
    return spark.createDataFrame([(k, value) for k in keys], SCHEMA)


def test_pending_and_kept_rows(spark, scratch_dir):
    runs = KeyedRuns(spark, f"{scratch_dir}/it's", SCHEMA, ["k"])
    todo = rows(spark, range(100), "todo")
    assert runs.read().collect() == [] and runs.pending(todo).count() == 100
    runs.append(rows(spark, range(0, 40), "a"))
    runs.append(rows(spark, [], "none"))
    runs.append(rows(spark, range(60, 90), "b"))
    again = KeyedRuns(spark, f"{scratch_dir}/it's", SCHEMA, ["k"], rows=10**9)
    assert again.buckets == runs.buckets  # fixed when the store was made
    assert sorted(r.k for r in again.pending(todo).collect()) == [*range(40, 60), *range(90, 100)]
    assert sorted(map(tuple, again.of(rows(spark, [1, 50, 70], "x")).collect())) == [(1, "a"), (70, "b")]
    assert again.read().count() == 70
    with pytest.raises(ValueError, match="bucketed by"):
        KeyedRuns(spark, f"{scratch_dir}/it's", SCHEMA, ["v"])


def test_unfinished_runs_do_not_count(spark, scratch_dir):
    runs = KeyedRuns(spark, scratch_dir, SCHEMA, ["k"])
    runs.append(rows(spark, range(5), "a"))
    os.remove(f"{scratch_dir}/run=00000/_SUCCESS")
    assert runs.read().count() == 0 and runs.pending(rows(spark, range(9), "")).count() == 9
    runs.append(rows(spark, range(3), "b"))
    assert [f.rsplit("/", 1)[-1] for f in run_folders(spark, scratch_dir)] == ["run=00000", "run=00001"]
    assert {r.v for r in runs.read().collect()} == {"b"} and not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_what_is_done_is_not_shuffled(spark, scratch_dir):
    keys = ["k", "v"]
    runs = KeyedRuns(spark, scratch_dir, SCHEMA, keys)
    for part in range(3):
        runs.append(rows(spark, range(part, 3000, 4), "x"))
    todo = rows(spark, range(3000), "x").where("k >= 0")
    left = runs.pending(todo)
    plan = left._jdf.queryExecution().executedPlan().toString()
    # the rows to do are dealt once; no run has an exchange of its own
    assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 3 and plan.count("Bucketed: true") == 3
    assert sorted(r.k for r in left.collect()) == list(range(3, 3000, 4))
