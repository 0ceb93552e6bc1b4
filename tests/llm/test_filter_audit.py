import itertools
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from nearfield.llm.filter_audit import audit, label_flags, later_copies, numbered, quality_conditions
from nearfield.llm.queries import OP12_SQL, all_queries

SF = "/root/testdata/sf0.001"
NAMES = "ABCDE"


def run(docs, labels, **kw):
    conditions = quality_conditions()
    rows = numbered(docs, conditions, "source")
    failing = {n: rows.where(f"fails_{n}").select("row", "id") for n in conditions} | {"E": later_copies(rows)}
    return audit(rows, failing, label_flags(labels), **kw)


def brute(docs, labels):
    """Every order applied step by step; ``docs``: (id, text, source), ``labels``: (id, quality, toxic)."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    fails = []
    for k, t, _ in docs:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        now = set()
        if len(words) < 50:
            now.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            now.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            now.add("C")
        if re.search("[#$%&*|]", t):
            now.add("D")
        if k is not None and any(j is not None and j < k and (u or "") == t for j, u, _ in docs):
            now.add("E")
        fails.append(now)
    out = {}
    for part in {s or "" for *_, s in docs}:
        own = [(k, f) for (k, _, s), f in zip(docs, fails) if (s or "") == part]
        sums = dict.fromkeys(NAMES, 0)
        for order in itertools.permutations(NAMES):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(k, f) for k, f in left if name in f]
                left = [(k, f) for k, f in left if name not in f]
                sums[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f for _, f in own) - len(gone), sum(f == {name} for _, f in own),
                    sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone)]
        for order in itertools.permutations(NAMES):
            for step, name in enumerate(order, 1):
                out[part, "".join(order), step].append(sums[name])
    return out


def as_table(rows):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(OP12_SQL)
    df = all_queries()["op12_audit"](spark, SF)
    assert df.columns == rel.columns and sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("filter_audit")]


LABELS = "doc_id bigint, quality int, toxic int"


def test_odd_rows_equal_brute_force(spark, clashing):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.sample(words, 60)), " ".join(words[:3] * 30), "SHOUT " * 60, "a\tb\x0bc\x85d " * 20, "x # y", "", None, "w " * 100_000,
             "É" * 20 + "A", " \x1c ", "A"]
    docs = [(k, rng.choice(texts), rng.choice(["s", "t"])) for k in range(60)]
    docs += [(3, texts[0], "s"), (3, texts[0], "s"), (None, texts[0], None), (None, None, None), (70, "the same", ""), (71, "the same", None)]
    labels = [(k, k % 2, (k % 3 == 0) * 1) for k in range(0, 60, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1), (71, 1, 1)]
    df = clashing([(k, t) for k, t, _ in docs]).drop("source").withColumn("row", F.lit("x")).withColumn("part", F.lit("x"))
    sources = {i: s for i, (*_, s) in enumerate(docs)}
    ordered = spark.createDataFrame([(k, t, sources[i]) for i, (k, t, _) in enumerate(docs)], "doc_id bigint, text string, source string")
    df = ordered.withColumns({c: F.lit("x") for c in df.columns if c not in ordered.columns})
    got = run(df, spark.createDataFrame(labels, LABELS), rows_per_bucket=7).collect()
    want = brute(docs, labels)
    assert len(got) == len(want) == 3 * 600 and as_table(got) == want


def test_shapley_sums_to_the_removed(spark):
    rows = all_queries()["op12_audit"](spark, SF).collect()
    total = {r.part: r.kept + r.removed for r in rows if r.step == 1}
    for part in total:
        own = [r for r in rows if r.part == part]
        gone = {total[part] - r.kept for r in own if r.step == 5}
        shares = {r.filter_order[r.step - 1]: r.shapley for r in own}
        assert len(gone) == 1 and sum(shares.values()) == math.factorial(5) * gone.pop()


def test_empty_table_and_no_labels(spark, docs_of):
    none = spark.createDataFrame([], LABELS)
    assert run(docs_of([]), none).collect() == []
    clean = " ".join(f"w{i}" for i in range(80))
    rows = run(docs_of([(1, clean)]), none).collect()
    assert len(rows) == 600 and all((r.kept, r.removed, r.shapley) == (1, 0, 0) for r in rows)


@pytest.mark.parametrize("names", ["A", "AB"])
def test_fewer_filters(spark, names):
    rows = spark.createDataFrame([(i, i, "p") for i in range(10)], "row bigint, id bigint, part string")
    failing = {n: rows.where(f"row % {k + 2} = 0").select("row", "id") for k, n in enumerate(names)}
    flags = spark.createDataFrame([(0, True, False)], "id bigint, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in audit(rows, failing, flags).collect()}
    if names == "A":
        assert got == {("A", 1): (5, 5, 0, 5, 1, 5)}
    else:
        assert got == {("AB", 1): (5, 5, 0, 3, 1, 8), ("AB", 2): (3, 2, 2, 2, 0, 6), ("BA", 1): (6, 4, 0, 2, 1, 6), ("BA", 2): (3, 3, 2, 3, 0, 8)}


def test_joins_of_the_id_tables_move_no_row(spark):
    """The stored id tables meet bucket by bucket."""
    from nearfield.llm.filter_audit import _Buckets

    store = _Buckets(spark, 4)
    a, b = (store.write(n, spark.range(1000).where(f"id % {k} = 0").withColumnRenamed("id", "row")) for n, k in (("a", 2), ("b", 3)))
    for how in ("left_anti", "left_semi"):
        plan = a.hint("merge").join(b, "row", how)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    store.drop()
