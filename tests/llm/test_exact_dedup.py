import hashlib
import random
from collections import defaultdict

import duckdb
from nearfield.llm.exact_dedup import ContentTable, drop_copies, exact_groups, grace
from nearfield.llm.queries import OP9_SQL, all_queries

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    rel = con.sql(OP9_SQL)
    df = all_queries()["op9_exact"](spark, SF)
    assert df.columns == rel.columns and sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_small_tables_spill_and_agree(spark, clashing):
    rng = random.Random(3)
    docs = [(i, rng.choice(["Hot", "hOT", "É", "é"]) if i % 3 else f"text {rng.randrange(200)} " * 20) for i in range(900)]
    want = defaultdict(list)
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    for k, t in docs:
        want[low(t)].append(k)
    for bound in (1, 3000, 64 << 20):
        rows = exact_groups(clashing(docs), table_bytes=bound, partition_bytes=4000).collect()
        assert len(rows) == len(docs)
        for r in rows:
            t = low(dict(docs)[r.doc_id])
            assert (r.keep_id, r.group_size, r.text_sha256) == (max(want[t]), len(want[t]), hashlib.sha256(t.encode()).hexdigest())
            assert r.kept == (r.doc_id == r.keep_id)


def test_grace_recursion_on_equal_digits():
    # hashes that share all digits can't be split; complete contents still tell entries apart
    records = [(5, bytes([65 + i % 7]) * 100, 1, i) for i in range(70)]
    assert sorted((c, n, m) for _, c, n, m in grace(iter(records), 1)) == [(bytes([65 + i]) * 100, 10, 63 + i) for i in range(7)]
    table = ContentTable()
    for i in range(5000):
        table.add(0, str(i).encode(), 1, None)
    table.add(0, b"17", 2, 9)
    assert len(table.hashes) == 5000 and table.counts[17] == 3 and table.largest[17] == 9


def test_odd_rows(spark, clashing):
    docs = [(1, None), (2, ""), (None, ""), (3, "x" * 100_000), (7, "Same"), (7, "sAME"), (7, "same"), (None, "only null"), (None, "only null")]
    rows = exact_groups(clashing(docs)).collect()
    assert len(rows) == len(docs)
    by = defaultdict(list)
    for r in rows:
        by[r.text_sha256].append(r)
    assert all(sum(r.kept for r in g) == 1 and all(r.group_size == len(g) for r in g) for g in by.values())
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in empty} == {2} and len(empty) == 3
    left = drop_copies(clashing(docs))
    assert left.columns == clashing(docs).columns
    assert sorted((r.doc_id or 0, (r.text or "").lower()[:9]) for r in left.collect()) == [(0, "only null"), (2, ""), (3, "x" * 9), (7, "same")]
    assert exact_groups(clashing(docs).limit(0)).collect() == [] and drop_copies(clashing(docs).limit(0)).collect() == []


def test_ids_of_any_type_keep_it(spark):
    texts = ["Ab", "aB", None, "", "c" * 300, "C" * 300, "ab"]
    names = ["x9", "x10", None, "é", "a", "", "x9\U0001f600"]
    for kind, ids in (("string", names), ("int", [5, 7, None, -3, 2, 1, 7])):
        docs = spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string")
        for bound in (1, 64 << 20):
            out = exact_groups(docs, table_bytes=bound)
            assert out.schema["doc_id"].dataType == out.schema["keep_id"].dataType == docs.schema["doc_id"].dataType
            stays = {"ab": max(i for i, t in zip(ids, texts) if t and t.lower() == "ab"), "": ids[3], "c" * 300: max(ids[4], ids[5])}
            want = sorted((str(i), stays[(t or "").lower()]) for i, t in zip(ids, texts))
            assert sorted((str(r.doc_id), r.keep_id) for r in out.collect()) == want
        assert sorted(map(str, stays.values())) == sorted(str(r.doc_id) for r in drop_copies(docs).collect())
