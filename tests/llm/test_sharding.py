import zlib
from collections import Counter, defaultdict

import pytest
from nearfield.llm.queries import all_queries
from nearfield.llm.sharding import longest_first, shard_by_size

SF = "/root/testdata/sf0.001"


def check(rows, docs, shards):
    """Sizes, digests, gapless slots, and equal texts in one shard."""
    assert len(rows) == len(docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in docs)
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    by_key = defaultdict(set)
    for k, t in docs:
        by_key[(k, zlib.crc32((t or "").encode()))].add(t or "")
    for r in rows:
        for t in by_key[(r.doc_id, r.text_crc32)]:
            where[t].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    return [load[s] for s in range(shards)]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_on_the_given_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = all_queries()["op6_sharding"](spark, sf).collect()
    load = check(rows, docs, 24)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    groups = Counter()
    for k, t in docs:
        groups[t] += len(t.encode()) + 8
    # the bound that the longest-first rule keeps: within a third of the mean and the largest group
    assert max(load) <= max(4 / 3 * sum(load) / 24, max(groups.values()) + sum(load) / 24)
    assert sf == SF or max(load) <= 1.02 * sum(load) / 24


def test_odd_rows(spark, clashing):
    docs = [(i, "same text") for i in range(300)] + [(1, None), (2, ""), (3, "é" * 9000), (None, "a"), (None, "a"), (None, None)]
    rows = shard_by_size(clashing(docs), shards=5, units=4, block_rows=40).collect()
    check(rows, docs, 5)
    assert shard_by_size(clashing(docs).limit(0)).collect() == []
    assert {r.shard for r in shard_by_size(clashing(docs), shards=1).collect()} == {0}
    with pytest.raises(ValueError):
        shard_by_size(clashing(docs), shards=0)


def test_longest_first():
    sizes = [("a", 7), ("b", 7), ("c", 6), ("d", 5), ("e", 4), ("f", 1)]
    # a and b open the shards; c joins the smaller index, d the other, e and f the lighter ones
    assert longest_first(sizes, 2) == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 1, "f": 0}
