import hashlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.llm.merkle import append_log, build, fold, leaf_digest, level_sizes, log, postorder, proofs, segment_proofs, verify
from nearfield.llm.queries import OP11_SQL, all_queries

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves, arity):
    """Levels of hex digests, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + arity])) for i in range(0, len(now), arity)])
    return levels


def proof(levels, index, arity):
    out = []
    for nodes in levels[:-1]:
        first = index // arity * arity
        out += [d for i, d in enumerate(nodes[first : first + arity], first) if i != index]
        index //= arity
    return out


def completion_order(levels, arity):
    """(level, index) of all nodes as a depth-first walk leaves them."""

    def walk(level, index):
        if level:
            for child in range(index * arity, min((index + 1) * arity, len(levels[level - 1]))):
                yield from walk(level - 1, child)
        yield level, index

    return list(walk(len(levels) - 1, 0))


def brute(rows, arity=8):
    """Per row (in order) part, leaf, subroot, root and proof, by the plainest means."""
    parts = defaultdict(list)
    for k, (part, key, leaf) in enumerate(rows):
        parts[part].append((key is not None, key or 0, leaf, k))
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {p: tree([leaf for *_, leaf, _ in sorted(parts[p])], arity) for p in names}
    top = tree([trees[p][-1][0] for p in names], arity)
    out = {}
    for place, p in enumerate(names):
        for i, (*_, leaf, k) in enumerate(sorted(parts[p])):
            out[k] = (p, leaf, trees[p][-1][0], top[-1][0], proof(trees[p], i, arity) + proof(top, place, arity))
    return [out[k] for k in range(len(rows))]


def read(manifest):
    return verify(proofs(manifest), arity=manifest.arity).collect()


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    rel = con.sql(OP11_SQL)
    df = all_queries()["op11_merkle"](spark, SF)
    assert df.columns == rel.columns and sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


@given(st.integers(1, 700), st.sampled_from([2, 3, 8]))
@settings(max_examples=40, deadline=None)
def test_positions_in_closed_form(n, arity):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    levels = tree([d.hex() for d in leaves], arity)
    assert [len(x) for x in levels] == level_sizes(n, arity)
    order = completion_order(levels, arity)
    assert [postorder(level, i, n, arity) for level, i in order] == list(range(len(order)))
    nodes = append_log(leaves, len(levels) - 1, arity)
    assert [nodes[32 * k : 32 * k + 32].hex() for k in range(len(order))] == [levels[level][i] for level, i in order]
    for i, own in enumerate(segment_proofs(nodes, n, len(levels) - 1, arity, b"")):
        assert own.hex() == "".join(proof(levels, i, arity))
        assert fold(leaves[i], own, i, n, arity) == (bytes.fromhex(levels[-1][0]), b"")


@pytest.mark.parametrize("arity, levels", [(2, 1), (2, 3), (3, 2), (8, 3)])
def test_rounds_of_small_builders_equal_brute_force(spark, arity, levels):
    # parts of one node, one run, one builder and many rounds
    sizes = {None: 1, "": 3, "a": arity**levels, "b": arity**levels + 1, "c": 40, "é": 2}
    rows = [(p, k, f"{p} {k}") for p, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "lang string, doc_id bigint, text string").repartition(7)
    leaf = leaf_digest("doc_id", "text").alias("leaf")
    manifest = build(docs.select("lang", "doc_id", leaf), arity=arity, levels=levels)
    text = lambda k, t: sha(f"{len(str(k))}:{k}{len(t.encode())}:{t}")
    plain = [(p, k, text(k, t)) for p, k, t in rows]
    want = {(w[0], w[1]): w[2:] for w in brute(plain, arity)}
    got = read(manifest)
    assert len(got) == len(rows)
    for r in got:
        subroot, root, path = want[r.part, r.leaf.hex()]
        assert (r.subroot.hex(), manifest.root.hex(), r.siblings.hex()) == (subroot, root, "".join(path))
        assert r.folded_root == manifest.root
    written = defaultdict(dict)
    for r in log(manifest).collect():
        assert r.position not in written[r.part]
        written[r.part][r.position] = (r.level, r["index"], r.digest.hex())
    for part, nodes in written.items():
        levels_ = tree([leaf for p, _, leaf in plain if p == part], arity)
        assert [nodes[k] for k in range(len(nodes))] == [(lv, i, levels_[lv][i]) for lv, i in completion_order(levels_, arity)]


def test_changed_rows_fail(spark):
    rows = spark.createDataFrame([(i, "x", f"Text {i}") for i in range(40)], "doc_id bigint, lang string, text string")
    manifest = build(rows.select("doc_id", "lang", leaf_digest("doc_id", "text").alias("leaf")))
    other = rows.select("doc_id", "lang", leaf_digest("doc_id", "lang").alias("leaf"))
    assert build(other).root != manifest.root
    given = proofs(manifest).withColumnRenamed("id", "doc_id").join(other.select("doc_id", F.col("leaf").alias("shown")), "doc_id")
    assert not any(r.folded_root == manifest.root for r in verify(given, "shown").collect())


def test_odd_rows(spark, clashing, docs_of):
    rows = [(None, "no id"), (None, None), (3, ""), (3, ""), (3, "other"), (5, "x" * 300_000), (6, None)] + [(9, "copy")] * 30
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    df = clashing(rows).select("*", leaf_digest(*fields).alias("leaf"))
    manifest = build(df, levels=1)

    def text(k, t):
        values = [k, "s", "en", len(t or ""), t]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    want = sorted((w[1], w[2], w[3], "".join(w[4])) for w in brute([("en", k, text(k, t)) for k, t in rows]))
    got = read(manifest)
    assert sorted((r.leaf.hex(), r.subroot.hex(), manifest.root.hex(), r.siblings.hex()) for r in got) == want
    assert all(r.folded_root == manifest.root for r in got)
    empty = build(docs_of([]).select("*", leaf_digest(*fields).alias("leaf")))
    assert empty.root is None and read(empty) == [] and log(empty).collect() == []
    one = build(docs_of([(1, "alone")]).select("*", leaf_digest(*fields).alias("leaf")))
    assert [(r.siblings, r.leaf, r.folded_root) for r in read(one)] == [(b"", one.root, one.root)]


def test_query_on_nulls_and_an_empty_table(spark, docs_of, scratch_dir):
    odd = docs_of([(1, "A"), (2, None), (None, "B"), (2, "Ab"), (2, "aB")]).unionByName(docs_of([(7, "C")]).selectExpr(
        "doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "n_chars"))
    for name, docs in (("odd", odd), ("none", docs_of([]))):
        docs.write.parquet(f"{scratch_dir}/{name}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{scratch_dir}/{name}/documents.parquet/*.parquet')")
        got = all_queries()["op11_merkle"](spark, f"{scratch_dir}/{name}")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.sql(OP11_SQL).fetchall(), key=repr)
