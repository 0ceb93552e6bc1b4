import inspect
import random

import numpy as np
import pytest
from nearfield.llm.components import components
from nearfield.llm.lsh_forest import forest_ties, least_depth, matched_paths, meeting, signatures
from nearfield.llm.ngram_join import drop_similar, join_similar, similar_sets
from nearfield.llm.queries import all_queries
from nearfield.llm.tiles import smallest_reachable

from truth_of_pairs import brute

SF = "/root/testdata/sf0.001"


def near_copies(rng, n, words=60, edits=2):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_query_on_the_given_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = all_queries()["op7_ngram_join"](spark, SF).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == brute(docs) and len(rows) == len(docs)
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_large_groups_lose_no_link(spark, docs_of, block_rows):
    rng = random.Random(11)
    texts = near_copies(rng, 120, words=120, edits=1) + near_copies(rng, 30, words=100, edits=1)
    texts += [texts[0]] * 20 + [" ".join(f"x{rng.randrange(10**6)}" for _ in range(40)) for _ in range(50)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    rows = join_similar(docs_of(docs), block_rows=block_rows).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == brute(docs)


def test_recall_at_the_threshold(spark, docs_of):
    rng = random.Random(12)
    docs, pairs = [], 0
    for g in range(300):  # pairs just above 0.8
        base = [f"g{g}w{i}" for i in range(204)]
        other = list(base)
        for at in rng.sample(range(10, 190, 10), 4):
            other[at] = f"z{g}{at}"
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
        pairs += 1
    rows = join_similar(docs_of(docs)).collect()
    assert sum(r.n_links for r in rows) / 2 >= 0.98 * pairs


def test_default_paths_miss_no_pair_of_thousands_at_the_threshold():
    default = {k: p.default for k, p in inspect.signature(join_similar).parameters.items()}
    tries, longest = default["tries"], default["max_depth"]
    depth = least_depth(0.8, tries, longest, default["target"])
    assert meeting(0.8, depth, tries) > 1 - 1e-5 > meeting(0.8, depth + 1, tries)
    with pytest.raises(ValueError):
        least_depth(0.8, 1, 8, 0.998)
    rng = np.random.default_rng(13)
    sets = []
    for _ in range(5000):  # 80 shingles of 100 in common
        every = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        sets += [np.sort(every[:90]), np.sort(np.concatenate([every[:80], every[90:]]))]
    paths = np.stack([np.frombuffer(x, "<u2") for x in signatures(sets, tries, longest)]).reshape(-1, tries, longest)[:, :, :depth]
    assert (paths[::2] == paths[1::2]).all(2).any(1).all()
    # the share of equal values estimates the similarity
    equal = np.mean([np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2") for a, b in zip(*[iter(signatures(sets[:400], tries, longest))] * 2)])
    assert abs(equal - 0.8) < 0.01


def nodes_of(spark, sets, tries=32, depth=8):
    sigs = signatures(sets, tries, depth)
    return spark.createDataFrame([(i.to_bytes(4, "big"), bytes(x)) for i, x in enumerate(sigs)], "node binary, sig binary").repartition(5)


def family(rng, n, size, shared):
    """``n`` sets of ``size`` hashes of which ``shared`` are common to all."""
    common = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
    return [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, size - shared, dtype=np.uint64)])) for _ in range(n)]


def test_matched_depths_equal_the_longest_common_prefixes(spark):
    rng = np.random.default_rng(2)
    sets = family(rng, 60, 100, 70) + family(rng, 40, 50, 10)
    nodes = nodes_of(spark, sets, 6, 5)
    got = {(r.trie, r.node): (r.path, r.depth) for r in matched_paths(nodes, 6, 5, 2).collect()}
    held = {r.node: np.frombuffer(r.sig, "<u2").reshape(6, 5) for r in nodes.collect()}
    for trie in range(6):
        for node, sig in held.items():
            longest = max(int(np.cumprod(sig[trie] == o[trie]).sum()) for k, o in held.items() if k != node)
            if longest >= 2:
                path, depth = got[trie, node]
                # rows at the edge of a partition count as matched in full
                assert path == sig[trie].astype("<u2").tobytes() and depth in (longest, 5)
    assert len(got) < 6 * 100


def test_prefixes_are_shortened_only_while_links_are_missing(spark):
    rng = np.random.default_rng(3)
    close, found = family(rng, 1200, 100, 97), {}
    forest_ties(nodes_of(spark, close), 0.8, 32, 8, 0.998, found)
    assert found["depth"] == 8 and found["recall"] >= 0.998
    border = [s for _ in range(150) for s in family(rng, 2, 100, 89)]  # pairs of about 0.8
    ties = forest_ties(nodes_of(spark, border), 0.8, 32, 8, 0.9999, found).collect()
    assert found["depth"] < 8 and found["recall"] >= 0.9999
    assert {tuple(sorted((r.a, r.b))) for r in ties} >= {((2 * i).to_bytes(4, "big"), (2 * i + 1).to_bytes(4, "big")) for i in range(150)}


def test_pages_of_a_template_are_neither_tied_nor_compared(spark):
    """A thousand pages at 0.3 to each other and some copies among them: ties for the copies alone."""
    rng = np.random.default_rng(4)
    pages = family(rng, 1000, 100, 46)
    copies = [np.unique(np.concatenate([p[:96], rng.integers(0, 1 << 63, 4, dtype=np.uint64)])) for p in pages[:20]]
    ties = forest_ties(nodes_of(spark, pages + copies), 0.8, 32, 8, 0.99999)
    got = {tuple(sorted((int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")))) for r in ties.collect()}
    assert got >= {(i, 1000 + i) for i in range(20)} and len(got) < 60


def test_strangers_behind_a_common_prefix_still_meet(spark):
    """One trie of one value: everything shares a prefix with strangers, and the leader is none of the pair's."""
    rng = np.random.default_rng(5)
    sets = [s for _ in range(40) for s in family(rng, 3, 60, 58)]
    sigs = [bytes(2) + x[2:] for x in signatures(sets, 1, 64)]  # the first value equal in all
    nodes = spark.createDataFrame([(i.to_bytes(4, "big"), x) for i, x in enumerate(sigs)], "node binary, sig binary")
    from nearfield.llm import lsh_forest as LF

    matched = LF.matched_paths(nodes, 1, 64, 1)
    pairs, ties = LF._ties_at(matched, nodes, 1, None, 0.5, 0.9, block_rows=32)
    tied = {(r.node, r.lead) for r in pairs.where("similarity >= 0.5").collect()} | {tuple(r) for r in ties.collect()}
    roots = {r.node: r.component for r in components(spark.createDataFrame(list(tied), "a binary, b binary")).collect()}
    assert all(len({roots[(3 * g + i).to_bytes(4, "big")] for i in range(3)}) == 1 for g in range(40)) and len(set(roots.values())) == 40


def test_odd_rows(spark, clashing):
    docs = [(1, None), (2, ""), (3, "?! ..."), (4, "two words"), (5, "Two WORDS!"), (6, "words two"), (7, "long " * 30_000),
            (None, "two words"), (8, "rep eat ed row here now"), (8, "rep eat ed row here now"), (None, "null id only"), (None, "null id only")]
    rows = join_similar(clashing(docs)).collect()
    assert len(rows) == len(docs)
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links, r.kept) for r in rows)
    assert got == [(0, 0, 1, False), (0, 0, 1, True), (0, 4, 2, False), (1, 1, 0, True), (2, 2, 0, True), (3, 3, 0, True), (4, 4, 2, True),
                   (5, 4, 2, False), (6, 6, 0, True), (7, 7, 0, True), (8, 8, 1, False), (8, 8, 1, True)]
    left = drop_similar(clashing(docs))
    assert left.columns == clashing(docs).columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
    assert join_similar(clashing(docs).limit(0)).collect() == [] and drop_similar(clashing(docs).limit(0)).collect() == []


def test_similar_sets_equals_set_arithmetic():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50).astype("<u8")) for _ in range(40)]
    for n in (2, 3, 40):
        got = similar_sets([s.tobytes() for s in sets[:n]], 0.5)
        want = [[len(set(a) & set(b)) >= 0.5 * len(set(a) | set(b)) - 1e-9 for b in map(list, sets[:n])] for a in map(list, sets[:n])]
        off = ~np.eye(n, dtype=bool)
        assert (got[off] == np.array(want)[off]).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, i) for i in range(1001, 1100)] + [(2000 + i, 2001 + i) for i in range(60)]
    edges += [(None, 3), (5, 5), (7, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    links = np.zeros((3000, 3000), bool)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            links[a, b] = links[b, a] = True
    want = smallest_reachable(links)
    assert got == {i: int(want[i]) for i in np.flatnonzero(links.any(1)).tolist()}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_where_no_leader_meets_a_stranger_nothing_more_is_written(spark, monkeypatch):
    from nearfield.llm import lsh_forest

    base = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    nodes = nodes_of(spark, [np.unique(np.delete(base, [i])) for i in range(20)])
    matched = lsh_forest.cut(matched_paths(nodes, 32, 8, 3))
    written, cut = [], lsh_forest.cut
    monkeypatch.setattr(lsh_forest, "cut", lambda df: (written.append(df.columns), cut(df))[1])
    pairs, others = lsh_forest._ties_at(matched, nodes, 8, None, 0.5, 0.8)
    assert pairs.count() and others is None
    assert len(written) == 3  # the leaders, who meets them, and how alike they are


def test_stars(spark):
    from nearfield.llm.components import _stars

    stars = lambda edges: _stars(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert stars([(2, 1), (3, 1), (5, 4)]) and stars([])
    assert not stars([(3, 1), (3, 2)]) and not stars([(3, 2), (2, 1)])
