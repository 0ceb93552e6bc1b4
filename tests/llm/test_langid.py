import inspect
import math
import random
import zlib

import numpy as np
from nearfield.llm.langid import MixtureModel, _letters, distinct_counts, identify, learn, row_quota, trigrams
from nearfield.llm.queries import all_queries

SF = "/root/testdata/sf0.01"
SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["zus", "tre", "von"], "cc": ["ñu", "éx", "ço"]}


def text_of(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_query_on_the_given_table(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = all_queries()["op8_language"](spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_mixtures_and_odd_rows(spark, docs_of):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [(i, text_of(lang, 40, rng), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    learned = docs_of([(k, t) for k, t, _ in rows]).drop("lang").join(spark.createDataFrame([(k, l) for k, _, l in rows], "doc_id bigint, lang string"), "doc_id")
    learned = learned.unionByName(docs_of([(900, None), (901, "x")]).withColumn("lang", F.lit(None).cast("string")))
    model = learn(learned)
    assert model.languages == sorted(SYLLABLES)
    mixed = text_of("aa", 70, rng) + " " + text_of("bb", 30, rng)
    asked = [(1, None), (2, ""), (3, "12 + 3 = 15!"), (4, mixed), (5, text_of("cc", 30, rng)), (6, text_of("bb", 40_000, rng)), (None, "ka lo"), (None, "ka lo")]
    got = sorted(identify(docs_of(asked).withColumns({c: F.lit("x") for c in ("score", "id", "lang_pred", "languages")}), model).collect(), key=lambda r: r.doc_id or 0)
    assert [r.lang_pred for r in got] == ["aa", "aa", "und", "und", "und", "aa", "cc", "bb"]
    two = {s.lang: s.share for s in got[5].languages}
    assert set(two) == {"aa", "bb"} and 0.6 < two["aa"] < 0.8 and abs(got[5].score - two["aa"]) < 1e-9
    assert [s.lang for s in got[6].languages] == ["cc"]
    assert identify(docs_of(asked).limit(0), model).collect() == []
    nothing = learn(learned.where("lang is null"))
    assert nothing is None and {r.lang_pred for r in identify(docs_of(asked), nothing).collect()} == {"und"}


def test_trigrams():
    letters = _letters()
    assert len(trigrams("ab", 1 << 16, letters)) == 2 and len(trigrams("A 1 b", 1 << 16, letters)) == 2
    assert (trigrams("Ab", 1 << 16, letters) == trigrams("aB", 1 << 16, letters)).all() and len(trigrams(" 1!", 1 << 16, letters)) == 0
    long = trigrams("abcdefgh" * 1000, 1 << 16, letters)
    for part in (long, long[:100]):
        which, counts = distinct_counts(part, 1 << 16)
        assert counts.sum() == len(part) and (np.sort(which) == which).all()


def test_expectation_maximisation_recovers_known_shares():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 100, (500, 3)).astype(float) * (rng.random((500, 3)) < 0.2)
    model = MixtureModel(["a", "b", "c"], counts)
    drawn = np.concatenate([rng.choice(500, 700, p=model.likelihood[:, 0]), rng.choice(500, 300, p=model.likelihood[:, 2])])
    shares = model.infer([distinct_counts(drawn, 500)], 50, 3, 4.0)[0]
    assert abs(shares[0] - 0.7) < 0.05 and abs(shares[2] - 0.3) < 0.05 and shares[1] < 0.02


def test_sets_of_more_than_three_languages():
    rng = np.random.default_rng(2)
    names = list("abcdef")
    counts = rng.integers(1, 100, (800, 6)).astype(float) * (rng.random((800, 6)) < 0.2)
    model = MixtureModel(names, counts)
    default = inspect.signature(identify).parameters["max_languages"].default
    drawn = [np.concatenate([rng.choice(800, 400, p=model.likelihood[:, j]) for j in range(k)]) for k in (5, 1, 4, 2, 6)]
    shares = model.infer([distinct_counts(d, 800) for d in drawn], 50, default, 4.0)
    for own, k in zip(shares, (5, 1, 4, 2, 6)):
        assert np.flatnonzero(own).tolist() == list(range(k)) and np.abs(own[:k] - 1 / k).max() < 0.06
    alone = [model.infer([distinct_counts(d, 800)], 50, default, 4.0)[0] for d in drawn]
    assert np.allclose(alone, shares)


def test_rare_languages_keep_their_rows_in_a_bounded_sample(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, text_of("aa", 3, rng), "aa") for i in range(4000)] + [(4000 + i, text_of("bb", 3, rng), "bb") for i in range(20)]
    rows += [(5000 + i, text_of("cc", 3, rng), "cc") for i in range(2)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = learn(labelled, max_rows=200)
    assert model.languages == ["aa", "bb", "cc"]  # two rows are enough
    assert learn(labelled, max_rows=200, min_docs=3).languages == ["aa", "bb"]
    every = learn(labelled, max_rows=10_000)
    assert (model.counts[:, 2] == every.counts[:, 2]).all()
    assert (model.counts[:, 1] == every.counts[:, 1]).all()
    assert 0.02 < model.counts[:, 0].sum() / every.counts[:, 0].sum() < 0.08
    assert learn(labelled.where("lang = 'cc'")).languages == ["cc"]
    assert [row_quota(r, 200) for r in ([4000, 20], [50, 60], [4000, 4000, 10], [], [200])] == [180, 60, 95, 0, 200]


def test_a_language_of_one_row_takes_its_texts_and_no_others(spark, docs_of):
    rng = random.Random(5)
    rows = [(i, text_of("aa", 60, rng), "aa") for i in range(300)] + [(900, text_of("cc", 60, rng), "cc")]
    model = learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    asked = {1: text_of("cc", 30, rng), 2: text_of("aa", 30, rng), 3: text_of("aa", 20, rng) + " qwy fgh wrj ptk", 4: "日本語の文章 " + text_of("aa", 6, rng)}
    got = {r.doc_id: r.lang_pred for r in identify(docs_of(list(asked.items())), model).collect()}
    assert got == {1: "cc", 2: "aa", 3: "aa", 4: "aa"}


def test_many_languages_stay_sparse():
    rng = np.random.default_rng(4)
    names = [f"l{i:04}" for i in range(1500)]
    grams = rng.integers(0, 1 << 16, (1500, 60))
    seen = (1 << 16, grams.ravel(), np.repeat(np.arange(1500), 60), np.ones(grams.size))
    model = MixtureModel(names, seen)
    assert sum(a.nbytes for a in (model.first, model.lang, model.part)) < 4 << 20  # the whole matrix takes 786 MB
    docs = [distinct_counts(np.repeat(grams[i], 3), 1 << 16) for i in (7, 1400, 3, 99)]
    cuts = list(model.portions(docs, 60 * 1500 * 8 * 2 + 1))
    assert cuts == [(0, 2), (2, 4)] and list(model.portions(docs, 1)) == [(i, i + 1) for i in range(4)] and list(model.portions([], 1)) == []
    found = np.concatenate([model.infer(docs[a:b], 8, None, 4.0) for a, b in cuts])
    assert found.argmax(1).tolist() == [7, 1400, 3, 99]


def brute_shares(grams, counts, rounds, penalty):
    """The mixture as the docstring states it, a loop over one document's trigrams, every set size tried."""
    buckets, n = counts.shape
    like = [[0.99 * counts[g][j] / sum(counts[h][j] for h in range(buckets)) + 0.01 / buckets for j in range(n)] for g in grams]

    def em(shares, rounds):
        for _ in range(rounds):
            new = [0.0] * n
            for row in like:
                whole = sum(p * s for p, s in zip(row, shares))
                for j in range(n):
                    new[j] += row[j] * shares[j] / whole / len(like)
            shares = new
        return shares, sum(math.log(sum(p * s for p, s in zip(row, shares))) for row in like)

    full, _ = em([1.0 / n] * n, rounds)
    order = sorted(range(n), key=lambda j: (-full[j], j))
    best, chosen = -math.inf, None
    for k in range(1, n + 1):
        start = [max(full[j], 1e-6) if j in order[:k] else 0.0 for j in range(n)]
        shares, fit = em([s / sum(start) for s in start], rounds if k > 1 else 0)
        value = fit - penalty * (k - 1) * math.log(len(like) + 1)
        if value > best:
            best, chosen = value, shares
    return chosen


def test_inference_equals_brute_force():
    rng = np.random.default_rng(6)
    counts = rng.integers(1, 60, (90, 4)) * (rng.random((90, 4)) < 0.4)
    model = MixtureModel(list("abcd"), counts.astype(float))
    drawn = []
    for i in range(40):
        mix = rng.dirichlet([0.4] * 4)
        p = model.likelihood @ mix
        drawn.append(rng.choice(90, int(rng.integers(1, 250)), p=p / p.sum()))
    got = model.infer([distinct_counts(d, 90) for d in drawn], 8, None, 4.0)
    want = np.array([brute_shares(d.tolist(), counts, 8, 4.0) for d in drawn])
    assert np.allclose(got, want, atol=1e-9) and len({tuple(w > 0) for w in want}) > 3
