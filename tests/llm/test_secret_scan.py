import hashlib
import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from nearfield.llm.queries import all_queries
import public_tokenizers
from nearfield.llm.secret_scan import Novelty, find_secrets, known_stretches, novel_spans, pattern_spans, vocabulary_words

SF = "/root/testdata/sf0.001"


def brute(text):
    """The three kinds as their definition words them, without any shortcut."""
    names = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(names + r"""["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(a, b, k) for a, _, b, k in sorted(out)]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def test_query_on_the_given_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in all_queries()["op2_secrets"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        base, r = brute(text), got[k]
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == kind for s in base) for kind in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s and not s.startswith("novel")] == [f"{k}:{a}:{b}" for a, b, k in base]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "SECRET", "Api_Key", "apikey", "passwd", "password", "ſecret", "toKen", "=", ":", " ", "'", '"', "\n",
                                 "abcdef012345", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é😀", "x.y-z/+_=" * 2]), max_size=14))
def test_patterns_equal_their_definition(parts):
    text = "".join(parts)
    order = ("assign", "access", "hex")
    assert sorted(pattern_spans(text), key=lambda s: (s[0], order.index(s[2]))) == brute(text)


def test_novelty_reports_random_keys_and_leaves_prose():
    rng = random.Random(5)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    n = Novelty()
    assert n.share(key, "authorization bearer ", " and more") > 0.8
    assert n.share("abcdefghijklmnopqrstuvwxyz0123456789", "token ", "") < 0.5  # in the dictionary
    assert n.share(key, f"credential {key} again ", "") < 0.5  # a repetition of its surroundings


def random_keys(alphabet, n, count=20):
    rng = random.Random(f"{alphabet}{n}")
    return ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(count)]


@pytest.mark.parametrize("alphabet", ["0123456789ABCDEF", string.ascii_uppercase + "234567", string.digits + string.ascii_lowercase,
                                      string.ascii_letters + string.digits + "+/"])
def test_long_keys_of_small_alphabets_are_reported(alphabet):
    prose = "the stone walked under morning light near old houses with many people " * 20
    for n in (64, 128, 200, 400, 1000, 4000):
        for key in random_keys(alphabet, n):
            text = f"{prose}authorization: Bearer {key} {prose}"
            at = text.index(key)
            assert novel_spans(text, [], Novelty(), 0.8, 20, 48, 1024) == [(at, at + n, "novel")]
    for plain in ("abc123" * 100, "a" * 500 + "1", "0123456789abcdefghijklmnopqrstuvwxyz" * 5):
        assert novel_spans(f"{prose}authorization: Bearer {plain} {prose}", [], Novelty(), 0.8, 20, 48, 1024) == []


def test_repeated_keys_are_reported_at_every_place():
    prose = "the stone walked under morning light near old houses with many people " * 20
    for n in (24, 40, 100, 1500):
        for key in random_keys(string.ascii_letters + string.digits, n):
            for text in (f"{prose}Authorization: Bearer {key}\nAuthorization: Bearer {key}\n{prose}",
                         f"access_key={key}\ncredential {key} {key}", f"bearer {key} {prose[:980]} signature: {key}",
                         f"{prose}bearer user={key}\n" + f"# {key} " * 3 + f"\nbearer user={key}"):
                at = {m.start() for m in re.finditer(key, text) if any(w in text[max(0, m.start() - 16) : m.start()].lower() for w in ("bearer", "access_key", "credential", "signature"))}
                got = novel_spans(text, [], Novelty(), 0.8, 20, 48, 1024)
                assert len(at) >= 2 and all(any(a <= x and b >= x + n for a, b, _ in got) for x in at)
    assert novel_spans("token 0123456789abcdefghij token 0123456789abcdefghij", [], Novelty(), 0.8, 20, 48, 1024) == []


def test_keys_around_a_hex_run_and_after_hyphen_words_are_reported():
    for one, two in zip(random_keys("GHIJKLMNPQRSTUVWXYZghijkmnpqrstuvwxyz23456789", 20), random_keys("GHJKLMNPQRSTUVWXYZghjkmnpqrstuvwxyz23456789", 20)):
        key = one + "0123456789abcdef"[::-1] + two
        text = f"walked Bearer {key} there"
        covered = pattern_spans(text)
        assert [k for *_, k in covered] == ["hex"]
        assert novel_spans(text, covered, Novelty(), 0.8, 20, 48, 1024) == [(14, 14 + len(key), "novel")]
        assert novel_spans(f"X-Api-Key: {one}{two} there", [], Novelty(), 0.8, 20, 48, 1024) == [(11, 11 + len(one + two), "novel")]
    whole = "bearer " + hashlib.sha256(b"x").hexdigest()
    assert novel_spans(whole, pattern_spans(whole), Novelty(), 0.8, 20, 48, 1024) == []


WORDS = ("user account session payment invoice customer order shipping address history window garden river castle winter summer report "
         "overview authentication settings profile password email message image gallery index archive release candidate server client "
         "request response header cookie cache buffer thread worker queue schedule calendar language translation country population "
         "culture music popular science physics chemistry biology medicine university library museum national international").split()


def ordinary_strings(rng, n):
    """Names, paths, slugs, UUIDs and times as text and code have them, each with letters and digits."""
    out = []
    while len(out) < n:
        w = [rng.choice(WORDS) for _ in range(rng.randrange(3, 7))]
        year, number = rng.randrange(1900, 2030), rng.randrange(1, 400)
        kind = len(out) % 10
        out.append((
            "_".join(w) + f"_{number}", w[0] + "".join(x.title() for x in w[1:]) + str(number), "".join(x.title() for x in w) + f"V{number % 9}",
            "_".join(w).upper() + f"_{number}", f"{year}-{number % 12 + 1:02}-" + "-".join(w), f"/{w[0]}/{year}/{number % 12 + 1:02}/" + "-".join(w[1:]),
            "wiki/" + "_".join(x.title() for x in w) + f"_{year}", f"get_{w[0]}_by_id_and_{w[1]}_v2", "-".join(w) + f"-v{number}",
            "-".join("%0*x" % (k, rng.getrandbits(4 * k)) for k in (8, 4, 4, 4, 12)),
        )[kind])
    return [x for x in out if len(x) >= 20 and any(c.isdigit() for c in x) and any(c.isalpha() for c in x)]


PROSE = "the stone walked under morning light near old houses with many people " * 20


@pytest.fixture(scope="module")
def measure():
    return Novelty(words=vocabulary_words(public_tokenizers.path("byte_bpe_50k.json")))


def reported(value, measure, lead="the signature "):
    text = f"{PROSE}{lead}{value} {PROSE}"
    return novel_spans(text, pattern_spans(text), measure, 0.8, 20, 48, 1024) != []


def test_ordinary_strings_after_sensitive_words_are_left(measure):
    """At most one in a hundred of names, paths, slugs, UUIDs and times is taken for a key."""
    strings = ordinary_strings(random.Random(8), 700)
    wrong = [x for x in strings if reported(x, measure)]
    assert len(strings) > 500 and len(wrong) <= 0.01 * len(strings), wrong
    for x in ("get_user_by_id_and_name_v2", "com/guides/2024/authentication-overview", "Chapter-12-the-old-house-on-the-hill",
              "/wiki/Garden_of_Eden_in_popular_culture_2019", "2024-01-15T10-30-00", "MAX_CONNECTIONS_PER_HOST_2", "parseHttpResponseHeader2"):
        assert not reported(x, measure)


@pytest.mark.parametrize("alphabet", ["0123456789ABCDEF", string.ascii_uppercase + "234567", string.digits + string.ascii_lowercase,
                                      string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"])
def test_random_keys_of_every_alphabet_are_reported(measure, alphabet):
    for n, least in ((20, 90), (24, 95), (32, 98), (64, 99), (300, 99)):
        keys = [k for k in random_keys(alphabet, n, 100) if any(c.isdigit() for c in k) and any(c.isalpha() for c in k)]
        assert sum(reported(k, measure, "Authorization: Bearer ") for k in keys) >= least / 100 * len(keys), n


def test_known_stretches(measure):
    w = frozenset(["garden", "eden", "http", "server"])
    for value, known in (("Garden_of_Eden_2019", "Garden_of_Eden_2019"), ("xqzt_gardenEden/v2-qqqq", "_gardenEden/v2-"), ("HTTPServer123456789012", "HTTPServer"),
                         ("550e8400-e29b-41d4-a716-446655440000", "550e8400-e29b-41d4-a716-446655440000")):
        assert [value[a:b] for a, b in known_stretches(value, w)] == [known]
    assert known_stretches("----////====", w) == [] and known_stretches("", w) == [] and known_stretches("qzx7gq0", w) == []
    assert 20_000 < len(measure.words) and {"garden", "authentication"} <= measure.words and "of" not in measure.words


def test_the_measure_runs_on_a_table(spark, docs_of):
    """Planted keys are masked, planted names stay, through the operator."""
    rng = random.Random(9)
    names = ordinary_strings(rng, 150)
    keys = random_keys(string.ascii_letters + string.digits, 40, 120)
    rows = [(i, f"{PROSE[:300]}credential {x} {PROSE[:300]}") for i, x in enumerate(names + keys)]
    got = {r.doc_id: r for r in find_secrets(docs_of(rows)).collect()}
    masked = [i for i, r in got.items() if any(s.kind == "novel" for s in r.spans)]
    assert sum(i < len(names) for i in masked) <= 1 and sum(i >= len(names) for i in masked) >= 118
    assert all(got[i].masked == t.replace(keys[i - len(names)], "[SECRET]") for i, t in rows if i in masked and i >= len(names))


def test_odd_rows(spark, clashing):
    rng = random.Random(6)
    key = "".join(rng.choice("GHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    rows = [(1, None), (2, ""), (3, "a" * 50_000), (4, f"Authorization: Bearer {key} ok"), (5, "é token = 'abcdef0123456789abcdef' x"),
            (6, "the bearer of thistles walked thirteen long miles"), (None, "AKIA" + "A1" * 8), (None, "AKIA" + "A1" * 8)]
    got = sorted(find_secrets(clashing(rows)).collect(), key=lambda r: r.doc_id or 0)
    spans = [(r.doc_id, [(s.start, s.end, s.kind) for s in r.spans]) for r in got]
    assert spans == [(None, [(0, 20, "access")]), (None, [(0, 20, "access")]), (1, []), (2, []), (3, [(0, 50_000, "hex")]),
                     (4, [(22, 62, "novel")]), (5, [(2, 33, "assign"), (11, 33, "hex")]), (6, [])]
    masked = {r.doc_id: r.masked for r in got}
    assert masked[1] is None and masked[4] == "Authorization: Bearer [SECRET] ok" and masked[5] == "é [SECRET]' x"
    assert find_secrets(clashing(rows).limit(0)).collect() == []


def test_dense_words_and_long_runs_cost_linear_time():
    import time

    from nearfield.llm.secret_scan import novel_spans

    began = time.time()
    words = frozenset(["garden", "eden"])
    for text in ("token garden-" + "garden-eden1/" * 80_000, "token garden-" + "garden-edenxq1/" * 60_000, "token " * 200_000, "secret " + "g" * 1_000_000, "bearer=" * 100_000, "password" + " " * 1_000_000):
        covered = pattern_spans(text)
        novel_spans(text, covered, Novelty(words=words), 0.8, 20, 48, 1024)
    assert time.time() - began < 30
