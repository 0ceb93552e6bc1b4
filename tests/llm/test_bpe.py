import array
import hashlib
import json

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from nearfield.llm.bpe import TrieBpe, encode_decode
from nearfield.llm.queries import all_queries
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
OWN, LIB = TrieBpe(PATH, cache_entries=500), Tokenizer.from_file(PATH)


def library(text):
    ids = LIB.encode(text or "", add_special_tokens=False).ids
    return array.array("I", ids).tobytes(), LIB.decode(ids, skip_special_tokens=False)


def test_query_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in all_queries()["op10_bpe"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids, text = library(d.text)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) // 4
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark, clashing):
    rows = [(1, None), (2, ""), (3, "x" * 9000), (4, "a<|endoftext|>b <|startoftext|>"), (5, "\x00\x7f É ΣΑΣ 日本"),
            (None, "it's 'S I'LL"), (None, "it's 'S I'LL")]
    got = sorted((r.doc_id or 0, bytes(r.ids), r.decoded) for r in encode_decode(clashing(rows)).collect())
    assert got == sorted((k or 0, *library(t)) for k, t in rows)
    assert encode_decode(clashing(rows).limit(0)).collect() == []


def test_every_character():
    texts = ["a" + chr(c) + " " + chr(c) + chr(c) + "1" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    assert OWN.encode_texts(texts) == [library(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("abcdeinthronsə' .<|>\n", max_size=40)), max_size=8))
def test_random_texts(texts):
    assert OWN.encode_texts(texts) == [library(t) for t in texts]


def test_shared_prefixes_are_walked_once():
    bpe = TrieBpe(PATH)
    words = {"thing", "things", "thingness", "thin"}
    got = bpe.encode_words(words)
    assert got == {w: LIB.encode(w, add_special_tokens=False).ids for w in words}


def changed(tmp_path, **parts):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f) | parts
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    return path


def test_another_file_decides_on_case_and_splitting(tmp_path):
    assert OWN.latin
    texts = ["It's 2024, THE end", "a1b22 c", "É <|endoftext|> x", "two  blanks\n\tmore"]
    digits = [{"type": "Split", "pattern": {"Regex": "[a-z]+|[0-9]+|[^\\sa-z0-9]+"}, "behavior": "Removed", "invert": True},
              {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    for parts in ({"pre_tokenizer": {"type": "Sequence", "pretokenizers": digits}}, {"normalizer": None}, {"normalizer": {"type": "NFC"}}):
        path = changed(tmp_path, **parts)
        own, lib = TrieBpe(path), Tokenizer.from_file(path)
        assert not own.latin
        for t, (ids, _) in zip(texts, own.encode_texts(texts)):
            assert array.array("I", ids).tolist() == lib.encode(t, add_special_tokens=False).ids, (parts, t)


def test_files_that_ask_for_more_are_refused(tmp_path):
    for parts in ({"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}):
        with pytest.raises(ValueError):
            TrieBpe(changed(tmp_path, **parts))
