import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from nearfield.llm.packing import Encoder, assign_pool, pack
from nearfield.llm.queries import all_queries

from truth_of_packing import check, tokenizer

SF = "/root/testdata/sf0.001"
SPECIALS = (("<|endoftext|>", 50256),)


def test_query_on_the_given_table(spark):
    tok = tokenizer()
    docs = dict((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = all_queries()["op1_packing"](spark, SF).collect()
    ids = {k: np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4") for k, t in docs.items()}
    seen = dict.fromkeys(docs, 0)
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
    assert seen == {k: len(v) for k, v in ids.items()}
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024 and sum(1024 - v for v in fill.values()) < 1024


def test_odd_rows(spark, clashing):
    rows = [(1, None), (2, ""), (3, "a b" * 3000), (4, "<|endoftext|> x"), (5, "\x00\r\n  é日本"), (6, " " * 5000)]
    assert check(pack(clashing(rows).coalesce(1), max_len=64, pool_tokens=64).collect(), rows, 64)[0] < 64
    assert pack(clashing(rows).limit(0)).collect() == []
    twice = pack(clashing([(None, "same text"), (None, "same text")]).coalesce(1)).collect()
    assert [r.doc_id for r in twice] == [None, None] and len({r.offset for r in twice}) == 2


def test_rank_file_agrees_with_the_tokenizer_on_every_character():
    tok, enc = tokenizer(), Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), SPECIALS, public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a" + chr(c) + chr(c) + " " + chr(c) + "1" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts += ["<|endoftext|><|endoftext|> a", "it's I'LL  \n\n x\t　y "]
    texts += [" " * 1_000_000 + "x", "\n" * 300_000, "a" * 300_000]
    assert [enc.encode(t) for t in texts] == [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40), st.booleans())
def test_pool_places_every_id_once(lengths, last):
    total = sum(lengths)
    n = -(-total // 16) if last else total // 16
    placed, left = assign_pool(lengths, n, 16)
    fill = [0] * n
    for piece, start, length, to, off in placed:
        assert off == fill[to]
        fill[to] += length
    parts = sorted([p[:3] for p in placed] + left)
    assert sum(p[2] for p in parts) == total
    assert not left if last else all(f == 16 for f in fill)


def test_descending_pieces_go_to_the_cheapest_sequence_with_room():
    placed, left = assign_pool([3, 9, 8, 7], 2, 16, linear=1.0, quadratic=1.0)
    assert not left
    # 9 (cost 90) opens sequence 0, 8 (72) sequence 1, 7 joins 1 (the cheaper), and 3 joins 0 (90 < 128)
    assert [(p[0], p[3]) for p in placed] == [(1, 0), (2, 1), (3, 1), (0, 0)]


def test_bad_length(docs_of):
    with pytest.raises(ValueError):
        pack(docs_of([(1, "a")]), max_len=0)
