"""What holds for any packing of given texts."""

import numpy as np

import public_tokenizers
from tokenizers import Tokenizer


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts, max_len=1024):
    """Every id of every document lies in one piece; sequences are gapless and within max_len."""
    tok = tokenizer()
    want = sorted((k, np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for k, t in texts)
    by_seq, by_doc = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and 1 <= r.length <= max_len
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
    got = []
    for k, parts in by_doc.items():
        parts.sort()
        data, at = b"", 0
        for start, ids, n in parts:
            assert start == at and n == sum(len(p[1]) for p in parts) // 4
            data, at = data + ids, at + len(ids) // 4
        got.append((k, data))
    assert sorted(got) == want
    total = 0
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= max_len
        total += max_len - at
    return total, len(by_seq)
