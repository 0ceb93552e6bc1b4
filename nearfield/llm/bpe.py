"""BPE encoding and decoding by depth-first traversal of a trie of distinct words.

A word's BPE encoding is determined by the last token of each of its
prefixes: the encoding of a prefix is the encoding of the prefix without its
last token, followed by that token, and a token may follow another exactly
when merging the two tokens' symbols gives the two tokens back. So the last
token of a prefix is found from the last tokens of shorter prefixes alone,
and two words share all of that work up to where they part.

The distinct new words of a batch, sorted, are their trie in depth-first
order: going from one word to the next returns to the node of their common
prefix. The stack of last-token states along the current path is kept, and
only the characters below that node are computed. Whole words end with the
tokenizer's end mark, a terminal edge of its own.

A document is the concatenation of its words' ids. Words are remembered per
Python worker up to ``cache_entries`` (more only while one batch has more
distinct words); past that the memory is cleared, which costs time only.

Normalisation, word splitting and special tokens follow the tokenizer file; a
file that asks for more than is built here (another decoder, a prefix space,
special tokens that take spaces along) raises ``ValueError``. A faster splitter
for texts up to U+017F is used only with the normaliser and pre-tokenizer that
it restates. Null text counts as empty (no ids, empty decoded text). Very long
texts are encoded whole, a word of n characters in time n times the longest
token. There are no ties: one encoding is valid. Repeated rows are encoded each time. Null ids are carried, an empty table gives an empty
result, other columns are ignored. No shuffle.
"""

from __future__ import annotations

import array
import json
import re
import unicodedata

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nearfield.llm.common import per_process, slices


class TrieBpe:
    """Encoder and decoder of a word-level BPE tokenizer file with an end-of-word mark."""

    def __init__(self, path: str, cache_entries: int = 300_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["continuing_subword_prefix"] or model["byte_fallback"] or model["dropout"]:
            raise ValueError("a plain BPE model with an end-of-word suffix is needed")
        pre = spec["pre_tokenizer"] or {}
        last = pre.get("pretokenizers", [pre])[-1]
        if last.get("type") != "ByteLevel" or last["add_prefix_space"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError("a byte-level pre-tokenizer without a prefix space, and no decoder or post-processor, is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that stand for themselves alone are needed")
        self.latin = (spec["normalizer"], pre) == (_NORMALIZER, _PRE_TOKENIZER)
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.names = {i: s for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: s for s, i in self.special.items()})
        self.special_rx = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.rank = {tuple(m): i for i, m in enumerate(map(tuple, model["merges"]))}
        self.own = Tokenizer.from_file(path)
        self.byte_char = dict(zip(range(256), _byte_chars()))
        self.follows: dict[tuple[str, str], bool] = {}
        self.cache_entries = cache_entries
        self.words: dict[str | int, tuple[bytes, str]] = {}

    # -- merges -------------------------------------------------------------

    def symbols(self, token: str) -> list[str]:
        """A token's characters; the end mark belongs to the last one."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            head = token[: -len(self.end)]
            return [*head[:-1], head[-1] + self.end]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """Plain BPE: apply the best-ranked merge, leftmost first, until none is left."""
        parts, none = list(parts), len(self.rank)
        while len(parts) > 1:
            ranks = [self.rank.get(pair, none) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        """Whether ``right`` can stand after ``left`` in an encoding ("" is the start of a word)."""
        key = (left, right)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 4 * self.cache_entries:
                self.follows.clear()
            parts = (self.symbols(left) if left else []) + self.symbols(right)
            known = self.follows[key] = self.merged(parts) == ([left, right] if left else [right])
        return known

    # -- trie ---------------------------------------------------------------

    def encode_words(self, words) -> dict[str, list[int]]:
        """Ids of distinct words in byte characters (no end mark), by depth-first trie traversal."""
        vocab, follows, may_follow, mark, drop = self.vocab, self.follows, self.may_follow, self.end, len(self.end)
        out = {}
        path, last = "", [""]  # the current trie path and the last token of each of its prefixes
        for word in sorted(words):
            n = len(word)
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for upto in range(len(last), n + 1):
                end = mark if upto == n else ""  # the terminal edge: the last character carries the mark
                at = upto
                while at:  # exactly one token is valid here, so the order of trial does not matter
                    at -= 1
                    token = word[at:upto] + end
                    if token in vocab:
                        known = follows.get((last[at], token))
                        if known or (known is None and may_follow(last[at], token)):
                            break
                else:
                    raise ValueError(f"no encoding of {word!r}: a symbol is not in the vocabulary")
                if upto < n:
                    last.append(token)
            path = word[: n - 1]
            ids, at = [vocab[token]], n - len(token) + drop
            while at:
                token = last[at]
                ids.append(vocab[token])
                at -= len(token)
            ids.reverse()
            out[word] = ids
        return out

    # -- texts --------------------------------------------------------------

    def split_words(self, text: str) -> list[str | int]:
        """A text's words after the tokenizer's normalisation; special tokens as their ids."""
        if any(s in text for s in self.special):
            out: list[str | int] = []
            for part in self.special_rx.split(text):
                out += [self.special[part]] if part in self.special else self.split_plain(part)
            return out
        return self.split_plain(text)

    def split_plain(self, text: str) -> list[str]:
        if self.latin and _LATER.search(text) is None:  # every character is composed and its class and case are the same everywhere
            return _LATIN_WORDS.findall(text.lower())
        if self.own.normalizer:
            text = self.own.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.own.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, words: set) -> None:
        """Add words to the memory, encoding the new ones together."""
        new = words - self.words.keys()
        if not new:
            return
        if len(self.words) + len(new) > self.cache_entries:
            self.words, new = {}, words
        shown = {w: w if w.isascii() and w.isprintable() else "".join(map(self.byte_char.__getitem__, w.encode()))
                 for w in new if w.__class__ is str}
        ids, names = self.encode_words(set(shown.values())), self.names
        for w in new:
            own = ids[shown[w]] if w.__class__ is str else (w,)
            self.words[w] = (array.array("I", own).tobytes(), " ".join([names[i] for i in own]))

    def encode_texts(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Per text: its ids (little-endian unsigned 32-bit) and the text decoded from them."""
        split = [self.split_words(t) for t in texts]
        self.learn({w for words in split for w in words})
        out, get = [], self.words.__getitem__
        for words in split:
            found = list(map(get, words))
            out.append((b"".join([ids for ids, _ in found]), " ".join([s for _, s in found])))
        return out


def _char_class(kind: str) -> str:
    """Characters whose general category starts with ``kind``, up to U+017F (their lower case stays there)."""
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


# fixed values: the normaliser and pre-tokenizer, as tokenizer files write them, that _LATIN_WORDS restates
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

_LATER = re.compile("[^\\x00-\\u017f]")
_LATIN_WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^ \t-\r\x85\xa0{L}{N}]+".format(L=_char_class("L"), N=_char_class("N"))
)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the rest for U+0100 onwards in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def encode_decode(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    cache_entries: int = 300_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``ids`` (binary, little-endian unsigned 32-bit), ``decoded``."""
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = pa.schema([("id", to_arrow_type(src.schema["id"].dataType)), ("ids", pa.binary()), ("decoded", pa.string())])

    def kernel(batches):
        bpe = per_process(("bpe", path, cache_entries), lambda: TrieBpe(path, cache_entries))
        for batch in batches:
            for keys, texts in slices(batch, 512, ["id", "text"]):
                done = bpe.encode_texts(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, schema[0].type), pa.array([i for i, _ in done], pa.binary()),
                     pa.array([s for _, s in done], pa.string())],
                    schema=schema,
                )

    return src.mapInArrow(kernel, f"id {src.schema['id'].dataType.simpleString()}, ids binary, decoded string").withColumnRenamed(
        "id", id_col
    )
