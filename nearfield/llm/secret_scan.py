"""Secret scan: fixed patterns plus dictionary-primed compression novelty.

Three pattern kinds are found in every text, leftmost and non-overlapping per
kind; a match that is too short is dropped but still consumes its characters:

* ``assign``: a credential name, an assignment sign and a value of 12 characters or more;
* ``access``: ``AKIA`` and capitals or digits, 18 characters or more;
* ``hex``: a run of 16 or more lower-case hexadecimal digits.

A fourth kind, ``novel``, reports values that no pattern covers: a run of
``min_novel`` or more key characters mixing letters and digits, at most
``reach`` characters after a sensitive word. Zstandard is primed with the
identifier dictionaries and the text around the candidate, and the bytes it
adds for the candidate are divided by its length. What repeats its
surroundings or is made of known words costs little; random key material costs
about as much as it is long and is reported from ``novelty`` upwards. Two
dictionaries are used: ``identifiers``, given whole, and the words of a public
tokenizer's vocabulary (``vocabulary_path``), of which the stretches that a
candidate is made of are given: words (split at separators, digits and changes
of case), short numbers and separators in a row. So names, paths and slugs are
known, whatever words they join, and so are UUIDs, which name things; a key's
random letters hold no stretch long enough to matter. Candidates
of 64 characters or more are measured in even pieces, which Zstandard stores as
they are: it codes longer ones by their alphabet, so that long random keys would
cost little too. One novel piece reports the whole candidate. Other places of a
candidate are left out of its surroundings, so a key written twice does not hide
itself, and what is novel at one place of a text is reported at all that are
candidates. A run that patterns cover entirely is no candidate; one that they cover
in part is judged and reported whole.

Spans are code points, end exclusive, and include the name and sign of an
``assign`` match. Null text counts as empty (no spans). Repeated rows are
scanned each time, null ids are carried, an empty table gives an empty result
and other columns are ignored. No shuffle.
"""

from __future__ import annotations

import bisect
import json
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

import public_tokenizers
from nearfield.llm.common import per_process, slices

KINDS = ("assign", "access", "hex", "novel")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so this equals dropping shorter ones

SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "access_key", "private_key",
             "credential", "authorization", "bearer", "client_secret", "signature",
             "api-key", "access-key", "private-key", "client-secret")
#: Prime content: what commonly surrounds or imitates a secret in code and configuration.
IDENTIFIERS = (
    "access_key_id secret_access_key api_key apikey api-key client_id client_secret authorization bearer basic token "
    "refresh_token access_token id_token session_token auth_token csrf_token password passwd passphrase username "
    "private_key public_key signature credential credentials certificate config settings environment variable "
    "example changeme placeholder your_api_key_here your-secret-here xxxxxxxxxxxxxxxxxxxxxxxx 00000000000000000000 "
    "0123456789abcdef 0123456789ABCDEF abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 01234567890 "
    "https://www.example.com/path/index.html?utm_source= localhost:8080 127.0.0.1 application/json text/html utf-8 "
    "sha256 sha512 md5 base64 uuid version 1.0.0 2.0.0 v1 v2 .txt .json .yaml .html .com .org .net"
)


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the three pattern kinds."""
    lower = text.lower()
    out = []
    if any(w in lower for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


#: Words of two letters that names are made of; longer ones come from the vocabulary.
SHORT_WORDS = frozenset("an as at be by de do en es fr go he id if in io ip is it js la me my no of ok on or os so tb to ui up us we".split())
_STRETCH = re.compile(
    r"(?P<uuid>(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f]))|(?P<version>(?<![A-Za-z])[vV][0-9]{1,3}(?![0-9]))"
    r"|(?P<word>[A-Z]?[a-z]+|[A-Z]+(?![a-z]))|(?P<number>[0-9]+)|(?P<sign>[^A-Za-z0-9]+)"
)


def vocabulary_words(path: str) -> frozenset[str]:
    """The words of three letters or more among a tokenizer file's tokens that begin a word (marked by ``\u0120``)."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    return frozenset(t[1:].lower() for t in tokens if len(t) > 3 and t[0] == "\u0120" and t[1:].isascii() and t[1:].isalpha())


def known_stretches(value: str, words: frozenset[str], least: int = 8) -> list[tuple[int, int]]:
    """Where in ``value`` there are runs of known words, numbers of up to eight digits, UUIDs and signs, ``least`` characters or longer."""
    out, start, named = [], None, False
    for m in _STRETCH.finditer(value):
        text, kind = m[0], m.lastgroup
        known = kind in ("uuid", "version", "sign") or kind == "number" and len(text) <= 8
        if kind == "word":
            known = text.lower() in words or text.lower() in SHORT_WORDS
        if known:
            start = m.start() if start is None else start
            named |= kind != "sign"
        else:
            if named and m.start() - start >= least:
                out.append((start, m.start()))
            start, named = None, False
    if named and len(value) - start >= least:
        out.append((start, len(value)))
    return out


class Novelty:
    """Marginal compressed size of a string against dictionaries and its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS, words: frozenset[str] = frozenset(), level: int = 3):
        self.prime = identifiers.encode()
        self.words = words
        self.level = level

    def share(self, value: str, before: str, after: str, known: list[str] = ()) -> float:
        """Bytes that ``value`` adds to its compressed surroundings and ``known`` stretches, per character."""
        # the text before comes last: the closest offsets are the cheapest
        parts = (self.prime, *(k.encode("utf-8", "replace") for k in known), after.encode("utf-8", "replace"), before.encode("utf-8", "replace"))
        primed = zstandard.ZstdCompressor(
            level=self.level,
            dict_data=zstandard.ZstdCompressionDict(b"\n".join(parts), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        return (len(primed.compress(value.encode())) - len(primed.compress(b""))) / len(value)


#: Zstandard codes literals of 64 bytes and more by their frequency.
_PIECE = 63


def is_novel(value: str, before: str, after: str, novelty: Novelty, threshold: float, window: int) -> bool:
    """Whether an even piece of at most ``_PIECE`` characters costs ``threshold`` a character or more."""
    known = known_stretches(value, novelty.words)
    n = -(-len(value) // _PIECE)
    first = 0
    for i in range(n):
        lo, hi = len(value) * i // n, len(value) * (i + 1) // n
        while first < len(known) and known[first][1] <= lo:
            first += 1
        met, k = [], first  # what of the known stretches lies in this piece
        while k < len(known) and known[k][0] < hi:
            met.append(value[max(known[k][0], lo) : min(known[k][1], hi)])
            k += 1
        # a piece also knows the pieces before it
        if novelty.share(value[lo:hi], (before + value[max(0, lo - window) : lo])[-window:], after, met) >= threshold:
            return True
    return False


def key_parts(value: str, min_novel: int) -> tuple[str, ...]:
    """What of a candidate identifies it elsewhere: its long parts between ``=`` signs, else all of it."""
    return tuple(p for p in value.split("=") if len(p) >= min_novel) or (value,)


def surroundings(text: str, a: int, b: int, parts: tuple[str, ...], window: int) -> tuple[str, str]:
    """``window`` characters before and after a candidate, without its other places."""
    more = window + b - a  # a place that the window would cut is seen whole
    before, after = text[max(0, a - more) : a], text[b : b + more]
    for part in parts:
        before, after = before.replace(part, " "), after.replace(part, " ")
    return before[-window:], after[:window]


def novel_spans(
    text: str, covered: list[tuple[int, int, str]], novelty: Novelty, threshold: float, min_novel: int, reach: int, window: int
) -> list[tuple[int, int, str]]:
    """Incompressible key-like runs close after a sensitive word and not wholly in ``covered``."""
    lower = text.lower()
    if len(lower) != len(text) or not any(w in lower for w in SENSITIVE):
        lower = "".join(c.lower() if c.isascii() else c for c in text)
        if not any(w in lower for w in SENSITIVE):
            return []
    # merged covered parts: by their starts, the one before a position is the only one that can hold it
    starts, ends = [], []
    for a, b, _ in sorted(covered):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    places, novel, seen = [], set(), 0
    for word in _SENSITIVE.finditer(lower):
        # a run that starts in reach shows its first min_novel characters here
        for m in _RUN.finditer(text, max(seen, word.end()), min(len(text), word.end() + reach + min_novel)):
            a = m.start()
            if a > word.end() + reach:
                break  # a later word may reach it
            b = _RUN.match(text, a).end()
            seen = max(seen, b)
            if b - a < min_novel:
                continue
            value = text[a:b]
            i = bisect.bisect_right(starts, a)
            if i and ends[i - 1] >= b:
                continue
            if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
                continue
            parts = key_parts(value, min_novel)
            places.append((a, b, parts))
            if parts not in novel and is_novel(value, *surroundings(text, a, b, parts, window), novelty, threshold, window):
                novel.add(parts)
    return [(a, b, "novel") for a, b, parts in places if parts in novel]


_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)))


def find_secrets(
    docs: DataFrame,
    novelty: float = 0.8,
    min_novel: int = 20,
    reach: int = 48,
    window: int = 1024,
    identifiers: str = IDENTIFIERS,
    vocabulary_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, ``spans`` (array of start, end, kind; by start, then kind),
    ``masked`` (the text with every span replaced by ``[SECRET]``, null for null) and ``carry`` columns.
    """
    path = vocabulary_path or public_tokenizers.path("byte_bpe_50k.json")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
    kept = [f for f in src.schema if f.name != "text"]
    schema = pa.schema(
        [(f.name, to_arrow_type(f.dataType)) for f in kept] + [("spans", pa.list_(span)), ("masked", pa.string())]
    )

    def scan(text, measure):
        found = pattern_spans(text)
        found += novel_spans(text, found, measure, novelty, min_novel, reach, window)
        found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
        return found

    def mask(text, spans):
        out, at = [], 0
        for a, b, _ in spans:
            if b > at:
                out += [text[at : max(a, at)], "[SECRET]"] if a >= at else []
                at = b
        return "".join([*out, text[at:]]) if spans else text

    def kernel(batches):
        measure = Novelty(identifiers, per_process(("vocabulary words", path), lambda: vocabulary_words(path)))
        names = [f.name for f in kept]
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                (texts,) = next(slices(part, 512, ["text"]))
                spans = [scan(t or "", measure) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(n)).cast(schema.field(n).type) for n in names]
                    + [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in spans], pa.list_(span)),
                       pa.array([t if t is None else mask(t, s) for t, s in zip(texts, spans)], pa.string())],
                    schema=schema,
                )

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    out = src.mapInArrow(kernel, types + ", spans array<struct<start:bigint,end:bigint,kind:string>>, masked string")
    return out.select(
        F.col("id").alias(id_col), "spans", "masked", *[F.col(f"carry_{c}").alias(c) for c in carry if c != id_col]
    )
