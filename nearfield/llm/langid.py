"""Language identification as a mixture of languages per document.

Character trigrams of whole texts (letters in lower case, everything else one
blank, the middle character a letter) are hashed into ``buckets``. Learning
counts them per language over at most about ``max_rows`` labelled rows: rows are
counted per language first, and all languages share the bound evenly, where rare
ones leave the rest of their part to the others. A trigram's likelihood mixes
the language's own share of it with an even spread, at one weight in all
languages: trigrams that were never seen say nothing, however few rows a
language was learned from. For a
document, expectation-maximisation estimates the share of each language in its
trigrams. The languages with the largest shares are then tried as sets of one,
two and so on, until no larger set can win (``max_languages`` limits them on
request only); each set's shares are estimated anew, and the
set with the highest log-likelihood less ``penalty * log(trigrams)`` for every
further language is kept. The language with the largest share is predicted,
its share is the score.

Null text, or text without a letter, is ``und`` with score 0. Texts whose
trigrams say nothing (all languages alike) go to the language first in order.
Rows with a null language are not learned from; every language with a labelled
row is learned (``min_docs`` leaves rare ones out on request only). Without a row to learn
from every text is ``und``. Repeated rows are predicted each time, null ids
are carried, an empty table gives an empty result, other columns are ignored.
Very long texts are read whole, as counts of at most ``buckets`` trigrams.
No text is shuffled. The model holds the trigrams that a language was seen with
(at most those of the ``max_rows`` rows), no table of buckets by languages; a
worker spreads ``infer_bytes`` of it at a time, or one document's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nearfield.llm.common import per_process, slices

_TABLE = 0x110000


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(_TABLE)), bool, _TABLE)


def trigrams(text: str, buckets: int, letters: np.ndarray) -> np.ndarray:
    """Hashed trigrams around every letter of a text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    blank = np.array([32], "<u4")
    codes = np.concatenate([blank, np.where(letters[codes], codes, blank), blank])
    middle = np.flatnonzero(codes[1:-1] != 32)
    if not len(middle):
        return middle
    codes = codes.astype(np.uint64)
    mixed = (codes[middle] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[middle + 1] * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (codes[middle + 2] * np.uint64(0x165667B19E3779F9))) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def distinct_counts(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    if len(grams) > 4096:
        counts = np.bincount(grams, minlength=buckets)
        which = np.flatnonzero(counts)
        return which, counts[which]
    return np.unique(grams, return_counts=True)


class MixtureModel:
    """Trigram likelihoods of each language and the per-document mixture inference."""

    def __init__(self, languages: list[str], counts, smoothing: float = 0.01):
        """``counts``: a matrix of buckets by languages, or what ``seen`` holds of one."""
        self.languages = languages
        if isinstance(counts, np.ndarray):
            bucket, lang = np.nonzero(counts)
            counts = (counts.shape[0], bucket, lang, counts[bucket, lang])
        self.buckets, bucket, lang, n = self.seen = counts
        total = np.bincount(lang, weights=n, minlength=len(languages))
        order = np.argsort(bucket, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=self.buckets))]).astype(np.int64)
        self.lang, self.part = lang[order], ((1 - smoothing) * n / total[lang])[order]
        self.unseen = smoothing / self.buckets

    @property
    def counts(self) -> np.ndarray:
        out = np.zeros((self.buckets, len(self.languages)))
        out[self.seen[1], self.seen[2]] = self.seen[3]
        return out

    @property
    def likelihood(self) -> np.ndarray:
        return self.likelihoods(np.arange(self.buckets))

    def likelihoods(self, grams: np.ndarray) -> np.ndarray:
        """Of each trigram in each language."""
        sizes = self.first[grams + 1] - self.first[grams]
        row = np.repeat(np.arange(len(grams)), sizes)
        at = np.arange(len(row)) + np.repeat(self.first[grams] - (np.cumsum(sizes) - sizes), sizes)
        out = np.full((len(grams), len(self.languages)), self.unseen)
        out[row, self.lang[at]] += self.part[at]
        return out

    def portions(self, docs: list, infer_bytes: int):
        """Ranges of documents whose trigrams by languages stay within the bound (one document at least)."""
        lo, held = 0, 0
        for i, (grams, _) in enumerate(docs):
            own = len(grams) * len(self.languages) * 8
            if i > lo and held + own > infer_bytes:
                yield lo, i
                lo, held = i, 0
            held += own
        if lo < len(docs):
            yield lo, len(docs)

    def _em(self, like, weight, starts, owner, total, shares, rounds):
        """Shares after ``rounds`` of expectation-maximisation, and the log-likelihood of each document."""
        for _ in range(rounds):
            part = like * shares[owner]
            part *= (weight / part.sum(1))[:, None]
            shares = np.add.reduceat(part, starts, axis=0) / total[:, None]
        return shares, np.add.reduceat(weight * np.log((like * shares[owner]).sum(1)), starts)

    def infer(self, docs: list[tuple[np.ndarray, np.ndarray]], rounds: int, max_languages: int | None, penalty: float):
        """Shares of the chosen language set of each document given as distinct trigrams and counts (none empty)."""
        sizes = np.array([len(g) for g, _ in docs])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        owner = np.repeat(np.arange(len(docs)), sizes)
        weight = np.concatenate([c for _, c in docs]).astype(np.float64)
        total = np.add.reduceat(weight, starts)
        like = self.likelihoods(np.concatenate([g for g, _ in docs]))
        n = len(self.languages)
        full, fit = self._em(like, weight, starts, owner, total, np.full((len(docs), n), 1.0 / n), rounds)
        # no mixture of languages is likelier than this: EM's next factors bound the gain that is left
        factors = np.add.reduceat(like * (weight / (like * full[owner]).sum(1))[:, None], starts, axis=0) / total[:, None]
        most = fit + total * np.log(np.maximum(factors.max(1), 1.0))
        order = np.argsort(-full, axis=1, kind="stable")
        best = np.full(len(docs), -np.inf)
        shares = np.zeros_like(full)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(n), order.shape), axis=1)
        open_ = np.arange(len(docs))  # documents that a larger set may still fit better
        for k in range(1, min(max_languages or n, n) + 1):
            left = np.flatnonzero(most[open_] - penalty * (k - 1) * np.log(total[open_] + 1) > best[open_])
            if len(left) < len(open_):
                at = np.isin(owner, left)
                like, weight, owner = like[at], weight[at], np.searchsorted(left, owner[at])
                open_ = open_[left]
            if not len(open_):
                break
            starts = np.searchsorted(owner, np.arange(len(open_)))
            start = np.where(rank[open_] < k, np.maximum(full[open_], 1e-6), 0.0)
            start /= start.sum(1, keepdims=True)
            tried, fit = self._em(like, weight, starts, owner, total[open_], start, rounds if k > 1 else 0)
            value = fit - penalty * (k - 1) * np.log(total[open_] + 1)
            better = value > best[open_]
            best[open_[better]] = value[better]
            shares[open_[better]] = tried[better]
        return shares


def row_quota(rows: list[int], max_rows: int) -> float:
    """The most rows of one language at which all languages (rows of each) stay within ``max_rows``."""
    left = max_rows
    for i, n in enumerate(sorted(rows)):
        if n * (len(rows) - i) > left:
            return left / (len(rows) - i)
        left -= n
    return float(max(rows, default=0))


def learn(
    docs: DataFrame, max_rows: int = 20_000, buckets: int = 1 << 16, min_docs: int = 1,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> MixtureModel | None:
    """Trigram counts per language of at most about ``max_rows`` rows of ``docs`` (a hash of the id decides)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    per_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # one row for each language, as the model has; where none has min_docs rows all stay
    found = per_lang.where(F.col("n") >= min_docs).collect() or per_lang.collect()
    if not found:
        return None
    quota = row_quota([r.n for r in found], max_rows)
    limits = docs.sparkSession.createDataFrame([(r.lang, min(1.0, quota / r.n)) for r in found], "lang string, rate double")
    rows = rows.join(F.broadcast(limits), "lang").where(
        F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.col("rate") * F.lit(float(1 << 40))
    )
    out = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def kernel(batches):
        letters = per_process(("letters",), _letters)
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for texts, langs in slices(batch, 512, ["text", "lang"]):
                for text, lang in zip(texts, langs):
                    if lang not in held:
                        held[lang] = np.zeros(buckets, np.int64)
                    held[lang] += np.bincount(trigrams(text, buckets, letters), minlength=buckets)
        for lang, counts in held.items():
            which = np.flatnonzero(counts).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(which), pa.string()), pa.array(which), pa.array(counts[which])], schema=out)

    counted = (
        rows.select("text", "lang").mapInArrow(kernel, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        .toPandas()  # at most one row for each language and bucket
    )
    languages = sorted(r.lang for r in found)
    place = {l: i for i, l in enumerate(languages)}
    # in a fixed order, so that sums come out alike in every run
    counted = counted.assign(at=counted.lang.map(place).astype("int64")).sort_values(["bucket", "at"])
    return MixtureModel(languages, (buckets, counted.bucket.to_numpy("int64"), counted["at"].to_numpy(), counted.n.to_numpy("float64")))


def identify(
    docs: DataFrame, model: MixtureModel | None, rounds: int = 8, max_languages: int | None = None, penalty: float = 4.0,
    infer_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score``, ``languages`` (the chosen set with its shares)."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    # trigrams seen in the learning sample, whatever the input
    sent = spark.sparkContext.broadcast(model and (model.languages, model.seen))
    shares_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    schema = pa.schema([("id", to_arrow_type(src.schema["id"].dataType)), ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("languages", shares_type)])

    def kernel(batches):
        model = sent.value and MixtureModel(*sent.value)
        letters = per_process(("letters",), _letters)
        for batch in batches:
            for ids, texts in slices(batch, 128, ["id", "text"]):
                predicted, score, sets = ["und"] * len(ids), [0.0] * len(ids), [[] for _ in ids]
                grams = [trigrams(t or "", model.buckets, letters) if model else () for t in texts]
                rows = [i for i, g in enumerate(grams) if len(g)]
                counted = [distinct_counts(grams[i], model.buckets) for i in rows]
                for lo, hi in model.portions(counted, infer_bytes) if rows else ():
                    shares = model.infer(counted[lo:hi], rounds, max_languages, penalty)
                    for i, own in zip(rows[lo:hi], shares):
                        top = int(own.argmax())
                        predicted[i], score[i] = model.languages[top], min(1.0, float(own[top]))
                        sets[i] = [{"lang": model.languages[k], "share": float(own[k])} for k in np.flatnonzero(own)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, schema[0].type), pa.array(predicted, pa.string()), pa.array(score, pa.float64()),
                     pa.array(sets, shares_type)], schema=schema)

    id_type = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(
        kernel, f"id {id_type}, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    ).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """The rows whose languages are never learned from: crc32 of the id as text, ``fold`` modulo ``folds`` (a null id counts as "")."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold
