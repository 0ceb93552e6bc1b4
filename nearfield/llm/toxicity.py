"""Toxicity scores: gradient-boosted trees over dense text features, isotonically calibrated.

Features of a whole text: how dense lexicon words are (given seeds, and terms
learned from the labels), how many of them stand within ``near`` words of a
second-person word, the shares of capitals, punctuation and exclamation marks,
how many words mix letters with digits or signs, and how many become lexicon
words once such signs are undone.

Learning uses at most about ``max_rows`` labelled rows (a hash of the id
decides, so the sample is the same on every run; equal texts count once).
Half of them give the learned terms: words, and word beginnings of four to six
letters, seen in at least ``min_share`` of the toxic rows (three at least) and
toxic in ``min_precision`` of the rows that hold them. The other rows, unseen
by the lexicon, are divided between the trees (Spark ML) and the isotonic
regression (Spark ML), so each step is fitted on rows that the one before it
has not seen. Ties of the calibrated score are broken by the trees' score.

Rows without a label, with a null label or a null id are not learned from; of
several labels of an id the largest counts. Without any row to learn from the
score is the density of the seed words. Null text counts as empty and is scored.
Repeated rows are scored each time, an empty table gives an empty result, and
other columns are ignored or passed on unread. No text is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nearfield.llm.common import cut

SEEDS = ("idiot", "moron", "stupid", "pathetic", "loser", "scum", "trash", "worthless", "disgusting", "clown", "dumb",
         "imbecile", "scumbag", "vermin", "filth", "garbage")
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch sie tu te toi ton ta vous votre "
                          "usted ustedes tú ti tus vos".split())
UNDONE = str.maketrans("0134578@$!", "oieastbasi")
FEATURES = ("words", "seeds", "learned", "learned_kinds", "near_second_person", "undone", "capitals", "punctuation",
            "exclamations", "obfuscated")
_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
# A whole token with a digit or sign in it; tried at token starts only, so long tokens cost linear time.
_MIXED = re.compile(r"(?<!\S)[^\s0-9@$*!#%&]*+[0-9@$*!#%&]\S*+")
_COL = "toxicity_features_"


def terms_of(word: str) -> tuple[str, ...]:
    """A word and its beginnings of four to six letters (marked by a trailing ``-``)."""
    return (word, *(word[:n] + "-" for n in (4, 5, 6) if len(word) > n))


def features_of(text: str, seeds, learned, near: int) -> list[float]:
    """The dense features of one text, in the order of ``FEATURES``."""
    words = _WORD.findall(text.lower())
    n = max(1, len(words))
    counted = Counter(words)
    kinds, bad = set(), set()  # learned terms met; words that are or begin like a lexicon entry
    for w in counted:
        hit = [t for t in terms_of(w) if t in learned]
        if hit:
            kinds.add(min(hit, key=len))
        if hit or w in seeds:
            bad.add(w)
    seed_hits = sum(counted[w] for w in seeds if w in counted)
    close = 0
    hits = sum(counted[w] for w in bad)
    if bad and not SECOND_PERSON.isdisjoint(counted):
        last = -near - 1
        waiting: list[int] = []
        for i, w in enumerate(words):
            if w in SECOND_PERSON:
                close += sum(1 for j in waiting if i - j <= near)
                waiting, last = [], i
            elif w in bad:
                if i - last <= near:
                    close += 1
                else:
                    waiting.append(i)
    chars = max(1, len(text))
    mixed = [m for m in _MIXED.findall(text) if _LETTER.search(m)]
    undone = 0
    for m in mixed:
        whole = "".join(_WORD.findall(m.lower().strip("!$@*#%&").translate(UNDONE)))
        if whole in seeds or any(t in learned for t in terms_of(whole)):
            undone += 1
    raw = text.encode("utf-8", "replace")
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    punctuation = len(raw) - len(raw.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    return [
        math.log1p(len(words)), seed_hits / n, hits / n, float(len(kinds)), close / n, undone / n,
        capitals / chars, punctuation / chars, text.count("!") / chars, len(mixed) / n,
    ]


def with_features(df: DataFrame, text_col: str, seeds, learned, near: int, keep_text: bool = True) -> DataFrame:
    """``df`` with the feature array of its text; all other columns are passed on."""
    kept = [f for f in df.schema if keep_text or f.name != text_col]
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kept] + [(_COL, pa.list_(pa.float64()))])
    names, seeds, learned = [f.name for f in kept], frozenset(seeds), frozenset(learned)

    def kernel(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                made = [features_of(t or "", seeds, learned, near) for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                columns = [part.column(part.schema.get_field_index(n)).cast(schema.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.list_(pa.float64()))], schema=schema)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.mapInArrow(kernel, f"{types}, {_COL} array<double>")


def learn_terms(rows: DataFrame, min_share: float, min_precision: float, max_terms: int) -> list[str]:
    """Terms that mark toxic rows of ``rows`` (text, label), by the rows that hold them."""
    out = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def kernel(batches):
        counts: dict[str, list[int]] = {}

        def emit():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
                 pa.array([c[1] for c in counts.values()], pa.int64())], schema=out)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256).to_pydict()
                for text, label in zip(part["text"], part["label"]):
                    for term in {t for w in set(_WORD.findall(text.lower())) for t in terms_of(w)}:
                        counts.setdefault(term, [0, 0])[0 if label else 1] += 1
                if len(counts) > 400_000:
                    yield emit()
                    counts = {}
        if counts:
            yield emit()

    toxic = rows.where("label = 1").count()
    least = max(3, math.ceil(min_share * toxic))
    found = (
        rows.select("text", "label").mapInArrow(kernel, "term string, toxic bigint, clean bigint")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= least) & (F.col("toxic") >= min_precision * (F.col("toxic") + F.col("clean"))))
        .orderBy(F.desc("toxic"), "term").limit(max_terms)
    )
    return [r.term for r in found.collect()]


class ToxicityModel:
    """Learned terms, trees and calibration; ``transform`` adds ``score`` and ``predicted``."""

    def __init__(self, seeds, near, learned, trees, calibration):
        self.seeds, self.near, self.learned, self.trees, self.calibration = seeds, near, learned, trees, calibration

    def transform(self, docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
        docs = docs.drop(_COL, "toxicity_score_", "toxicity_predicted_")  # of an earlier scoring
        rows = with_features(docs, text_col, self.seeds, self.learned, self.near, keep_text)
        own = [F.col(f"`{c}`") for c in rows.columns if c != _COL]
        if self.trees is None:
            score = F.least(F.lit(1.0), 10 * F.col(_COL)[FEATURES.index("seeds")])
        else:
            packed = F.struct(*own)
            rows = rows.select(packed.alias("row_"), array_to_vector(_COL).alias(_COL))
            rows = self.calibration.transform(_raw(self.trees.transform(rows)))
            own = [F.col("row_").getField(f.name).alias(f.name) for f in rows.schema["row_"].dataType]
            score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("calibrated_") + 0.001 * F.col("raw_")))
        rows = rows.select(*own, score.alias("toxicity_score_"))
        return rows.withColumn("toxicity_predicted_", (F.col("toxicity_score_") >= 0.5).cast("int"))


def _raw(rows: DataFrame) -> DataFrame:
    return rows.withColumn("raw_", vector_to_array("probability_")[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 40_000,
    seeds: tuple[str, ...] = SEEDS,
    near: int = 5,
    min_share: float = 0.01,
    min_precision: float = 0.8,
    max_terms: int = 5_000,
    trees: int = 20,
    depth: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> ToxicityModel:
    """Learn from ``labels`` (id, ``label`` 0 or 1) of ``docs``; ``max_rows`` bounds the rows learned from."""
    labels = labels.select(F.col(id_col).alias("id"), F.col("label").cast("int").alias("label"))
    labels = labels.where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    share = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1e6
    n = labels.count()
    # about max_rows rows, so their ids and labels are small enough for every task
    chosen = labels.where(share < max_rows / n) if n > max_rows else labels
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").select(F.xxhash64("text").alias("h"), "text", "label")
    rows = cut(rows.groupBy("h").agg(F.max_by("text", "label").alias("text"), F.max("label").alias("label")))
    part = F.pmod(F.xxhash64("h"), F.lit(4))
    if rows.agg(F.countDistinct("label")).first()[0] < 2:
        return ToxicityModel(seeds, near, [], None, None)
    learned = learn_terms(rows.where(part < 2), min_share, min_precision, max_terms)
    made = with_features(rows.where(part >= 2), "text", seeds, learned, near, keep_text=False)
    made = cut(made.select("h", F.col("label").cast("double").alias("label"), array_to_vector(_COL).alias(_COL)))
    fits = made.where(part == 2)
    if fits.agg(F.countDistinct("label")).first()[0] < 2:
        fits = made
    if fits.agg(F.countDistinct("label")).first()[0] < 2:
        return ToxicityModel(seeds, near, learned, None, None)
    boosting = GBTClassifier(
        featuresCol=_COL, labelCol="label", predictionCol="tree_",
        maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=3, seed=17,
    )
    forest = boosting.setRawPredictionCol("margin_").setProbabilityCol("probability_").fit(fits)
    checks = made.where(part == 3)
    if checks.agg(F.countDistinct("label")).first()[0] < 2:
        checks = made
    calibration = IsotonicRegression(featuresCol="raw_", labelCol="label", predictionCol="calibrated_").fit(
        _raw(forest.transform(checks)).select("raw_", "label")
    )
    return ToxicityModel(seeds, near, learned, forest, calibration)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """The rows that labels are never learned from: crc32 of the id as text, 0 modulo ``folds`` (a null id counts as "")."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def score_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """``docs`` (all columns) with ``toxicity_score_`` and ``toxicity_predicted_``, learned outside the held-out fold."""
    learnable = labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    return fit(docs, learnable, **params).transform(docs)
