"""From raw documents to packed training sequences, in five stages.

1. toxicity: documents scored 0.5 or more go;
2. exact dedup: of equal texts (A-Z lower-cased) the row with the largest id stays;
3. n-gram Jaccard join: of each class of near copies the smallest id stays;
4. secret scans: every span found is replaced by ``[SECRET]`` in the text, no document goes;
5. packing: the remaining documents become sequences of at most 1024 tokens.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet to the folder the cluster shares and read again as the next one's
``docs``, so a stage that fails starts from a finished table. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import shared_dir, table
from nearfield.llm.exact_dedup import drop_copies
from nearfield.llm.ngram_join import drop_similar
from nearfield.llm.packing import pack
from nearfield.llm.secret_scan import find_secrets
from nearfield.llm.toxicity import score_documents


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return score_documents(docs, table(spark, sf_dir, "labels")).where("toxicity_predicted_ = 0").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    masked = find_secrets(docs, carry=others).withColumnRenamed("masked", "text")
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]

#: Trained scores, shingle joins and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``; each stage's table stays under ``spark.checkpoint.dir``."""
    folder = f"{shared_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
