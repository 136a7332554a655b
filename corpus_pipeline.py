"""From raw documents to token ids: five stages, each one operator of ``citeloom.llm``.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of
``documents``; the last returns the encoded documents.  Stages are written and reread as Parquet.

Defined results of every stage: an empty table gives an empty one; further columns of the input are left
out; rows that repeat are handled each, except that near duplicates keep one of them; a null id is an id
like others, but never the one that stands for a group if the group has another.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import byte_bpe, decontaminate, language_id, ngram_join, secrets
from citeloom.llm.common import fold_of, small_batches, table
from citeloom.plans.checkpoint import remove, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is less sure than this is rejected.
LEAST_SURE = 0.5
REDACTED = "[SECRET]"


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter in them, or no language with a probability of LEAST_SURE."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs.where(fold_of(F.col("doc_id"), 4) != 2))
    sure = language_id.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE))
    return sure.select(*COLUMNS)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (a null id only in a group without another)."""
    small_batches(spark)
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def stage_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    small_batches(spark)
    return decontaminate.remove_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are blanked out; every document stays."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    clean = secrets.scan_documents(docs, redact=REDACTED, dictionary=secrets.identifiers(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their count and digests."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    outputs = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    encoded = byte_bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, outputs)
    return encoded.drop("text")


STAGES = [
    ("language ID", stage_language),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("benchmark decontamination", stage_benchmark),
    ("secret scans", stage_secrets),
    ("byte-level BPE", stage_encode),
]

#: SQL can express neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared checkpoint folder, and deleted
    when the next stage has been written."""
    shared_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {}
