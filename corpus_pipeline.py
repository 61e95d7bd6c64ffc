"""Corpus pipeline: documents through the training-data operators, one Parquet table per stage.

Stages: toxic documents go; of every group of near-duplicates one document stays; repeated passages keep
their first copy only; secrets are masked; what is left is packed into sequences. Each stage works on all
rows that the one before kept, and all but the last return the columns of ``documents``, whose ``n_chars``
follows the text.

Rows without an id and null or empty texts go through like others (blank texts are near copies of one
another); equal rows are told apart nowhere, so either all of them stay or none; rows that share an id are
judged each by its own text. Empty tables give empty tables.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import packing, repeats, secrets, simhash, toxicity
from loam.llm.bpe import tokenizer_path
from loam.session import checkpoint_dir, forget_later, read_table


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now (null text: null)."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine rejects go."""
    return toxicity.reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked SimHash fingerprints the document with the smallest id stays;
    rows without an id stay."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut out."""
    return _counted(repeats.cut_repeats(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found by the base rules or the network are replaced by a mark."""
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces placed in sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


#: (name, function(spark, docs, sf_dir) -> DataFrame), in order.
STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack),
]

#: SQL can say neither the trained stages nor the fingerprints; tests/llm checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: each is written as Parquet in the shared folder and read again.
    The folder stays until ``release``, as the result reads it."""
    docs = read_table(spark, sf_dir, "documents")
    at = os.path.join(checkpoint_dir(spark), f"corpus-pipeline-{uuid.uuid4().hex}")
    forget_later(at)
    for k, (name, stage) in enumerate(STAGES):
        path = os.path.join(at, f"{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
