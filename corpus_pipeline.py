"""Five stages from raw documents to token ids; each works on all that the one before kept.

1. quality: documents whose rule-ensemble score is under 0.5 go;
2. near_duplicates: one document of each group of near copies stays;
3. decontamination: documents that hold a benchmark item go;
4. secrets: secrets in the texts are replaced by a mark, documents stay;
5. encoding: byte-level BPE ids of each text, and what they decode to.

All stages but the last return the columns of documents. A null text counts as empty;
rows without doc_id are kept by stages 2 and 3, rows that repeat a doc_id are one
document from stage 2 on; an empty table passes through.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, char_cnn, latent, minmax, rule_ensemble
from factloom.llm.batches import table
from factloom.session import materialize

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rule_ensemble.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minmax.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return latent.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return char_cnn.redact(docs, char_cnn.learn(docs), length="n_chars")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN)
    decoded = bpe.decode(ids, VOCABULARY, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]
#: Trained models and latent search have no SQL form; tests hold each stage against a plain evaluation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
