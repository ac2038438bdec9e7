"""A training corpus in five stages, each written as Parquet to the shared folder and read again by the next.

toxicity       rejects toxic documents (trained on this input's labels)
jaccard_join   leaves one document of each group of near copies
secret_scan    replaces secrets, also encoded ones, by a mark
source_mixing  repeats or leaves out documents until the sources have their target shares, in shuffled order
packing        cuts documents into pieces and packs them into sequences of 2048 tokens

All stages but the last return the columns of documents. Beyond mixing a doc_id may come several times.

Defined cases: null and empty texts are kept by the first four stages (they are clean, link with nothing, hold no
secret and are mixed like others) and packed as their end id alone; very long texts are worked on whole; repeated rows
are left once by the second stage; rows with a null doc_id can't be judged as copies and stay; ties go to the smaller
doc_id; columns besides those of documents are carried along, whatever their names, and not returned by the last stage;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablekin.llm import jaccard_join, packing, secret_scan, source_mixing, toxicity
from tablekin.llm.common import scratch, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fitted(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.without_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.source_mixing(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("packing", pack),
]
#: Models, decoding and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):  # what the stages wrote goes once the last one is written
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), keep=name == STAGES[-1][0])
    return docs
