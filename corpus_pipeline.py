"""A training corpus from documents: good documents, rules, one of each near-duplicate group, no repeats, packed.

Every stage works on all rows that the one before kept and drops or changes them for good; all but the last return
the columns of documents. Stages cut their own lineage to the shared checkpoint folder; between stages the rows are
written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import packing, quality_rules, quality_votes, repeats, similar
from chronolith.llm.common import remove, shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours' votes reach the threshold; what it rejects goes."""
    return quality_votes.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the likelihood ratio; what it rejects goes."""
    return quality_rules.keep_passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fingerprints, tables of their distances to reference fingerprints, then exact sets: of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more one document."""
    return similar.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with what it repeats cut out; n_chars follows, a document that loses all of its text goes."""
    return repeats.cut_repeats(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", best_fit),
]
#: Votes, fingerprints, byte strings and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")  # what the stage read is needed no more
    return docs
