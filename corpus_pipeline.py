"""A training corpus from documents: quality, toxicity, exact and near copies, packing.

Each stage works on all rows that the one before it kept, and all but the
last return the columns of documents. Documents that the quality or the
toxicity classifier rejects are left out, of equal texts the row of largest
doc_id stays, of near copies the row of smallest doc_id; what remains is
packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselode.llm import exact_dedup, packing, quality, simhash, toxicity
from caselode.llm.common import stage_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def toxicity_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity_classifier", toxicity_classifier),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("best_fit_packing", best_fit_packing),
]

#: The classifiers and the tokenizer have no SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
