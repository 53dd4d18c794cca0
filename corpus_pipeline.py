"""A pipeline over ``documents``: quality, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame; all
but the last return the columns of ``documents``.  Outputs are written as Parquet and read again in between.
Each docstring states what becomes of nulls, ties, repeated rows and empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wellspring.llm import decontaminate, near_dedup, packing, quality, secrets
from wellspring.llm.common import discard, shared_dir, store, table
from wellspring.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose probability of the highest grade is at least one half.

    Null texts are graded as empty ones; null ids, ties and repeated rows are judged row by row.  Without labels
    of two grades all are kept.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component: the one with the smallest id.

    Null and empty texts are one component.  Rows without id stay; of repeated rows of an id one stays.
    """
    return near_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents into which no test item has leaked.

    Rows without id or text stay, as all do without items; repeated rows share their fate.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents and replaces the secrets in their texts; null texts stay null."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece with its sequence and offset.

    Null and empty texts are one piece of one token; repeated rows and rows without id are packed each.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: A fitted model and a tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each output goes through Parquet in the shared folder until it has been read.

    An empty table gives an empty result.  Columns beyond those of ``documents`` go along unread, whatever their
    names.
    """
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        after = store(stage(spark, docs, sf_dir), f"{at}/{n}")
        discard(docs)
        docs = after
    return docs
