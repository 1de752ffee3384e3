"""A corpus pipeline: documents that a language model may be trained on, packed into batches.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Nulls, repeated rows and empty tables are as the operators define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stackfuse.llm import common as C
from stackfuse.llm import decontaminate, minhash, packing, queries, secrets, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go; it learns from labelled rows of documents."""
    return toxicity.drop_toxic(docs, C.table(spark, sf_dir, "labels"), C.table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    return minhash.drop_near_duplicates(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.drop_contaminated(docs, C.table(spark, sf_dir, "benchmark"))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secrets.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each sequence of at most 4096 tokens: its text, and its bucket, batch and slot."""
    return packing.pack_tokens(docs, queries.vocabulary())


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", contaminated), ("secrets", secret), ("packing", packed)]

#: SQL can't express the network, nor the alignment of passages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = C.table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            at = f"{C.shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
            with C.cleaned(spark):
                docs.write.parquet(at)
            if written is not None:  # its successor is written: no one reads it again
                C.release(spark, written)
            docs = written = spark.read.parquet(at)
    return docs
