"""A corpus pipeline over the training-data operators (part of subpackage llm).

Each stage takes the documents its predecessor kept and returns what it keeps, with the columns
of documents; the last returns the encoding of every document left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vertexloom.llm import byte_bpe, decontaminate, jaccard_join, quality_classifier, quality_rules
from vertexloom.llm.common import shared_dir, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_by_rules(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.filter_by_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that holds a window of any item goes, whatever its number of items."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return byte_bpe.round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ["doc_id"])


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("jaccard_join", near_duplicates), ("decontamination", decontamination), ("byte_bpe", encoding)]

#: a trained classifier is among the stages, so SQL cannot give the rows
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    at = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{i}-{name}")
    return docs
