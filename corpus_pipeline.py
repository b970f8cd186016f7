"""From raw documents to packed sequences: classify, drop repeated lines and near copies, mix sources, pack.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all of docs, and returns a DataFrame. Its
result is written as Parquet and read again before the next stage starts; the stages number rows by that table's scan. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import line_dedup, mixing, packing, quality_knn, simhash
from gleanery.llm.common import delete, documents, scratch, shared_dir


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote scores below 0.3 go."""
    return quality_knn.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two or more lines, and of single lines of 20 words or more, go from the texts; documents stay."""
    return line_dedup.dedup_lines(docs, report=False)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: linked by SimHash, or by a similarity of 0.8 or more of five-word shingles."""
    return simhash.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated as their source's target asks."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality classifier", classify_quality), ("line dedup", dedup_lines), ("SimHash near-dedup", dedup_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: The vote, XXH64 and the tokenizer have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote for itself is deleted once its result is written, and that once the next one's is."""
    docs, last = documents(spark, sf_dir), None
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.schema(out.schema).parquet(path), path
    return docs
