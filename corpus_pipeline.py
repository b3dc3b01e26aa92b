"""The corpus pipeline: from raw documents to a deduplicated, decontaminated, mixed and sharded corpus.

STAGES are (name, function) pairs. Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet to the shared folder and reread as the docs of the next. All but the last return the columns of documents.

Defined results, of every stage: null, empty and very long texts are texts like others (a null text is scored and compared as
an empty one, so all of them are near copies of each other); rows that stand more than once are near copies; a null doc_id or
source is a value of its own; an empty table gives an empty one; other columns, whatever their names, are passed on by all
stages but the last and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontamination, mixing, quality_classifier, sharding, simhash_dedup
from gleaner.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) one document stays, that of the smallest doc_id."""
    return simhash_dedup.survivors(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights draws them."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and place there."""
    return sharding.assigned(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
#: The classifier's fit, the fingerprints and the hypergeometric tree can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
