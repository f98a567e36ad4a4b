"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import jaccard_join, mixing, phrase_index, quality_model, sharding
from verdigris.llm.common import LIVE, drop, drop_others, read, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; held-out labels stay out of its fit here too."""
    return quality_model.accepted(docs, quality_model.training_labels(read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links connect: five words, 80 of 100."""
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return phrase_index.clean(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return sharding.shard(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mixing", source_mixing), ("sharding", shards)]

#: The classifier's fit has no SQL form; tests hold run() against a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, in order. Each stage's rows are written and read again; what else it has staged, and its own input, go then."""
    docs, last = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        before = list(LIVE)
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_others(before, docs)
        drop(*last)
        last = [docs]
    return docs
