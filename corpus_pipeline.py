"""Documents through the stages of a training corpus, each stage's Parquet the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import op4_jaccard, op6_mixing, op7_quality, op9_suffix, op10_decontaminate
from tidemark.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls good; its model is fitted on labelled rows of docs. Null and empty texts have a score like any other."""
    return op7_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id. Rows without an id or words stay; a repeated id stays once."""
    return op4_jaccard.keep_first(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that an earlier one has; one that loses its whole text goes, an empty one stays."""
    return op9_suffix.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and empty texts stay."""
    return op10_decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, by the sources' target weights. An empty table stays empty."""
    return op6_mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: SQL can't train the classifier; tests hold each stage's rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
