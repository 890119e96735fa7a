"""The queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    op1_suffix_tree,
    op2_licenses,
    op3_warc,
    op4_jaccard,
    op5_digest,
    op6_mixing,
    op7_quality,
    op8_toolcalls,
    op9_suffix,
    op10_decontaminate,
    op11_yinyang,
    op12_secrets,
    op13_divergence,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_suffix_tree.score(_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_licenses.scan(op2_licenses.files_of(_table(spark, sf_dir, "documents")))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_warc.archive_pages(_table(spark, sf_dir, "pages"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_jaccard.jaccard_classes(_table(spark, sf_dir, "documents"))


def op5_feature_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_digest.fingerprints(_table(spark, sf_dir, "documents"))


def op6_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_mixing.mix(_table(spark, sf_dir, "documents"))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_toolcalls.link_calls(*op8_toolcalls.calls_of(_table(spark, sf_dir, "conversations")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_suffix.removal_digests(_table(spark, sf_dir, "documents"))


def op10_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_yinyang.vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_secrets.scan(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_divergence.divergence(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_tree_scores,
        op2_license_scan,
        op3_arc_to_warc,
        op4_ngram_jaccard_join,
        op5_feature_digests,
        op6_mix_to_weights,
        op7_quality_crf,
        op8_tool_call_linking,
        op9_suffix_dedup,
        op10_qgram_decontamination,
        op11_vector_codes,
        op12_secret_scan,
        op13_source_divergence,
    )
}
ORACLES = {
    "op2_license_scan": op2_licenses.ORACLE,
    "op3_arc_to_warc": op3_warc.ORACLE,
    "op6_mix_to_weights": op6_mixing.ORACLE,
    "op8_tool_call_linking": op8_toolcalls.ORACLE,
    "op11_vector_codes": op11_yinyang.ORACLE,
    "op13_source_divergence": op13_divergence.ORACLE,
}
