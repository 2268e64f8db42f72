"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import alignment, bag_minhash, byte_codec, language_crf, line_dedup, piece_codec, quality_model, repetition, rp_forest, secrets, source_mix, target_resampling, url_lists
from corvina.llm.common import table


def op1_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_lists.judge_captures(url_lists.page_captures(pages), url_lists.validity_intervals(url_lists.page_list(pages)))
    return judged.withColumn("listed_on", F.date_format("listed_at", "yyyy-MM-dd")).drop("url", "fetched_at", "listed_at")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "source", "line_dedup.*", "text")


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge_documents(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify(table(spark, sf_dir, "documents"))


def op7_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = piece_codec.encode_documents(docs, piece_codec.Codec(docs))
    return coded.select("doc_id", "n_pieces", "lossless", F.sha2("ids", 256).alias("ids_sha256"))


def op9_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = source_mix.sized(table(spark, sf_dir, "documents"))
    taken = source_mix.mix(sizes, source_mix.plan_mix(sizes))
    return taken.select("doc_id", "source", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_byte_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_codec.encode_documents(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_lists": op1_url_lists,
    "op2_line_dedup": op2_line_dedup,
    "op3_repetition": op3_repetition,
    "op4_secrets": op4_secrets,
    "op5_quality_model": op5_quality_model,
    "op6_language_crf": op6_language_crf,
    "op7_rp_forest": op7_rp_forest,
    "op8_piece_codec": op8_piece_codec,
    "op9_bag_minhash": op9_bag_minhash,
    "op10_source_mix": op10_source_mix,
    "op11_target_resampling": op11_target_resampling,
    "op12_byte_codec": op12_byte_codec,
    "op13_alignment": op13_alignment,
}

ORACLES = {
    "op1_url_lists": url_lists.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op10_source_mix": source_mix.ORACLE,
    "op11_target_resampling": target_resampling.ORACLE,
}
