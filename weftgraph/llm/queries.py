"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_codec, fingerprints, html_text, language_id, lexical_search, lm_scoring, near_dedup, packing, periodic_runs, piece_codec, quality, sharding, substring_dedup
from .common import documents, hash_bucket


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", *quality.COLUMNS, "base_failed", "kept")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(documents(spark, sf_dir))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = piece_codec.encode_documents(documents(spark, sf_dir))
    return done.select(
        "doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.learn(language_id.training_rows(docs))
    found = language_id.identify(docs, model)
    held_out = F.coalesce(hash_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.cluster(documents(spark, sf_dir))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.learn_and_score(documents(spark, sf_dir))


def op11_byte_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = byte_codec.encode_documents(documents(spark, sf_dir))
    return done.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_cycles(documents(spark, sf_dir))))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_fingerprints": op2_fingerprints,
    "op3_pieces": op3_pieces,
    "op4_sharding": op4_sharding,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_packing": op6_packing,
    "op7_language": op7_language,
    "op8_near_dedup": op8_near_dedup,
    "op9_html_text": op9_html_text,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_byte_codec": op11_byte_codec,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality": quality.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op13_lexical_search": lexical_search.SQL,
}
