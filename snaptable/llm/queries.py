"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, cotrain, exact, licenses, minhash, mixing, quality, secrets, tokens
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.expand(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents")).drop("node")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.fit_and_classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths: a document lies at /source/lang/doc_id."""
    return licenses.scan(table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", F.lit(""), "source", "lang", "doc_id")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op2 that SQL can express."""
    return op2_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op10 that SQL can express."""
    return op10_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_chat_formatting, op4_mixing, op5_bpe, op6_minhash_dedup, op7_exact_dedup, op8_quality_classifier, op9_license_scan, op10_secret_scan, quality_base, secret_base)
}
ORACLE_SQL: dict[str, str] = {"op3_chat_formatting": chat.SQL, "op4_mixing": mixing.SQL, "op7_exact_dedup": exact.SQL, "quality_base": quality.BASE_SQL, "secret_base": secrets.BASE_SQL}
