"""A training corpus from `documents`: quality rules, exact dedup, near dedup, source mix, BPE.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
documents, extra ones too; the last returns tokens. run() writes each stage's result to the shared folder, reads it
again, and deletes the stage's own tables and its predecessor's. An empty table runs through to an empty result; what
each stage does with nulls, ties, repeated rows and very long texts is said at the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snaptable.llm import bpe, common, exact, minhash, mixing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and compression bands reject go; a null or empty text has no words and goes too."""
    return quality.drop_low_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document of largest doc_id stays; of rows that repeat id and text, one."""
    return exact.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of smallest doc_id stays (a null one only if there is no other)."""
    return minhash.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: 0, 1 or 2 times. Null sources are one source."""
    return mixing.mixed_rows(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source of every row, with the number of its tokens and the digests of its ids and decoded text."""
    return common.materialize(bpe.encode_digests(docs, keep=["doc_id", "lang", "source"]), "bpe")


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("bpe", encode_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.scratch() as keep:
            after = keep(common.materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        common.discard(docs)
        docs = after
    return docs


#: zstandard ratios, Poisson signatures and BPE have no SQL form.
ORACLE_SQL = None
