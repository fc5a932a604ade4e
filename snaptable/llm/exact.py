"""Exact dedup: tree-merge of sorted digest runs, in DataFrame operations only.

Every scan task is a run. A run is sorted by digest and equal neighbours are merged (the struct-valued
max makes Spark choose its sort-based aggregation: a streaming merge of sorted input that spills). Then come
binomial rounds: in each, runs 2k and 2k + 1 exchange their entries and merge, entries of one digest in one
task, until one run is left after log2(runs) rounds. A digest that holds a third of all rows arrives at the
last merge as two entries, never as its rows. Each merge compares SHA-256, length and a second hash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_rows, join_hot, materialize, scratch

RUNS, FAN_IN = 16, 2
KEY = ["digest", "octets", "proof"]
#: Copies of a repeated row that are written out by one task.
CHUNK = 1 << 16


def normalized(text: Column) -> Column:
    """A-Z in lower case, everything else as it is; null as the empty text."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalized(text).cast("binary"), 256))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the key of each row: SHA-256, length in bytes and a second hash, which every merge compares too."""
    rows = docs.select(docs[doc_id].alias("doc_id"), normalized(docs[text]).alias("body"))
    return rows.select("doc_id", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"), F.octet_length("body").alias("octets"), F.xxhash64("body").alias("proof"))


def merge_runs(prints: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct key: keep_id (largest doc_id) and group_size, merged in rounds of fan_in neighbouring runs."""
    level = prints.select(*KEY, F.struct("doc_id").alias("top"), F.lit(1).cast("long").alias("n"), F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"))
    while "run" in level.columns:
        runs = -(-runs // fan_in)
        by = [*KEY, "run"] if runs > 1 else KEY
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).groupBy(*by).agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    return level.select(*KEY, F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"))


def _placed(docs: DataFrame, doc_id: str, text: str, runs: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """(rows, again): each row with its digest, keep_id and group_size; and the kept (doc_id, digest) that several rows have."""
    prints = materialize(fingerprints(docs, doc_id, text), "exact-prints")
    groups = materialize(merge_runs(prints, runs, fan_in).where("group_size > 1").withColumn("key", F.struct(*KEY)).drop(*KEY), "exact-groups")
    rows = join_hot(prints.select("doc_id", F.struct(*KEY).alias("key")), groups, "key", "group_size", prints.count(), "left")
    rows = rows.select("doc_id", F.col("key.digest").alias("digest"), F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    same = rows.where("group_size > 1 AND doc_id <=> keep_id").groupBy("doc_id", "digest").agg(F.count("*").alias("times"), F.first("group_size").alias("group_size"))
    return rows, materialize(same.where("times > 1"), "exact-again")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty, a very long text is one value like any
    other. The largest doc_id of a group stays; a null doc_id is smaller than any other. Of rows that repeat both id and
    text (or have no id) each counts in group_size and one is kept. Other columns of docs are not read, whatever their
    names. An empty table gives none. Texts are read once: fingerprints are written to the shared folder, and only
    groups of two rows or more are joined back.
    """
    with scratch() as keep:
        rows, again = _placed(docs, doc_id, text, runs, fan_in)
        if not again.isEmpty():  # rows alike in all that is returned: written anew as often as they are there, the first kept
            known = again.select(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest"))
            rest = rows.join(known, rows.doc_id.eqNullSafe(known.k_id) & (rows.digest == known.k_digest), "left_anti").withColumn("first", F.lit(True))
            parts = again.select("*", F.explode(F.expr(f"sequence(0L, times - 1, {CHUNK}L)")).alias("low")).repartition("digest", "low")
            copies = parts.select("doc_id", "digest", F.col("doc_id").alias("keep_id"), "group_size", F.explode(F.expr(f"sequence(low, least(times, low + {CHUNK}) - 1)")).alias("k"))
            rows = rest.unionByName(copies.select("doc_id", "digest", "keep_id", "group_size", (F.col("k") == 0).alias("first")))
        else:
            rows = rows.withColumn("first", F.lit(True))
        out = rows.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("first")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
        return keep(materialize(out, "exact-rows"))


def drop_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_groups doesn't keep, all columns kept, whatever their names.

    Of rows that repeat both id and text the one of least JSON stays. Nulls, ties, very long texts and empty tables are
    as in exact_groups. Rows stay where they are, but for those whose id may be one of a dropped row. docs is read three times.
    """
    with scratch() as keep:
        rows, again = _placed(docs, doc_id, text, RUNS, FAN_IN)
        gone = rows.where("group_size > 1 AND NOT (doc_id <=> keep_id)").select(F.col("doc_id").alias("g_id"), F.col("digest").alias("g_digest")).distinct()
        gone, again = keep(materialize(gone, "exact-gone")), keep(again)
    return drop_rows(docs, gone, again.select(F.col("doc_id").alias("g_id"), F.col("digest").alias("g_digest")), doc_id, text_digest(docs[text]))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND row_number() OVER (PARTITION BY body, doc_id) = 1 AS kept, sha256(body) AS text_sha256 FROM d JOIN g USING (body)
"""
