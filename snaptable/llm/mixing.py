"""Mixing sources to target weights: hash-threshold histograms, in DataFrame operations only.

Each document gets a 60-bit hash. A source's share is the documents whose hash lies below a threshold, found without
sorting documents: words are summed by source and the top 12 bits; of these sums a running sum over 64 groups of 64,
then over the 64 of one group, finds the bucket in which the budget ends; only that bucket is summed again by its next
12 bits, three times in all. Thresholds are nested: a larger budget takes every document that a smaller one takes.
The targets themselves are found in the same way, by histograms over sources (source_targets).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize, scratch, word_count

WEIGHTS, SHARE, CAP = (5, 2, 1), 150, 2
BITS, LEVELS, HASH_BITS = 12, 3, 60


def key_hash(key: Column, seed: str) -> Column:
    """60 bits of MD5 of seed and key; a null key is as the empty string."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def row_hash(doc_id: Column, text: Column, seed: str) -> Column:
    """60 bits of MD5 of seed, id and the text's digest: rows of one id, or of none, spread by their texts."""
    return key_hash(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))), seed)


def ranked(totals: DataFrame) -> DataFrame:
    """totals (one row per source) with rank, from 0 by code points, null last: sorted in ranges, each range counted, and
    what stands before it added to the places within it. No task has more than a range."""
    ranges = materialize(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "mix-ranges")
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n")).collect()  # one number for each partition
    upto, starts = 0, {}
    for r, n in sorted(map(tuple, sizes)):
        starts[r], upto = upto, upto + n
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    table = totals.sparkSession.createDataFrame([*starts.items()], "in_range int, start long")
    return ranges.join(F.broadcast(table), F.col("range") == F.col("in_range")).withColumn("rank", F.col("start") + place - 1).drop("range", "in_range", "start")


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE, cap: int = CAP) -> DataFrame:
    """From (source, source_size), one row per source: target.

    Sources in code point order, null last, get the weights in turn and share `share` percent of all words; none gets
    more than cap times its size, and what is cut off goes to the others by weight. This is water-filling: with a price
    t for a unit of weight a source gets min(cap * size, t * weight), and t is where all of that makes up the share.
    t is sought in histograms of cap * size / weight, 12 bits at a time: at most 4,096 exact sums a level reach the
    driver, however many sources there are. Sums are integers, and each target is one division.
    """
    lcm = 1
    for w in weights:
        lcm = lcm * w
    t = ranked(totals)
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).cast("long"))
    t = t.withColumn("cap", F.col("source_size") * cap)
    t = materialize(t.withColumn("q", F.col("cap") * (F.lit(lcm) / F.col("weight")).cast("long")), "mix-sources")
    words, top, free = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.max("q"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    # q below `low` is capped, and the price lies at low or above: capped = the caps below low, free = the weights from low on
    low, capped, shift, cut = 0, 0, top.bit_length(), 0
    while shift:
        step = max(0, shift - BITS)
        inside = t.where(F.shiftright("q", shift) == low >> shift)
        found, c, w = None, capped, free
        for k, more, less in sorted(map(tuple, inside.groupBy(F.shiftright("q", step).alias("k")).agg(F.sum("cap"), F.sum("weight")).collect())):
            if 100 * (c * lcm + (k << step) * w) > share * words * lcm:
                break
            found, capped, free = k, c, w
            c, w = c + more, w - less
        if found is None:  # the price lies below all that is in here
            cut = low - 1
            break
        low, shift = found << step, step
        if not shift:
            cut, capped, free = low, c, w
    even = F.col("cap").cast("double")
    if free:
        price = (F.col("weight") * F.lit(share * words - 100 * capped)).cast("double") / F.lit(float(100 * free))
        even = F.when(F.col("q") <= cut, even).otherwise(price)
    return t.select("source", "source_size", even.alias("target"))


def mix_plan(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE, cap: int = CAP) -> DataFrame:
    """From (source, size, hash): per source its size, n (rows), target, base (copies that every document gets) and `below`: documents whose hash >> (60 - 36) is below it get one more."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    with scratch() as keep:
        totals = materialize(totals, "mix-totals")
        counts, total = totals.select(F.col("source").alias("c_source"), F.col("n").alias("rows")), totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        plan = source_targets(totals.drop("n"), weights, share, cap)
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
        plan = plan.withColumn("base", whole)
        plan = plan.withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
        plan = materialize(plan.join(counts, plan.source.eqNullSafe(counts.c_source)).drop("c_source"), "mix-plan")
        # prefix: the bucket that is being refined, as the leading bits of the hash
        edge = plan.where("budget > 0").select("source", "budget", F.lit(0).cast("long").alias("prefix"), "rows")
        for level in range(1, LEVELS + 1):
            shift = HASH_BITS - BITS * level
            rows = _met(sizes, edge.withColumnRenamed("rows", "n"), "source", total).where(F.shiftright("hash", shift + BITS) == F.col("prefix"))
            sums = materialize(rows.groupBy("source", "budget", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n")), f"mix-sums-{level}")
            # the group of 64 buckets in which the running sum passes the budget, then the bucket in it
            groups = sums.groupBy("source", "budget", F.shiftright("bucket", BITS // 2).alias("part")).agg(F.sum("n").alias("n"))
            at = _passes(groups, "part").select(F.col("source").alias("g_source"), "part", "left")
            inner = sums.drop("budget").join(at, F.col("source").eqNullSafe(F.col("g_source")) & (F.shiftright("bucket", BITS // 2) == F.col("part"))).select("source", F.col("left").alias("budget"), "bucket", "n")
            last = _passes(inner, "bucket").select(F.col("source").alias("e_source"), F.col("left").alias("budget"), F.col("bucket").alias("prefix"), "n")
            last = materialize(last.join(counts, last.e_source.eqNullSafe(counts.c_source)).drop("c_source"), f"mix-edge-{level}")
            edge = last.select(F.col("e_source").alias("source"), "budget", "prefix", "rows")
        # the last bucket goes in if that comes nearer to the target
        below = F.col("prefix") + F.when(F.col("n") - F.col("budget") <= F.col("budget"), 1).otherwise(0)
        ends = last.select("e_source", below.alias("below"))
        full = F.when(F.col("plan_budget") > 0, F.lit(1 << (BITS * LEVELS))).otherwise(0)
        plan = plan.withColumnRenamed("budget", "plan_budget")
        return keep(materialize(plan.join(ends, plan.source.eqNullSafe(ends.e_source), "left").select("source", "source_size", F.col("rows").alias("n"), "target", "base", F.coalesce("below", full).cast("long").alias("below")), "mix-thresholds"))


def _passes(sums: DataFrame, bucket: str) -> DataFrame:
    """Of each source's sums n by bucket, at most 64, the first with which the running sum passes the budget; left: what of the budget is left before it."""
    run = Window.partitionBy("source").orderBy(bucket)
    over = sums.withColumn("upto", F.sum("n").over(run)).where("upto > budget").withColumn("k", F.row_number().over(run)).where("k = 1")
    return over.select("*", (F.col("budget") - (F.col("upto") - F.col("n"))).alias("left"))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    return docs.select(docs[doc_id].alias("doc_id"), docs[source].cast("string").alias("source"), word_count(docs[text].cast("string")).alias("size"), row_hash(docs[doc_id], docs[text], seed).alias("hash"))


def _copies() -> Column:
    return F.col("base") + F.when(F.shiftright("hash", HASH_BITS - BITS * LEVELS) < F.col("below"), 1).otherwise(0)


def _met(rows: DataFrame, plan: DataFrame, source: str, total: int) -> DataFrame:
    """rows with what plan, in which a source has n of the `total` rows, says of their source. Sources with 1/4096 of the rows or more, 4,096 at most, are broadcast; the rows of others meet them by a shuffle."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # noqa: E731  null is a key too
    mine = plan.select(key(F.col("source")).alias("p__key"), F.col("n").alias("p__n"), *[c for c in plan.columns if c not in ("source", "n")])
    return join_hot(rows.withColumn("p__key", key(F.col(source))), mine, "p__key", "p__n", total).drop("p__key", "p__n")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", weights: Sequence[int] = WEIGHTS, share: int = SHARE, cap: int = CAP) -> DataFrame:
    """One row per row of docs: doc_id, size (words, 0 for null), source_size, target (of its source), copies, taken.

    Null sources form one source. Documents without words get copies like any other and take 0 words. Rows alike in id
    and text share a hash: they are taken together; null ids are told apart by their texts. Sources without words have
    target 0. Very long texts are counted whole. An empty table gives an empty result; other columns aren't read.
    A source's taken words miss its target by less than the documents of one hash bucket, as a rule one document.
    """
    with scratch() as keep:
        sizes = keep(materialize(_sized(docs, doc_id, text, source, seed), "mix-sizes"))
        plan = keep(mix_plan(sizes, weights, share, cap))
    out = _met(sizes, plan, "source", sizes.count()).withColumn("copies", _copies())
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """The mix itself: every row of docs as often as it is taken (0, 1 or 2 times), with all its columns, whatever their
    names. Nulls, ties, repeated rows, long texts and empty tables are as in mix(). docs is read three times."""
    with scratch() as keep:
        sizes = materialize(_sized(docs, doc_id, text, source, seed), "mix-sizes")
        plan, total = keep(mix_plan(sizes)), sizes.count()
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source].cast("string").alias("source"), row_hash(docs[doc_id], docs[text], seed).alias("hash"))
    taken = _met(packed, plan, "source", total).withColumn("copies", _copies().cast("int")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
w AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM r),
o AS (SELECT *, row_number() OVER f AS i, coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wsum, sum(source_size) OVER () AS words
      FROM w WINDOW f AS (ORDER BY cap * (10 // weight), rank)),
p AS (SELECT *, 150 * words - 100 * before AS left_over FROM o),
q AS (SELECT *, min(CASE WHEN left_over * weight <= cap * 100 * wsum THEN i END) OVER () AS first_i FROM p),
u AS (SELECT *, max(CASE WHEN i = first_i THEN left_over END) OVER () AS pool, max(CASE WHEN i = first_i THEN wsum END) OVER () AS pool_w FROM q),
t AS (SELECT source, source_size, CASE WHEN first_i IS NULL OR i < first_i THEN cap::DOUBLE ELSE (weight * pool)::DOUBLE / (100 * pool_w)::DOUBLE END AS target FROM u),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
g AS (SELECT *, target - base * source_size::DOUBLE AS budget FROM b),
h AS (SELECT source, hash >> 24 AS bucket, sum(size) AS n FROM d GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM h),
e AS (SELECT c.source, c.bucket, g.budget > 0 AND (c.upto <= g.budget OR (c.upto - c.n <= g.budget AND c.upto - g.budget <= g.budget - (c.upto - c.n))) AS more
      FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source)
SELECT d.doc_id, d.size, g.source_size::BIGINT AS source_size, g.target, (g.base + e.more::INT)::BIGINT AS copies, (d.size * (g.base + e.more::INT))::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.hash >> 24 = e.bucket
"""
