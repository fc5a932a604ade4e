"""MinHash near-dedup with BagMinHash signatures: band, verify exact multiset overlap, connect.

Signatures. A text is the multiset of its five-word shingles (fewer than five words: one shingle). Every shingle d owns
a Poisson process over (time, weight, component). The weight axis is discretised into dyadic cells (0,1], (1,2], (2,4],
...; a text with d w times sees the cells below w whole, and of the cell that w splits the points that lie under w.
The time axis is split into slabs that double; the number of points of a cell in a slab is Poisson, drawn from a hash of
(d, cell, slab), and so are the points' times, weights and components. A component's value is the time of its first
point, and a text stops at the first slab after which all its components have one. Two texts agree in a component with
probability sum(min) / sum(max) of their counts: their weighted Jaccard similarity, without bias.

Links. Distinct texts (nodes) meet in buckets of equal bands. (1) Every member is held against its bucket's hub, the
smallest member. (2) The links found make components; in buckets with more than one, members of different components
that were not compared yet are compared, unless their distances to the hub differ by more than 1 - similarity (weighted
Jaccard distance is a metric, so such a pair can't be similar) or their shingle bitmaps differ in more bits than the
counts of similar texts can (each differing bit is at least one differing count). No similar pair that shares a bucket stays unconnected,
and a group of n copies costs n comparisons a bucket instead of n * n. A pair of similarity 0.8 misses all 36 bands of
7 with probability 0.0002; from 0.85 up, below 0.00001.
"""

from __future__ import annotations

from functools import lru_cache
from math import exp, lgamma, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, drop_rows, held, join_hot, map_texts, materialize, probable, scratch, ship, slices
from .exact import normalized

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 36, 7
FIRST_SLAB = 2.0**-12
MOST_WORDS = 150_000
#: Shingles of texts that are signed together.
BATCH = 40_000
#: Pairs of one text, or members of one bucket, that are dealt to one task.
MOST_PAIRS = 256


def node_key(text: Column) -> Column:
    """The node of a text: 128 bits of its form in lower case (A-Z), so that exact copies are signed into one node."""
    return F.unhex(F.md5(normalized(text).cast("binary")))


def _mix(x):
    """A finaliser over unsigned 64-bit arrays, in place."""
    import numpy as np

    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _unit(x):
    """Hashes as numbers in [0, 1)."""
    import numpy as np

    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


@lru_cache(256)
def _poisson(mean: float):
    """Distribution function of a Poisson variable as a table."""
    import numpy as np

    top = int(mean + 12 * mean**0.5 + 30)
    return np.cumsum([exp(k * log(mean) - mean - lgamma(k + 1)) for k in range(top)])


class Signer:
    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.m = bands, rows, bands * rows
        self.words: dict[bytes, int] = {}

    def word_hashes(self, words: list[bytes]):
        import numpy as np
        import xxhash

        if missing := {w for w in set(words) if w not in self.words}:
            if len(self.words) + len(missing) > MOST_WORDS:
                self.words.clear()
                missing = set(words)
            for w in missing:
                self.words[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: str | None):
        """(hash of each distinct shingle, its count)."""
        import numpy as np

        h = self.word_hashes((text or "").encode().lower().split())
        n = max(1, len(h) - SHINGLE + 1) if len(h) else 0
        s = np.full(n, min(len(h), SHINGLE), np.uint64)
        for k in range(min(SHINGLE, len(h))):
            s *= np.uint64(0x9E3779B97F4A7C15)
            s += h[k : k + n]
            _mix(s)
        return np.unique(s, return_counts=True)

    def sign(self, texts: list[str | None]):
        """(weights, band hashes or None) of texts."""
        weights, out, held, size = [], [], [], 0
        for t in texts:
            held.append(self.shingles(t))
            weights.append(int(held[-1][1].sum()))
            size += len(held[-1][0])
            if size > BATCH or len(held) >= 256:
                out += self._batch(held)
                held, size = [], 0
        return weights, out + self._batch(held)

    def _batch(self, bags):
        import numpy as np

        m, u64 = self.m, np.uint64
        sig = np.full(len(bags) * m, np.inf)
        if not bags:
            return []
        # cells: seed, log2 of the rate, text, weight of the shingle
        d = np.concatenate([s for s, _ in bags])
        w = np.concatenate([c for _, c in bags]).astype(np.int64)
        doc = np.repeat(np.arange(len(bags)), [len(s) for s, _ in bags])
        top = np.ceil(np.log2(np.maximum(w, 1))).astype(np.int64)
        at = np.repeat(np.arange(len(d)), top + 1)
        cell = np.arange(len(at)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
        seed = _mix(d[at] + (cell.astype(u64) + u64(1)) * u64(0xD1342543DE82EF95))
        rate = np.maximum(cell - 1, 0)
        doc, w = doc[at], w[at]
        open_ = np.array([len(s) > 0 for s, _ in bags])
        slab, start, width = 0, 0.0, FIRST_SLAB
        while True:
            live = open_[doc]
            if not live.all():
                seed, rate, doc, w, cell = seed[live], rate[live], doc[live], w[live], cell[live]
            if not len(seed):
                break
            salt = u64((slab + 1) * 0xA0761D6478BD642F & 2**64 - 1)
            draw = _mix(seed ^ salt)
            u = _unit(draw)
            for e in np.unique(rate):
                cdf = _poisson(m * width * 2.0 ** int(e))
                own = np.flatnonzero((rate == e) & (u >= cdf[0])) if e or rate.any() else np.flatnonzero(u >= cdf[0])
                n = np.searchsorted(cdf, u[own], side="right")
                for a in range(0, len(own), 4096):
                    self._points(sig, own[a : a + 4096], n[a : a + 4096], draw, cell, doc, w, start, width)
            done = np.isfinite(sig.reshape(-1, m)).all(1)
            open_ &= ~done
            slab, start, width = slab + 1, start + width, width if slab == 0 else width * 2
        bits = sig.view(u64).reshape(len(bags), self.bands, self.rows)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=u64), bits.shape[:2]).copy()
        for r in range(self.rows):
            key *= u64(0x9E3779B97F4A7C15)
            key += bits[:, :, r]
            _mix(key)
        key = key.view(np.int64)
        return [list(key[i]) if len(bags[i][0]) else None for i in range(len(bags))]

    def _points(self, sig, own, n, draw, cell, doc, w, start, width):
        """Put the points of the cells `own` (n each) into the signatures."""
        import numpy as np

        u64 = np.uint64
        who = np.repeat(own, n)
        k = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        a = _mix(draw[who] + (k.astype(u64) + u64(1)) * u64(0x8EBC6AF09C88C6E3))
        c = cell[who]
        split = np.flatnonzero((c > 0) & (w[who] < 2**c))
        if len(split):  # cells that the weight splits: of their points, those under the weight
            half = 2.0 ** (c[split] - 1)
            under = half * (1 + _unit(_mix(a[split] ^ u64(0x589965CC75374CC3)))) <= w[who[split]]
            keep = np.ones(len(who), bool)
            keep[split[~under]] = False
            who, a = who[keep], a[keep]
        comp = (a >> u64(33)).astype(np.int64) % self.m
        time = start + width * _unit(_mix(a ^ u64(0x1D8E4E27C47D124F)))
        np.minimum.at(sig, doc[who] * self.m + comp, time)


def _signer(bands: int, rows: int) -> Signer:
    return held(Signer, bands, rows)


def bitmap(signer: Signer, text: str | None):
    """The text's distinct shingles as bits of a power of two, at least 8 and below 16 for each of its shingles (64-bit
    words), and the same folded to half its length: texts of nearly one size can then be compared at one length."""
    import numpy as np

    s, n = signer.shingles(text)
    words = max(2, 1 << (int(n.sum()) * 8 - 1).bit_length()) // 64 if len(s) else 0
    words = max(2, words)
    out = np.zeros(words, np.uint64)
    at = (s >> np.uint64(7)).astype(np.int64) & words * 64 - 1
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out.view(np.int64), (out[: words // 2] | out[words // 2 :]).view(np.int64)


def _apart(a: Column, b: Column) -> Column:
    """Number of bits in which two arrays of words differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)


def overlap(a: str, b: str) -> float:
    """sum(min) / sum(max) of the counts of five-word shingles; words themselves are compared, not hashes."""
    import numpy as np

    ids: dict[bytes, int] = {}
    bags = []
    for t in (a, b):
        words = t.encode().lower().split()
        bags.append(np.array([ids.setdefault(x, len(ids)) for x in words], np.int64))
    if not (len(bags[0]) and len(bags[1])):
        return 0.0
    if min(map(len, bags)) < SHINGLE:
        return float(len(bags[0]) == len(bags[1]) and (bags[0] == bags[1]).all())
    na, k = len(bags[0]) - SHINGLE + 1, len(ids) + 1
    key = np.concatenate([x[: len(x) - SHINGLE + 1] for x in bags])
    for j in range(1, SHINGLE):
        key = key * k + np.concatenate([x[j : len(x) - SHINGLE + 1 + j] for x in bags])
        if j < SHINGLE - 1 and k ** (j + 2) >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
    both, at = np.unique(key, return_inverse=True)
    x, y = np.bincount(at[:na], minlength=len(both)), np.bincount(at[na:], minlength=len(both))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def _verify(pairs: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b) -> (a, b, sim), a few megabytes of texts at a time."""

    def run(batches):
        for batch in batches:
            for start, n in slices(batch.column(2), batch.column(3)):
                t = batch.slice(start, n)
                sims = [overlap(x.as_py() or "", y.as_py() or "") for x, y in zip(t.column(2), t.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    ship(pairs.sparkSession)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, sim double")


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """(a, b) -> (node, comp) for every node with a link, comp the smallest node: alternating large-star and small-star.

    Each step gives every node the least neighbour by one aggregation and one join; nothing but two numbers a round
    reaches the driver. Centres of many links are broadcast (join_hot), so no task gets all of a centre's links. Each
    round's links are written to the shared folder and read from there; the tables of earlier rounds are deleted.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), label)

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    def stars(rows: DataFrame, centre: str, other: str, total: int) -> DataFrame:
        """rows (all links of each centre) with the least neighbour m of its centre."""
        least = materialize(rows.groupBy(F.col(centre).alias("c")).agg(F.min(other).alias("m"), F.count("*").alias("n")), label)
        return join_hot(rows, least.withColumnRenamed("c", centre), centre, "n", total)

    seen = mark(now)
    while seen[0]:
        with scratch() as keep:
            both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = stars(both, "u", "v", 2 * seen[0]).where("v > u").select("v", F.least("m", "u").alias("u")).where("u <> v").distinct()
            large = materialize(large, label)
            small = stars(large, "v", "u", 2 * seen[0])  # of more links fewer centres are hot
            nxt = small.select("v", F.col("m").alias("u")).unionByName(small.select(F.col("u").alias("v"), F.col("m").alias("u"))).where("u <> v").distinct()
            nxt = keep(materialize(nxt, label))
        discard(now)
        now = nxt
        if (mine := mark(now)) == seen:
            break
        seen = mine
    return now.select(F.col("v").alias("node"), F.col("u").alias("comp")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct())


def near_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): nodes has node, rep (smallest doc_id), n (rows) of each distinct text; links has a, b, sim of similar nodes."""

    def make():
        s = _signer(bands, rows)
        return lambda texts: s.sign(texts)

    base = docs.select(docs[doc_id].alias("doc_id"), node_key(docs[text]).alias("node"), docs[text].cast("string").alias("text"))
    fields = [("weight", T.LongType(), pa.int64()), ("bands", T.ArrayType(T.LongType()), pa.list_(pa.int64()))]
    signed = map_texts(base, make, fields, "text", ["doc_id", "node"])
    nodes = materialize(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("weight").alias("weight"), F.first("bands").alias("bands")), "near-nodes")
    spots = nodes.where("weight > 0").select("node", "weight", F.explode("bands").alias("key"))
    # buckets of two nodes or more: hub, and how many members
    buckets = spots.groupBy("key").agg(F.min(F.struct("node", "weight")).alias("hub"), F.count("*").alias("size")).where("size > 1").select("key", F.col("hub.node").alias("hub"), F.col("hub.weight").alias("hub_weight"), "size")
    buckets = materialize(buckets, "near-buckets")
    some = spots.where(probable(F.col("key"), buckets.select("key")))
    members = materialize(join_hot(some, buckets, "key", "size", buckets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]).where("node <> hub"), "near-members")
    alike = lambda x, y: F.least(x, y) >= F.greatest(x, y) * similarity
    first = materialize(members.where(alike(F.col("weight"), F.col("hub_weight"))).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    # texts of the nodes in such buckets, one row each; other texts stay where they are
    wanted = members.select("node").unionByName(members.select(F.col("hub").alias("node"))).distinct()
    named = materialize(wanted.join(nodes.select("node", "rep"), "node").select(F.col("node").alias("want"), "rep"), "near-named")
    may = base.where(probable(F.xxhash64("doc_id"), named.select(F.xxhash64("rep").alias("h"))))
    texts = may.join(named, (F.col("node") == F.col("want")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")
    texts = materialize(texts.groupBy("node").agg(F.first("text").alias("text")), "near-texts")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """pairs (a, b) with their similarity. A text that many pairs have as a is sent once for each MOST_PAIRS of them."""
        degree = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")), f"{label}-degree")
        total = pairs.count()
        salted = join_hot(pairs, degree, "a", "n", total).withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / MOST_PAIRS)))
        left = texts.join(degree.withColumnRenamed("a", "node"), "node").select(F.col("node").alias("a"), F.col("text").alias("text_a"), F.explode(F.expr(f"sequence(0L, ceil(n / {MOST_PAIRS}) - 1)")).alias("salt"))
        right = salted.drop("n").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return materialize(_verify(right.join(left, ["a", "salt"])), label)

    sims = verified(first, "near-sims-1")
    links = sims.where(F.col("sim") >= similarity)
    comp = materialize(components(links, "near-comp-1"), "near-comp-1")
    # buckets whose members are not all in one component; big: the one that most of a bucket's members are in
    own = lambda rows: rows.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    hubs = members.select("key", F.col("hub").alias("node"), F.col("hub_weight").alias("weight"), "hub", "size").distinct()
    placed = materialize(own(members.select("key", "node", "weight", "hub", "size").unionByName(hubs.select("key", "node", "weight", "hub", "size"))), "near-placed")
    held = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = held.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("n").alias("members")).where("comps > 1").select("key", F.col("top.comp").alias("big"), "members")
    mixed = materialize(mixed, "near-mixed")
    some = placed.where("node <> hub").join(sims.select(F.col("a").alias("hub"), F.col("b").alias("node"), "sim"), ["hub", "node"], "left")
    apart = join_hot(materialize(some, "near-held"), mixed, "key", "members", placed.count())
    apart = materialize(apart.select("key", "node", "weight", "size", "comp", "sim", (F.col("comp") != F.col("big")).alias("minor")), "near-apart")

    def make_bits():
        signer = _signer(bands, rows)
        return lambda ts: list(zip(*(bitmap(signer, t) for t in ts), strict=True)) if ts else [[], []]

    longs = T.ArrayType(T.LongType()), pa.list_(pa.int64())
    bits = map_texts(texts.join(apart.select("node").distinct(), "node", "left_semi"), make_bits, [("bits", *longs), ("half", *longs)], "text", ["node"])
    apart = apart.join(materialize(bits, "near-bits"), "node").join(nodes.select("node", "bands"), "node")
    # a bucket is dealt to as many tasks as it has MOST_PAIRS members; its minor members go to each of them
    deals = F.ceil(F.col("size") / MOST_PAIRS)
    x = apart.where("minor").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1))).alias("x")
    y = apart.withColumn("deal", F.pmod(F.xxhash64("node"), deals)).alias("y")
    near = F.col("x.sim").isNull() | F.col("y.sim").isNull() | (F.abs(F.col("x.sim") - F.col("y.sim")) <= 1 - similarity + 1e-9)
    long_x, long_y = F.size("x.bits"), F.size("y.bits")
    differ = F.when(long_x == long_y, _apart(F.col("x.bits"), F.col("y.bits"))).when(long_x == 2 * long_y, _apart(F.col("x.half"), F.col("y.bits"))).when(long_y == 2 * long_x, _apart(F.col("x.bits"), F.col("y.half"))).otherwise(0)
    few = differ * (1 + similarity) <= (1 - similarity) * (F.col("x.weight") + F.col("y.weight")) + 1e-6
    once = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.key")
    # no two members of the big component meet here, so a large group with a few strangers costs its size, not its square
    other = (F.col("x.comp") != F.col("y.comp")) & (~F.col("y.minor") | (F.col("x.node") < F.col("y.node")))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.deal") == F.col("y.deal")) & other & alike(F.col("x.weight"), F.col("y.weight")) & near & few & once)
    rest = materialize(rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).join(first, ["a", "b"], "left_anti"), "near-rest")
    return nodes, links.unionByName(verified(rest, "near-sims-2").where(F.col("sim") >= similarity))


def _tied(docs: DataFrame, doc_id: str, text: str, similarity: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, classes): of nodes in a class of two rows or more, classes has the class and the node's rows, links and best similarity."""
    nodes, links = near_links(docs, doc_id, text, similarity, bands, rows)
    comp = components(links.select("a", "b"), "near-comp")
    ends = links.select(F.col("a").alias("node"), "sim").unionByName(links.select(F.col("b").alias("node"), "sim")).groupBy("node").agg(F.count("*").alias("n_links"), F.max("sim").alias("nearest"))
    tied = nodes.select("node", "rep", "n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    tied = materialize(tied, "near-tied")
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("first")
    sizes = tied.groupBy("comp").agg(first, F.sum("n").alias("class_size"), F.count("*").alias("texts")).where("class_size > 1")
    classes = join_hot(tied.select("node", "n", "comp"), materialize(sizes, "near-sizes"), "comp", "texts", tied.count()).join(ends, "node", "left")
    classes = classes.select("node", "n", F.col("first.rep").alias("class_rep"), F.col("first.node").alias("class_node"), "class_size", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "nearest")
    return nodes, materialize(classes, "near-classes")


def _rows(docs: DataFrame, doc_id: str, text: str, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, node) with what classes says of its node."""
    rows = materialize(docs.select(docs[doc_id].alias("doc_id"), node_key(docs[text]).alias("node")), "near-ids")
    return join_hot(rows, classes, "node", "n", nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "left")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id of its class), class_size (rows), kept, n_links, similarity, node.

    A class is what links of similarity `similarity` or more over five-word shingles connect; words are runs of other
    than white space, A-Z in lower case. kept: the class's row of smallest doc_id stays. A null doc_id counts as larger
    than any other. Texts without words (null, empty) are classed with texts of exactly the same form only. Texts of one
    to four words are similar if they have the same words in order. Rows that repeat both id and text are marked alike
    (drop_near keeps one). n_links: the other texts that this one was compared with and found similar to, which are
    enough to connect every class, not all there are; similarity: the greatest over them, 1 where rows have the same
    text, null without any. Other columns are not read, whatever their names; an empty table gives an empty result.
    Very long texts are signed and compared whole, one after the other.
    """
    with scratch() as keep:
        nodes, classes = _tied(docs, doc_id, text, similarity, bands, rows)
        rows_ = _rows(docs, doc_id, text, nodes, classes)
        alone = F.col("class_size").isNull()
        kept = alone | (F.col("doc_id").eqNullSafe(F.col("class_rep")) & (F.col("node") == F.col("class_node")))
        out = rows_.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_rep")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), kept.alias("kept"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("n") > 1, 1.0).otherwise(F.col("nearest")).alias("similarity"), "node")
        return keep(materialize(out, "near-rows"))


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that near_groups drops, all columns kept, whatever their names; of rows that repeat both id
    and text the one of least JSON stays. Nulls, ties, long texts and empty tables are as in near_groups. Rows stay where
    they are, but for those whose id may be one of a dropped row. docs is read five times."""
    with scratch() as keep:
        groups = near_groups(docs, doc_id, text)
        keys = F.col("doc_id").alias("g_id"), F.col("node").alias("g_digest")
        gone = keep(materialize(groups.where("NOT kept").select(*keys).distinct(), "near-gone"))
        again = keep(materialize(groups.where("kept AND class_size > 1").groupBy(*keys).count().where("count > 1").select("g_id", "g_digest"), "near-again"))
    return drop_rows(docs, gone, again, doc_id, node_key(docs[text]))
