"""Operators over a whole table, against brute force on small fixtures."""

import hashlib
import random
import textwrap
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from snaptable.llm import chat, cotrain, exact, licenses, minhash, mixing
from snaptable.llm.queries import op9_license_scan

SF = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(t):
    return (t or "").translate(LOW)


# -- exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out, seen = [], set()
    for r in rows:
        g = groups[norm(r[1])]
        keep = max((i for i in g if i is not None), default=None)
        out.append((r[0], keep, len(g), r[0] == keep and norm(r[1]) not in seen, hashlib.sha256(norm(r[1]).encode()).hexdigest()))
        if out[-1][3]:
            seen.add(norm(r[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("runs,fan_in", [(16, 2), (64, 8), (5, 2), (1, 8)])
def test_exact(docs, fixture_rows, clashing, none, runs, fan_in):
    assert sorted(map(tuple, exact.exact_groups(docs, runs=runs, fan_in=fan_in).collect()), key=str) == brute_exact(fixture_rows)
    if runs == 16:
        assert sorted(map(tuple, exact.exact_groups(clashing).collect()), key=str) == brute_exact(fixture_rows)
        assert exact.exact_groups(none).count() == 0


def test_exact_hot_group(spark):
    df = spark.range(0, 3000, 1, 7).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("text"))
    got = {r.doc_id: r for r in exact.exact_groups(df).collect()}
    assert sum(r.kept for r in got.values()) == 2001 and got[0].keep_id == 2997 and got[0].group_size == 1000 and got[1].group_size == 1


def test_exact_repeated_rows(spark, monkeypatch):
    """Of 700 rows alike and 300 without an id one each is kept, in chunks of any size; other columns may be maps."""
    monkeypatch.setattr(exact, "CHUNK", 256)
    df = spark.range(0, 1000, 1, 5).select(F.when(F.col("id") < 700, 7).cast("long").alias("doc_id"), F.when(F.col("id") < 700, "Same").otherwise("none").alias("text"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    assert Counter(map(tuple, exact.exact_groups(df).select("doc_id", "keep_id", "group_size", "kept").collect())) == {(7, 7, 700, True): 1, (7, 7, 700, False): 699, (None, None, 300, True): 1, (None, None, 300, False): 299}
    out = exact.drop_exact(df)
    assert out.columns == df.columns and sorted((r.doc_id or 0, r.m["k"]) for r in out.collect()) == [(0, 700), (7, 0)]


def test_exact_stage(docs, clashing, fixture_rows, none):
    want = sorted((r[0] if r[0] is not None else -1) for r in brute_exact(fixture_rows) if r[3])
    for df in (docs, clashing):
        out = exact.drop_exact(df)
        assert out.columns == df.columns and sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect()) == want
    assert exact.drop_exact(none).count() == 0


# -- near dedup


def bag(t):
    w = norm(t).encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_near(rows, least=0.8):
    texts = sorted({norm(r[1]) for r in rows})
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both >= least * sum((bags[i] | bags[j]).values()) - 1e-12:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for r in rows:
        groups[find(texts.index(norm(r[1])))].append(r[0])
    none_last = lambda g: min((i for i in g if i is not None), default=None)
    return sorted(((r[0], none_last(g), len(g)) for r in rows for g in [groups[find(texts.index(norm(r[1])))]]), key=str)


def test_near(docs, fixture_rows, clashing, none):
    want = brute_near(fixture_rows)
    got = minhash.near_groups(docs)
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got.collect()), key=str) == want
    for r in got.collect():
        assert r.kept == (r.doc_id == r.class_id)
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in minhash.near_groups(clashing).collect()), key=str) == want
    assert minhash.near_groups(none).count() == 0
    out = minhash.drop_near(clashing)
    assert out.columns == clashing.columns
    ids = [r.doc_id for r in out.collect()]
    assert set(ids) == {c for _, c, _ in want} and minhash.drop_near(none).count() == 0


def test_near_family(spark):
    """Copies of a text with ever more edits: links among copies that the hub isn't near to are found too."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    rows, n = [], 0
    for size in (120, 250):
        base = [word() for _ in range(size)]
        for _ in range(60):
            ws = list(base)
            for i in rng.sample(range(size), rng.randint(1, size // 20)):
                ws[i] = word()
            rows.append((n, " ".join(ws), None, None, 0))
            n += 1
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in minhash.near_groups(df).collect()), key=str)
    want = brute_near(rows)
    assert len({c for _, c, _ in want}) > 2
    assert got == want


def similar_pairs(texts, queries, least=0.8):
    """All pairs (query, other) of different texts at `least` or more, by an index of shingles: no signatures."""
    bags = {i: bag(t) for i, t in texts.items()}
    index = defaultdict(list)
    for i, b in bags.items():
        for g in b:
            index[g].append(i)
    for q in queries:
        for j in {j for g in bags[q] for j in index[g]} - {q}:
            both = sum((bags[q] & bags[j]).values())
            if both >= least * (sum(bags[q].values()) + sum(bags[j].values()) - both) - 1e-12:
                yield q, j


def test_near_recall(spark):
    """On the test tables: of the similar pairs of every row, found without signatures, at least 0.9 share a class (in fact all), and no class holds an unlinked text."""
    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in minhash.near_groups(docs).collect()}
    pairs = list(similar_pairs(texts, texts))
    met = sum(got[a].class_id == got[b].class_id for a, b in pairs)
    assert len(pairs) >= 20 and met >= 0.9 * len(pairs)
    linked = defaultdict(set)
    for a, b in pairs:
        linked[a].add(b)
    same = defaultdict(set)
    for i, t in texts.items():
        same[norm(t)].add(i)
    for i, r in got.items():
        alike = same[norm(texts[i])] - {i}
        assert (r.class_size > 1) <= bool(linked[i] | alike)
        assert r.n_links <= len({norm(texts[j]) for j in linked[i]} - {norm(texts[i])}) and (r.similarity is None) == (not r.n_links and not alike)


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(5)
    s = minhash.Signer(bands=600, rows=1)
    for size, k, times in ((300, 6, 1), (300, 20, 1), (12, 2, 1), (40, 3, 25), (3000, 300, 1)):
        ws = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        v = list(ws)
        for i in rng.sample(range(size), k):
            v[i] = f"x{i}"
        a, b = " ".join(ws * times), " ".join(v * max(1, times - 5))
        _, (x, y) = s.sign([a, b])
        true = minhash.overlap(a, b)
        assert abs(np.mean(np.array(x) == np.array(y)) - true) < 4 * (true * (1 - true) / 600) ** 0.5 + 0.01, (size, k, times, true)
    one, many = s.sign([a])[1], s.sign(["other text here to go first", a, b])[1]
    assert one[0] == many[1]  # a signature doesn't depend on its company


def test_overlap():
    for a, b in (("a b c d e f", "a b c d e g"), ("a b", "a b"), ("a b", "a c"), ("x " * 50, "x " * 40), ("", "a")):
        x, y = bag(a), bag(b)
        assert minhash.overlap(a, b) == pytest.approx(sum((x & y).values()) / max(1, sum((x | y).values())))
    wide = " ".join(map(str, range(20_000)))
    assert minhash.overlap(wide, wide + " end") == pytest.approx(19996 / 19997)


def test_components(spark):
    rng = random.Random(9)
    key = lambda i: i.to_bytes(4, "big")
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, i) for i in range(301, 360)]
    parent = list(range(400))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    df = spark.createDataFrame([(bytearray(key(a)), bytearray(key(b))) for a, b in edges], "a binary, b binary")
    got = {bytes(r.node): bytes(r.comp) for r in minhash.components(df).collect()}
    assert got == {key(i): key(find(i)) for i in {i for a, b in edges if a != b for i in (a, b)}}
    assert minhash.components(df.where("false")).count() == 0


# -- mixing


def fill(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Targets by sharing again and again what is cut off."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= cap * sizes[s]
        free -= over
    return target


@pytest.fixture(scope="module")
def mixture(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 80])), rng.choice(["hot"] * 5 + ["a", "b", "B", "é", "z", None, "tiny" if i % 200 == 0 else "a"])) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), rows


def test_mix(mixture):
    df, rows = mixture
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken, source = fill(sizes), Counter(), {i: s for i, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.size == len(rows[r.doc_id][1].split())
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
        taken[s] += r.taken
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 80, s
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect())) == sorted(map(tuple, got))
    copies = {r.doc_id: r.copies for r in got}
    assert Counter(r.doc_id for r in mixing.mixed_rows(df).collect()) == Counter({i: c for i, c in copies.items() if c})


@pytest.mark.parametrize("share,cap", [(150, 2), (40, 1), (100, 1), (130, 1), (199, 2), (0, 2)])
def test_mix_targets(spark, share, cap):
    """Targets of many sources, of equal, tiny and huge sizes, by one histogram after another; ranks without one task for all."""
    rng = random.Random(share)
    sizes = {f"s{i:05d}": rng.choice([0, 1, 7, rng.randrange(100), rng.randrange(10**9), 10**13]) for i in range(3000)} | {None: 5, "": 0, "é": 12, "Z": 12, "z": 12}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
    got = {r.source: r.target for r in mixing.source_targets(df, share=share, cap=cap).collect()}
    want = fill(sizes, share=share / 100, cap=cap)
    assert got.keys() == sizes.keys() and all(got[s] == pytest.approx(want[s], rel=1e-9) for s in sizes)
    ranks = {r.source: r["rank"] for r in mixing.ranked(df).collect()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    assert ranks == {s: i for i, s in enumerate(order)}
    assert [tuple(r) for r in mixing.source_targets(df.where("source = 'z'")).collect()] == [("z", 12, 18.0)] and mixing.source_targets(df.where("false")).count() == 0


def test_mix_many_sources(spark):
    """100,000 sources and a hot one, which comes near its target; the result needs no task that holds all rows."""
    df = spark.range(0, 150_000, 1, 4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id")).cast("string")).alias("source"))
    got = mixing.mix(df)
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    by = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).where("n > 40000").collect()
    assert len(by) == 1 and abs(by[0].taken - by[0].target) <= 6 and got.count() == 150_000


def test_mix_without_ids(spark):
    """Rows without an id, and rows of one id, are told apart by their texts."""
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 5).cast("long").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id")).alias("text"), F.when(F.col("id") % 4 < 2, "a").alias("source"))
    by = mixing.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 4 for r in by)


def test_mix_thresholds_are_nested(mixture):
    df, _ = mixture
    small = {r.doc_id: r.copies for r in mixing.mix(df, share=60).collect()}
    large = {r.doc_id: r.copies for r in mixing.mix(df, share=110).collect()}
    assert all(small[i] <= large[i] for i in small) and small != large


def test_mix_edges(docs, fixture_rows, clashing, none):
    a = sorted((tuple(r) for r in mixing.mix(docs).collect()), key=str)
    assert len(a) == len(fixture_rows) and a == sorted((tuple(r) for r in mixing.mix(clashing).collect()), key=str)
    out = mixing.mixed_rows(clashing)
    assert out.columns == clashing.columns and out.count() == sum(r.copies for r in mixing.mix(docs).collect())
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0
    assert {r.taken for r in mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}


# -- chat


TALKS = [
    (1, 0, "system", "be <|brief|> \\"), (1, 1, "user", "hi"), (1, 2, "assistant", "<|im_end|>\n<|im_start|>user<|im_sep|>\\<|x"), (1, 3, "assistant", ""), (1, 4, "user", None),
    (2, 5, "user", "only\nme"), (3, 1, "assistant", "é😀\\\\<|"), (3, 1, "assistant", "é😀\\\\<|"), (3, None, None, "no turn"), (None, 1, "assistant", "no id"), (4, 2, "a<|b\\\n", "odd role"), (4, 3, "assistant", "x" * 3000),
]


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").repartition(3)


def test_chat_round_trip(talks):
    ordered = defaultdict(list)
    for c, t, r, x in TALKS:
        ordered[c].append(((t is not None, t or 0), r or "", x or ""))
    examples = chat.expand(talks)
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    rows = sorted(examples.collect(), key=lambda r: (str(r.conv_id), r.example))
    assert back.keys() == ordered.keys()
    for c, turns in ordered.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        b = back[c]
        assert (b.n_turns, b.turns_sha256, b.loss_chars, b.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        mine = [r for r in rows if r.conv_id == c]
        assert b.formatted_chars == sum(len(r.formatted) for r in mine) and b.n_examples == len(mine)
        assert [r.kind for r in mine].count("target") == sum(r == "assistant" for _, r, _ in turns) and sum(r.is_whole for r in mine) == 1
        for r in mine:
            assert mine[-1].formatted.startswith(r.formatted) and r.formatted.count("<|im_start|>") == r.example + 1
            span = r.formatted[r.loss_start : r.loss_end]
            assert "<|" not in span and (r.kind == "tail" or r.formatted[r.loss_end :] == "<|im_end|>\n")


def test_chat_sql(spark, talks):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("conversations", talks.toPandas())
    cur = con.execute(chat.SQL)
    names = [d[0] for d in cur.description]
    plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) else v
    want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r) for r in chat.read_back(chat.expand(chat.with_probe(talks))).select(*names).collect()), key=str) == want


def test_chat_very_long(spark):
    """A text of two million code points and 300 turns, read back whole."""
    long = "é<|\\" * 500_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, i, "assistant" if i % 2 else "user", f"t{i}<|") for i in range(300)]
    back = {r.conv_id: r for r in chat.read_back(chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert back[1].loss_chars == len(long) and back[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and back[2].n_turns == 300 and back[2].n_examples == 150


def test_chat_edges(talks):
    assert chat.expand(talks.where("false")).count() == chat.read_back(chat.expand(talks.where("false"))).count() == 0
    more = talks.select("*", *[F.lit(1).alias(c) for c in ("parts", "whole", "ends", "pos", "cut", "last", "t", "example")])
    assert sorted(map(str, chat.expand(more).collect())) == sorted(map(str, chat.expand(talks).collect()))
    probe = chat.read_back(chat.expand(chat.with_probe(talks))).where("conv_id = -1").first()
    assert probe.loss_chars == len("<|im_end|><|im_start|>assistant ok") and probe.n_turns == 2


# -- quality classifier


def labelled(n, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        ws = [word() for _ in range(rng.randint(60, 200))]
        if not good:
            ws = rng.choice([[w.upper() + "!!" for w in ws], [w + "%%%" for w in ws], [w for w in ws[:10] for _ in range(12)]])
        docs.append((i, " ".join(ws), "en", "farm" if not good and rng.random() < 0.8 else rng.choice("abc"), sum(map(len, ws))))
        labels.append((i, int(good), 0))
    return docs, labels


class ArrayPool:
    """The pool in memory, row by row: what Pool's jobs have to give."""

    def __init__(self, dense, cells):
        self.dense, self.at = np.array(dense, float), list(cells)
        self.cells = np.bincount(self.at, minlength=cotrain.CELLS)

    def z(self, model):
        return [int(np.floor(max(-30, min(30, float((model.design(x[None]) @ model.w)[0]))) * 20)) + 600 for x in self.dense]

    def histogram(self, model):
        n = Counter(self.z(model))
        return np.array([n[k] for k in range(cotrain.BINS)])

    def sure_cells(self, model, zero, one):
        out = np.zeros((2, cotrain.CELLS))
        for z, c in zip(self.z(model), self.at):
            if z <= zero or z >= one:
                out[int(z >= one)][c] += 1
        return out

    def text_sums(self, model, taught, weights):
        g, h = 0, 0
        for x, c in zip(self.dense, self.at):
            if taught[c] >= 0:
                d = model.design(x[None])[0]
                p = 1 / (1 + np.exp(-d @ model.w))
                g, h = g + weights[taught[c]] * (taught[c] - p) * d, h + weights[taught[c]] * max(p * (1 - p), 1e-6) * np.outer(d, d)
        return (g, h) if np.ndim(g) else (np.zeros(len(model.w)), np.zeros((len(model.w),) * 2))


def test_classifier(spark):
    docs, labels = labelled(900)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels[:300] + [(5000 + i, 1, 0) for i in range(500)], "doc_id long, quality int, toxic int")  # labels without a document take no place
    model = cotrain.fit(d, lab, most_labelled=300)
    assert model.log[0] == (0, 0) and max(model.log[-1]) > 0  # views taught each other
    got = {r.doc_id: r for r in cotrain.classify(d, model).collect()}
    assert len(got) == 900
    hit = [got[i].kept == bool(q) for i, q, _ in labels[300:]]
    assert sum(hit) / len(hit) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    again = cotrain.fit(d.repartition(5), lab.repartition(2), most_labelled=300)
    assert np.allclose(again.text.w, model.text.w, atol=1e-6) and again.log == model.log
    both = {r.doc_id: r.score for r in cotrain.fit_and_classify(d, lab).collect()}
    assert all(abs(both[i] - r.score) < 1e-6 for i, r in got.items())
    # the same by brute force over rows in memory
    rows = cotrain.with_labels(cotrain.features(d), lab)
    few = cotrain.sample(rows, 300).collect()
    pool = rows.where("label IS NULL").collect()
    plain = cotrain.co_train([r.dense for r in few], [r.cell for r in few], [r.label for r in few], ArrayPool([r.dense for r in pool], [r.cell for r in pool]))
    assert plain.log == model.log and np.allclose(plain.text.w, model.text.w, atol=1e-5) and np.allclose(plain.meta.w, model.meta.w, atol=1e-5) and plain.prior == model.prior
    assert len(cotrain.sample(rows, 50).collect()) == 50 and len(few) == 300 and len(pool) == 600


def test_classifier_has_no_cap(spark):
    """Every unlabelled document that a view is sure of teaches, however many there are: ten times the rows, ten times the taught."""
    docs, labels = labelled(400)
    lab = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    rows = cotrain.features(d)
    free = F.col("doc_id") >= 200
    many = rows.where(~free).unionByName(rows.where(free).crossJoin(spark.range(120)).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("id")).drop("id"))
    a, b = cotrain.fit_rows(rows, lab), cotrain.fit_rows(many, lab)
    assert sum(a.log[1]) > 0 and b.log[1] == tuple(120 * n for n in a.log[1]) and sum(b.log[1]) > 2000


@pytest.mark.parametrize("n", [4, 9, 10, 48, 49, 50, 51, 80])
def test_classifier_calibrates_at_every_size(spark, n):
    """No number of labels at which calibration starts: each class holds out every fifth, and the fewer there are the less they change."""
    rng = np.random.default_rng(n)
    y = np.arange(n) % 2
    x = rng.normal(size=(n, cotrain.DENSE)) + 2 * y[:, None]
    model = cotrain.co_train(x, np.zeros(n, int), y, ArrayPool(np.zeros((0, cotrain.DENSE)), []))
    assert (model.text.a, model.text.b) == (1, 0) if n < 9 else model.text.a != 1
    assert ((model.score(x, np.zeros(n, int)) > 0.5) == y).mean() > 0.9


def test_surest():
    n = np.zeros(cotrain.BINS, int)
    n[[0, 1, 500, 669, 670, 700, 1199, 1200]] = 5
    assert cotrain.surest(n, 1) == (0, 1200) and cotrain.surest(n, 6) == (1, 1199) and cotrain.surest(n, 11) == (500, 700)
    zero, one = cotrain.surest(n, 10**9)
    p = lambda b: 1 / (1 + np.exp(-(b - 600) / 20))
    assert p(one) >= cotrain.SURE > p(one - 1) and p(zero + 1) <= 1 - cotrain.SURE < p(zero + 2)


def test_cells(spark):
    import zlib

    rows = [(a, b, n) for a in (None, "", "en", "é") for b in (None, "src1", "z" * 300) for n in (None, -4, 0, 1, 2, 3, 4, 1000, 2**40)]
    df = spark.createDataFrame(rows, "lang string, source string, n_chars long")
    for r in df.select("*", cotrain.cell(F.col("lang"), F.col("source"), F.col("n_chars")).alias("c")).collect():
        spot = lambda x, n: 0 if x is None else 1 + zlib.crc32(x.encode()) % (n - 1)
        size = 0 if r.n_chars is None else min(23, 1 + max(0, r.n_chars).bit_length())
        assert r.c == (spot(r.lang, 16) * 64 + spot(r.source, 64)) * 24 + size
    assert cotrain.one_hot([0, cotrain.CELLS - 1]).sum() == 6


def test_classifier_edges(spark, docs, clashing, none, fixture_rows):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = cotrain.fit(docs, empty)
    assert {r.score for r in cotrain.classify(docs, model).collect()} == {0.5}
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(3, None, None), (None, 1, 1), (4, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    model = cotrain.fit(clashing, lab)
    assert cotrain.classify(clashing, model).count() == len(fixture_rows)
    assert cotrain.classify(none, model).count() == 0 and cotrain.fit(none, lab).text is None
    ones = spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    assert cotrain.fit(docs, ones).score(np.zeros((1, 24)), [0])[0] == 1


# -- licenses


FILES = [
    (1, "/lib/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction\n"), (2, "/lib/a.py", "print(1)"), (3, "/lib/sub/deep/b.py", "x"), (4, "/lib/sub/c.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
    (5, "/lib/sub/deep/er/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), (6, "/lib/sub/deep/er/d.py", None), (7, "/other/e.py", "all of the rights are not reserved for the general public"), (8, None, "Released under the MIT License."), (9, None, "none"),
    (10, "/libx/f.py", ""), (11, "/root.py", "x"), (12, "/two/LICENSE", "All rights reserved."), (13, "/two/LICENSE.md", "Licensed under CC BY-NC 4.0."), (14, "/two/g", "y"), (15, "/lib/LICENSE", "no licence in here"), (16, "/lib/long.txt", "w " * 50_000 + "\nReleased under the MIT License. İ"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "doc_id long, path string, text string").repartition(3)


def test_licenses(files):
    got = {r.doc_id: r for r in licenses.scan(files).collect()}
    assert len(got) == len(FILES)
    short = {i: (r.license, r.origin) for i, r in got.items()}
    assert short[1] == ("MIT", "own") and short[4] == ("Apache-2.0", "own") and short[5] == ("GPL-3.0", "own") and short[8] == ("MIT", "own")
    assert short[2] == short[3] == ("MIT", "inherited") and got[3].license_dir == "/lib"
    assert short[6] == ("GPL-3.0", "inherited") and got[6].license_dir == "/lib/sub/deep/er"
    assert short[7] == short[9] == short[10] == short[11] == (None, "none")
    assert short[14][1] == "inherited" and short[14][0] in ("CC-BY-NC-4.0", "Proprietary") and short[15] == ("MIT", "inherited")
    assert got[4].start == 0 and got[4].end == FILES[3][2].index("\n") and got[16].start == 100_001
    for r in got.values():
        assert r.origin != "own" or r.cosine >= licenses.COSINE


def test_license_anchors_lose_nothing(files):
    m = licenses.Matcher(*licenses.document_frequencies(files))
    rng = random.Random(4)
    for _ in range(3000):
        line = " ".join(rng.choices(licenses.VOCABULARY, k=rng.randint(1, 8)) + rng.choices(["foo", "bar"], k=rng.randint(0, 2)))
        cosine, name = m.best(line)
        found = m.scan(line)
        assert (found[0], found[1]) == ((name, cosine) if cosine >= m.threshold else (None, 0.0)), line


def plain_license(m, text):
    """Matcher.scan() without anchors, without leaving templates out, every run counted anew."""
    lines, start = [], 0
    for line in (text or "").split("\n"):
        if held := licenses.TERM.findall(line.lower()):
            lines.append((start, start + len(line), held))
        start += len(line) + 1

    def cosine(words, i):
        v = Counter(words)
        square = sum((c * m.idf.get(t, m.highest)) ** 2 for t, c in v.items())
        dot = sum(c * m.idf.get(t, m.highest) * m.vectors[i].get(t, 0) for t, c in v.items())
        return round(min(1.0, dot / square**0.5), 9) if dot and len(words) >= m.least[i] else 0.0

    def best(words, first=0):
        return min(((-cosine(words, i), m.names[i], i) for i in range(first, len(m.names))))

    hits = []
    for a, b, held in lines:
        c, _, i = best(held)
        if -c >= m.threshold:
            hits.append((-c, i, a, b))
    for i in range(len(m.names)):
        first, top = 0, (0.0, -1, -1)
        for last in range(1, len(lines)):
            while first < last - 1 and sum(len(x[2]) for x in lines[first:last]) > m.sizes[i]:
                first += 1
            for f in range(first, last):
                words = [t for x in lines[f : last + 1] for t in x[2]]
                c = cosine(words, i)
                if c >= m.threshold and c > top[0]:
                    top = c, lines[f][0], lines[last][1]
                if len(words) <= m.sizes[i]:
                    break
        if top[0]:
            hits.append((top[0], i, *top[1:]))
    found = max(hits, key=lambda h: h[0], default=None)
    given = max((h for h in hits if h[1] >= m.first_text and m.names[h[1]] != "Proprietary"), key=lambda h: h[0], default=None)
    full = max((h for h in hits if h[1] >= m.first_whole), key=lambda h: h[0], default=None)
    if found and m.names[found[1]] == "Proprietary" and given:
        found = given
    if full and full[2] <= found[2] and found[3] <= full[3]:
        found = full
    whole = best([t for x in lines for t in x[2]], m.first_text)
    return (m.names[found[1]], *found[:1], *found[2:]) if found else None, -whole[0], whole[1]


def test_license_scan_equals_brute_force(files):
    """Headers and parts of licenses with words changed, lines joined and cut anew, among other lines."""
    m = licenses.Matcher(*licenses.document_frequencies(files))
    rng = random.Random(12)
    code = lambda: f"def f_{rng.randrange(99)}(x): return x * {rng.randrange(9)}"
    seen = Counter()
    for _ in range(120):
        name, x = rng.choice([t for t in licenses.TEMPLATES if len(t[1]) < 3000])
        words = x.split()
        for i in rng.sample(range(len(words)), rng.randrange(len(words) // 6 + 1)):
            words[i] = rng.choice(["frob", "the", "software", "2.0", ""])
        body = textwrap.fill(" ".join(words), rng.choice([40, 70, 10_000]), initial_indent="# ", subsequent_indent="# ")
        text = "\n".join([*(code() for _ in range(rng.randrange(4))), "All rights reserved." * rng.randrange(2), body, *(code() for _ in range(rng.randrange(4)))])
        got, want = m.scan(text), plain_license(m, text)
        seen[name == got[0], got[0] is None] += 1
        if want[0]:
            assert got[0] == want[0][0] and got[1] == pytest.approx(want[0][1]) and got[2:4] == want[0][2:], text
        else:
            assert got[0] is None, text
        if got[4] or want[1] >= m.floor:
            assert got[4] == pytest.approx(want[1]) and (got[5] == want[2] or want[1] == pytest.approx(got[4]))
    assert seen[True, False] > 80


#: Notices as they stand in files, in words that no template has as a whole.
HELD_OUT = [
    ("MIT", "/*\n * Copyright (C) 2021 Jane Roe <jane@example.org>\n *\n * Use of this source code is governed by an MIT-style license.\n * SPDX-License-Identifier: MIT\n */"), ("Apache-2.0", "// Copyright 2015 Frob Inc.\n//\n// Licensed under the Apache License, Version 2.0 (the License);\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//   https://www.apache.org/licenses/LICENSE-2.0\n"),
    ("GPL-3.0", "This file is part of Frob.\n\nFrob is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n"), ("GPL-2.0", "Frob is free software; you can redistribute it and/or modify it under\nthe terms of the GNU General Public License as published by the Free\nSoftware Foundation; either version 2 of the License, or (at your option)\nany later version.\n"),
    ("LGPL-2.1", "Frob is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n"), ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"),
    (None, "/* Copyright 2020 Frob. Ask before you use it in public. */\nint general_license = 2;"), (None, "The license of the software was the subject of the general meeting,\nand the public had the right to copy the terms of version 3."),
]


@pytest.mark.parametrize("name,head", HELD_OUT)
def test_license_notices_held_out(name, head):
    m = licenses.Matcher(1000, {t: 300 for t in ("the", "of", "and", "to", "in", "a", "this", "all", "is", "for")})
    code = "\n".join(f"x_{i} = frobnicate(y_{i}, {i})" for i in range(60))
    assert m.scan(f"{head}\n{code}")[0] == name


def test_license_inheritance_equals_brute_force(spark):
    """Nearest ancestor by path joins against walking up each path."""
    rng = random.Random(6)
    rows, heads = [], {k: v[0] for k, v in licenses.HEADERS.items() if k != "Proprietary"}
    for i in range(300):
        parts = [rng.choice("abc") for _ in range(rng.randrange(5))]
        given = rng.choice(sorted(heads)) if rng.random() < 0.1 else None
        rows.append((i, None if rng.random() < 0.03 else "/".join(["", *parts, "LICENSE" if given else f"f{i}"]), heads[given] if given else rng.choice([None, "", "code"])))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(4)).collect()}
    files = defaultdict(list)
    for i, p, t in rows:
        if p and t and p.endswith("LICENSE"):
            files[p.rpartition("/")[0]].append((-got[i].cosine, got[i].license))
    for i, p, t in rows:
        if t and t != "code":
            assert got[i].origin == "own"
            continue
        up = (p or "x").rpartition("/")[0] if p else None
        while up is not None and up not in files:
            up = up.rpartition("/")[0] if up else None
        want = min(files[up])[1] if up is not None else None
        assert (got[i].license, got[i].origin, got[i].license_dir) == (want, "inherited" if want else "none", up), p


def test_license_frequencies(files, docs):
    rows, held = licenses.document_frequencies(files)
    assert rows == len(FILES)
    for t in ("license", "the", "mit", "public", "zzz"):
        assert held.get(t, 0) == sum(t in licenses.terms(x or "") for _, _, x in FILES)


def test_license_edges(docs, clashing, none, fixture_rows):
    at = lambda d: d.withColumn("path", F.concat_ws("/", F.lit(""), "source", "lang", "doc_id"))
    assert licenses.scan(at(docs)).count() == licenses.scan(at(clashing)).count() == len(fixture_rows)
    assert licenses.scan(at(none)).count() == 0


COPYRIGHT = "Copyright (c) 2019, The Frobnicator Authors\nAll rights reserved.\n\n"


@pytest.mark.parametrize("name", sorted(licenses.WHOLE))
def test_license_files(name):
    """Whole license files, as they are and wrapped anew, are told apart; so are source files that begin with a header."""
    m = licenses.Matcher(1000, {t: 300 for t in ("the", "of", "and", "to", "in", "a", "this", "all", "is", "for")})
    text = licenses.WHOLE[name]
    for x in (COPYRIGHT + text, COPYRIGHT + "\n\n".join(textwrap.fill(p, 60) for p in text.split("\n\n")), text.replace("\n", "\r\n")):
        got = m.scan(x)
        assert got[0] == got[5] == name and got[4] >= licenses.FILE_COSINE
    code = "\n".join(f"def frob_{i}(a_{i}):\n    return a_{i} * {i}" for i in range(200))
    for x in licenses.TEXTS.get(name, ()):
        head = textwrap.fill(x, 70, initial_indent="# ", subsequent_indent="# ")
        got = m.scan(f"#!/bin/x\n# Copyright 2019 Frobnicator\n{head}\n{code}")
        assert got[0] == name and got[3] > got[2] > 0 and got[1] >= licenses.COSINE
    assert m.scan("software\nlicense license\nthe work\n" + code)[0] is None


def test_license_query_inherits(spark, tmp_path):
    """The registered query itself: a document that is a license text gives its license to its directory."""
    rows = [(1, COPYRIGHT + licenses.WHOLE["BSD-3-Clause"], "en", "code", 1), (2, "print(1)", "en", "code", 1), (3, "print(2)", "fr", "code", 1), (4, None, "en", "code", 1), (5, licenses.WHOLE["MIT"] + "\n", "fr", "web", 1), (6, "x", "fr", "web", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.license, r.origin) for r in op9_license_scan(spark, str(tmp_path)).collect()}
    assert got == {1: ("BSD-3-Clause", "own"), 2: ("BSD-3-Clause", "inherited"), 3: (None, "none"), 4: ("BSD-3-Clause", "inherited"), 5: ("MIT", "own"), 6: ("MIT", "inherited")}
