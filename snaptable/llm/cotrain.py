"""Quality classifier by co-training: a text view and a page-metadata view teach each other, then vote calibrated.

Both views are logistic models. They start from a bounded sample of labelled documents (at most `most_labelled`, those
with the smallest hashes of their ids). In each round every view scores all documents without a label, on executors;
the documents it is most sure of teach the other view. Nothing of the unlabelled documents is sampled or gathered: the
metadata view sees a document as one of 24,576 cells, so counts by cell are all it needs; the text view takes Newton
steps whose gradient and Hessian are summed over all documents that it is taught. A class of taught documents weighs at
most as much as the labelled ones of that class. A held-out fifth of the labelled sample, never trained on, calibrates
each view (Platt, drawn towards no change, so that few held-out rows change little); scores of all documents add the
views' calibrated log-odds, the prior counted once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, materialize, scratch, ship
from .mixing import HASH_BITS, key_hash
from .quality import SYMBOLS

#: SURE: least probability at which a view teaches. A_ROUND: the share of documents that it may teach of each class, more each round.
MOST_LABELLED, ROUNDS, SURE, A_ROUND = 20_000, 3, 0.97, 0.1
#: Newton steps of the text view in a round, and log-odds bins by which the surest documents are found.
STEPS, BIN, TOP = 4, 20, 30
LANGS, SOURCES, SIZES = 16, 64, 24
CELLS, DENSE = LANGS * SOURCES * SIZES, 24
UPPER, DIGITS, LETTERS = bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(97, 123))
PUNCT = b"!?.,;:|'\"()[]{}-_/\\"


def text_features(text: str | None) -> list[float]:
    """Numbers about one whole text; all 0 for an empty or null text but the constant that fit() adds."""
    import zstandard

    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * DENSE
    gone = lambda chars: size - len(raw.translate(None, chars))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = sum(map(len, words))
    top = counts.most_common(3)
    ratio = size / len(zstandard.ZstdCompressor(level=1).compress(raw))
    upper, digits, lower = gone(UPPER), gone(DIGITS), gone(LETTERS)
    letters = max(1, upper + lower)
    ascii_ = raw.decode().isascii()
    return [
        np.log1p(n), len(counts) / n, len(counts) / n**0.8, chars / n, upper / letters, digits / size, gone(SYMBOLS.encode()) / n, raw.count(b"!") / n, raw.count(b"|") / n, raw.count(b"?") / n, gone(PUNCT) / n, lower / size,
        1 - len(set(lines)) / len(lines), len(lines) / n, top[0][1] / n, sum(c for _, c in top) / n, sum(map(eq, words, words[1:])) / n, ratio, ratio / np.log1p(size), float(ascii_), raw.count(b".") / n, raw.count(b",") / n, sum(1 for x in words if 65 <= x[0] <= 90) / n, len(max(counts, key=len)) / 32,
    ]


def cell(lang: Column, source: Column, n_chars: Column) -> Column:
    """Number of a document's cell: hashed language, hashed source, size class. Null is a class of its own."""
    spot = lambda c, n: F.when(c.isNull(), 0).otherwise(1 + F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n - 1)))
    size = n_chars.cast("long")
    bin_ = F.when(size.isNull(), 0).otherwise(F.least(F.lit(SIZES - 1), 1 + F.when(size > 0, F.length(F.bin(size))).otherwise(0)))
    return ((spot(lang, LANGS) * SOURCES + spot(source, SOURCES)) * SIZES + bin_).cast("int")


def one_hot(cells) -> np.ndarray:
    c = np.asarray(cells, int)
    x = np.zeros((len(c), LANGS + SOURCES + SIZES))
    rows = np.arange(len(c))
    x[rows, c // (SOURCES * SIZES)] = x[rows, LANGS + c // SIZES % SOURCES] = x[rows, LANGS + SOURCES + c % SIZES] = 1
    return x


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps over scaled features and their squares (dense) or over ones (sparse)."""

    squares: bool
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w: np.ndarray | None = None
    a: float = 1.0
    b: float = 0.0

    def design(self, x: np.ndarray) -> np.ndarray:
        if self.squares:
            x = np.clip((x - self.mean) / self.scale, -6, 6)
            x = np.hstack([x, x * x])
        return np.hstack([x, np.ones((len(x), 1))])

    def sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the log-likelihood at w, summed over rows."""
        d = self.design(x)
        p = 1 / (1 + np.exp(-np.clip(d @ self.w, -TOP, TOP)))
        return d.T @ (weight * (y - p)), (d * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ d

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, more: Callable | None = None, steps: int = 15, ridge: float = 1.0) -> Logistic:
        """From w, or zero. more(model): further sums (gradient, Hessian). Weights are rounded, so that the order in which sums arrive doesn't show."""
        weight = np.ones(len(y)) if weight is None else weight
        if self.squares and self.mean is None:
            self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        if self.w is None:
            self.w = np.zeros(self.design(x[:1]).shape[1])
        for _ in range(steps):
            g, h = self.sums(x, y, weight)
            if more:
                g2, h2 = more(self)
                g, h = g + g2, h + h2
            step = np.linalg.solve(h + ridge * np.eye(len(g)), g - ridge * self.w)
            self.w = np.round(self.w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9)), 9)
            if np.abs(step).max() < 1e-3:
                break
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.w, -TOP, TOP)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Slope and shift of the log-odds that fit the held-out rows, with a pull of one towards 1 and 0; without rows they are just that."""
        z = np.column_stack([self.raw(x), np.ones(len(y))]) if len(y) else np.zeros((0, 2))
        ab, at = np.array([1.0, 0.0]), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ ab, -TOP, TOP)))
            h = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.eye(2)
            step = np.linalg.solve(h, z.T @ (y - p) - (ab - at))
            ab = ab + step * min(1.0, 1 / max(np.abs(step).max(), 1e-9))
        self.a, self.b = map(float, np.round(ab, 9))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.a * self.raw(x) + self.b


@dataclass
class CoModel:
    """log: in each round how many documents the text view and the metadata view were taught."""

    text: Logistic | None
    meta: Logistic | None
    prior: float
    log: list[tuple[int, int]]

    def score(self, dense: np.ndarray, cells) -> np.ndarray:
        if self.text is None:
            return np.full(len(dense), self.prior)
        base = np.log(self.prior / (1 - self.prior))
        z = self.text.logit(dense) + self.meta.logit(one_hot(cells)) - base
        return 1 / (1 + np.exp(-np.clip(z, -TOP, TOP)))


def bins(z: np.ndarray) -> np.ndarray:
    return np.floor(z * BIN).astype(int) + TOP * BIN


BINS = 2 * TOP * BIN + 1


def surest(counts: np.ndarray, most: float, sure: float = SURE) -> tuple[int, int]:
    """From counts by bin: the last bin of the sure zeros and the first of the sure ones. A bin is taken or left whole;
    bins are taken from the surest on until `most` documents are."""
    edge = float(np.log(sure / (1 - sure)))
    low, high = int(np.floor(-edge * BIN)) + TOP * BIN - 1, int(np.ceil(edge * BIN)) + TOP * BIN
    zero, got = -1, 0
    while zero < low and got < most:
        zero += 1
        got += counts[zero]
    one, got = BINS, 0
    while one > high and got < most:
        one -= 1
        got += counts[one]
    return zero, one


class Pool:
    """All rows without a label, as a table with dense and cell. Each method is one job over it; what comes back is bounded."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("dense", "cell")
        counts = self.rows.groupBy("cell").count().collect()  # at most CELLS numbers
        self.cells = np.zeros(CELLS, int)
        for c, n in counts:
            self.cells[c] = n
        ship(rows.sparkSession)

    def _sum(self, size: int, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches):
            total = np.zeros(size)
            for b in batches:
                dense = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, DENSE)
                total += f(dense, b.column(1).to_numpy(zero_copy_only=False))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["i", "v"])

        out = np.zeros(size)
        for i, v in self.rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
            out[i] = v
        return out

    def histogram(self, text: Logistic) -> np.ndarray:
        """Rows by bin of the text view's log-odds."""
        return self._sum(BINS, lambda x, _: np.bincount(bins(text.raw(x)), minlength=BINS).astype(float))

    def sure_cells(self, text: Logistic, zero: int, one: int) -> np.ndarray:
        """Rows by cell that the text view takes for zeros (first row) and ones (second)."""

        def f(x, cells):
            z = bins(text.raw(x))
            return np.concatenate([np.bincount(cells[z <= zero], minlength=CELLS), np.bincount(cells[z >= one], minlength=CELLS)]).astype(float)

        return self._sum(2 * CELLS, f).reshape(2, CELLS)

    def text_sums(self, text: Logistic, taught: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian over the rows whose cell is taught as 0 or 1 (-1: not), weighted by class."""
        k = len(text.w)

        def f(x, cells):
            y = taught[cells]
            g, h = text.sums(x[y >= 0], y[y >= 0].astype(float), weights[y[y >= 0]])
            return np.concatenate([g, h.ravel()])

        v = self._sum(k + k * k, f)
        return v[:k], v[k:].reshape(k, k)


def co_train(dense, cells, y, pool: Pool, rounds: int = ROUNDS, sure: float = SURE, a_round: float = A_ROUND) -> CoModel:
    """y: 0 or 1, in the order of the sample. With labels of one class or none there is nothing to learn: the model then scores every
    document with the share of ones (0.5 for none). Of each class every fifth row is held out, so with fewer than five none is."""
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return CoModel(None, None, float(y.mean()) if len(y) else 0.5, [])
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[4::5]] = True
    dense, ones, y_ = np.asarray(dense, float), one_hot(cells), y[~held]
    text = Logistic(True).fit(dense[~held], y_)
    meta = Logistic(False).fit(ones[~held], y_)
    own = np.array([(y_ == 0).sum(), (y_ == 1).sum()])
    every, hot, log = int(pool.cells.sum()), one_hot(np.arange(CELLS)), [(0, 0)]
    for r in range(1, rounds + 1 if every else 1):
        most = a_round * r * every
        # the metadata view teaches whole cells, the text view rows
        z = bins(meta.raw(hot))
        zero, one = surest(np.bincount(z, weights=pool.cells, minlength=BINS), most, sure)
        taught = np.where(z <= zero, 0, np.where(z >= one, 1, -1))
        n = np.array([pool.cells[taught == c].sum() for c in (0, 1)])
        by_cell = pool.sure_cells(text, *surest(pool.histogram(text), most, sure))
        weight = np.minimum(1.0, own / np.maximum(n, 1))
        text.fit(dense[~held], y_, more=lambda m, t=taught, w=weight: pool.text_sums(m, t, w), steps=STEPS)
        m = by_cell.sum(1)
        weight = np.minimum(1.0, own / np.maximum(m, 1))
        at = [np.flatnonzero(k) for k in by_cell]
        xs = np.vstack([ones[~held], hot[at[0]], hot[at[1]]])
        ys = np.concatenate([y_, np.zeros(len(at[0])), np.ones(len(at[1]))])
        ws = np.concatenate([np.ones(len(y_)), *(weight[c] * by_cell[c][at[c]] for c in (0, 1))])
        meta = Logistic(False).fit(xs, ys, ws)
        log.append((int(n.sum()), int(m.sum())))
    for model, x in ((text, dense), (meta, ones)):
        model.calibrate(x[held], y[held])
    return CoModel(text, meta, float(y.mean()), log)


FEATURES = [("dense", T.ArrayType(T.FloatType()), pa.list_(pa.float32()))]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, cell, dense: what both views see of each row of docs (doc_id, text, lang, source, n_chars); other columns are not read."""
    rows = docs.select("doc_id", cell(docs["lang"], docs["source"], docs["n_chars"]).alias("cell"), "text")
    return map_texts(rows, lambda: lambda texts: [[np.asarray(text_features(t), np.float32) for t in texts]], FEATURES, "text", ["doc_id", "cell"])


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows of features() with label: 1 if quality is above 0, by the least of several labels; null if there is none."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("label"))
    known = known.select(F.col("doc_id").alias("l_id"), "label")
    return rows.join(known, F.col("doc_id") == F.col("l_id"), "left").drop("l_id")


def sample(rows: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """One row for each labelled doc_id that rows has (of several the least by its features): the `most` of smallest hash, or all, in that order.

    Every task would hand its own `most` rows to the last one: a threshold on the hash that about 2 * most rows pass
    drops the rest before, however many tasks there are. (That fewer than `most` pass it has a probability below 1e-20.)"""
    known = rows.where("label IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("label", "cell", "dense")).alias("x")).select("doc_id", "x.*")
    rank = key_hash(F.col("doc_id"), "co-training")
    pass_ = int(2**HASH_BITS * min(1.0, (2 * most + 400) / max(1, known.count())))
    return known.where(rank <= pass_).orderBy(rank, "doc_id").limit(most)


def fit_rows(rows: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, rounds: int = ROUNDS) -> CoModel:
    """fit() on what features() gives."""
    with scratch():
        rows = materialize(with_labels(rows, labels), "co-labelled")
        got = sample(rows, most_labelled).toPandas()  # bounded by the parameter
        dense = np.array(got["dense"].tolist(), float).reshape(-1, DENSE)
        return co_train(dense, got["cell"].to_numpy(int), got["label"].to_numpy(float), Pool(rows.where("label IS NULL")), rounds)


def score_rows(rows: DataFrame, model: CoModel, threshold: float = 0.5) -> DataFrame:
    """classify() on what features() gives."""

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, DENSE)
            p = model.score(x, b.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "score", "kept"])

    ship(rows.sparkSession)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return rows.select("doc_id", "dense", "cell").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, rounds: int = ROUNDS) -> CoModel:
    """Learn from docs (doc_id, text, lang, source, n_chars) and labels (doc_id, quality: above 0 is good; the least of several counts).

    Labels of documents that aren't there don't count. Rows of docs that repeat a doc_id are one labelled document, or
    as many unlabelled ones. Null texts are as empty ones, null ids have no label, null metadata is a class of its own.
    Empty docs or labels give a model that scores by the share of ones, 0.5 without any. Very long texts are read whole."""
    with scratch():
        return fit_rows(materialize(features(docs), "co-features"), labels, most_labelled, rounds)


def classify(docs: DataFrame, model: CoModel, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, score (probability of good quality), kept (score >= threshold).

    Null texts count as empty, null metadata is a class of its own. Extra columns are not read. Empty docs give no rows."""
    return score_rows(features(docs), model, threshold)


def fit_and_classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """classify(docs, fit(docs, labels)), with the features of every document computed once."""
    with scratch() as keep:
        rows = keep(materialize(features(docs), "co-features"))
        model = fit_rows(rows, labels)
    return score_rows(rows, model)
