"""Shared tables, filters and joins."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snaptable.llm import common


class Session:
    def __init__(self, master, conf=None, folder=None):
        self.master, self.folder = master, folder
        self.conf, self.sparkContext, self.applicationId = {"spark.checkpoint.dir": conf} if conf else {}, self, "app"

    def getCheckpointDir(self):  # noqa: N802
        return self.folder


def test_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(Session(master))
        assert common.shared_dir(Session(master, "hdfs://x/y/")) == "hdfs://x/y" and common.shared_dir(Session(master, None, "s3a://b/c")) == "s3a://b/c"
    assert common.shared_dir(Session("local[2]")).startswith("file:///")


def test_tables_go(spark):
    """Of a run's tables only what is kept is left, nested runs too, and also when a run fails; settings are put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, rows = set(common._left), spark.conf.get(key)
    with common.scratch() as keep:
        a = common.materialize(spark.range(3), "a")
        with common.scratch() as inner:
            b = inner(common.materialize(a.select(F.col("id") + 1), "b"))
            common.materialize(spark.range(5), "c")
        assert len(common._left) == len(before) + 2
        b = keep(b)
    assert len(common._left) == len(before) + 1 and b.count() == 3 and spark.conf.get(key) == rows
    common.discard(b)
    common.discard(spark.range(1))
    with pytest.raises(KeyError), common.scratch():
        common.materialize(spark.range(3), "d")
        raise KeyError
    assert set(common._left) == before


@pytest.mark.parametrize("n", [0, 1, 40, 5000])
def test_probable(spark, n):
    keys = common.materialize(spark.range(n).select((F.col("id") * 7 - 3).alias("k")), "keys")
    df = spark.range(-10, 40_000)
    got = [r.id for r in df.where(common.probable(F.col("id"), keys)).collect()]
    want = {7 * i - 3 for i in range(n)}
    assert {i for i in want if i < 40_000} <= set(got) and len(got) - len(want) < 0.06 * 40_000 + 5


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_hot(spark, monkeypatch, how):
    """Hot keys, cold keys, both, and keys that the table lacks: as a plain join."""
    rng = random.Random(how)
    rows = [(rng.choice([1, 1, 1, 2, 2, *range(3, 60)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(3)
    sizes = Counter(k for k, _ in rows)
    table = common.materialize(spark.createDataFrame([(k, n, f"t{k}") for k, n in sizes.items() if k % 5], "k long, n long, name string"), "table")
    for least, most in ((1, 4096), (10**6, 4096), (100, 4096), (1, 20)):
        monkeypatch.setattr(common, "HOT_ROWS", least)
        monkeypatch.setattr(common, "MOST_HOT", most)
        got = common.join_hot(df, table, "k", "n", 2000, how)
        assert got.columns == ["k", "v", "n", "name"]
        want = [(k, v, sizes[k] if k % 5 else None, f"t{k}" if k % 5 else None) for k, v in rows if k % 5 or how == "left"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_slices():
    texts = pa.array(["x" * n for n in (10, common.SLICE_BYTES * 2, 5, common.SLICE_BYTES - 100, 200, 3)] + [None])
    got = list(common.slices(texts))
    assert [n for _, n in got] == [1, 1, 1, 1, 3] or sum(n for _, n in got) == 7
    for start, n in got:
        part = texts.slice(start, n)
        assert n == 1 or sum(len(x.as_py() or "") for x in part) <= common.SLICE_BYTES
    assert list(common.slices(texts, texts))[0] == (0, 1) and list(common.slices(texts.slice(0, 0))) == []


def test_a_worker_holds_one_operators_tables():
    made = []

    def table(name):
        made.append(name)
        return [name]

    before = dict(common._held)
    common._held.clear()
    a = common.only_asked(lambda: common.held(table, "a"))
    assert common.only_asked(lambda: common.held(table, "a")) is a and made == ["a"]
    common.only_asked(lambda: (common.held(table, "b"), common.held(table, "c")))
    assert len(common._held) == 2 and common.only_asked(lambda: 5) == 5 and not common._held
    assert common.only_asked(lambda: common.held(table, "a")) == ["a"] and made == ["a", "b", "c", "a"]
    common._held.clear()
    common._held.update(before)
