"""What the operators share: tables in the cluster's shared folder, joins that hot keys can't clog, Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words: exactly the bytes that bytes.split() splits at.
SPACES = " \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handled at once in a Python worker, in bytes; one longer text comes alone.
SLICE_BYTES = 1 << 20

#: A key with this share of the rows or more is hot, so at most so many keys are; with fewer rows than HOT_ROWS none is.
MOST_HOT, HOT_ROWS = 4096, 10_000
#: Bits of a filter for each key, and at most (16 MB).
FILTER_BITS, MOST_FILTER_BITS = 32, 1 << 27

#: Texts in an Arrow batch while a table is written.
BATCH_ROWS = 1000

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_left: dict[str, SparkSession] = {}  # tables that are still there
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)
_held: dict[tuple, object] = {}
_asked: set[tuple] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Where the session has neither, a temporary folder of our
    own if all runs on this machine (tests); on a cluster that is an error, as executors don't share their disks."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = sc.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="snaptable-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, gives Catalyst true sizes.

    The table stays until discard(), the end of the scratch() block that it was made in, or the end of the process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/snaptable/{label}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    if not _left:
        atexit.register(_clear)
    _left[path] = spark
    if (mine := _scope.get()) is not None:
        mine.append(path)
    return out


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """While a table is written, Arrow batches have 1,000 rows at most: 10,000 texts at once cost each task a tenth of a
    gigabyte in the JVM and in Python. The session's setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH_ROWS, int(before))) if int(before) > 0 else str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _delete(path: str) -> None:
    spark = _left.pop(path, None)
    parts = urlsplit(path)
    if spark is None:
        return
    if parts.scheme in ("", "file"):
        shutil.rmtree(unquote(parts.path), ignore_errors=True)
    else:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clear() -> None:
    for path in list(_left):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the process ends and its JVM may be gone
            _left.pop(path, None)


def discard(df: DataFrame) -> None:
    """Delete the table that materialize() gave, if df is one: nothing reads it any more."""
    if path := _paths.pop(df, None):
        _delete(path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables made in this block are deleted at its end, but for those that are given to keep(), which it yields."""
    outer, mine, kept = _scope.get(), [], set()
    token = _scope.set(mine)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(_paths[df])
        if outer is not None:
            outer.append(_paths[df])
        return df

    try:
        yield keep
    finally:
        _scope.reset(token)
        for path in mine:
            if path not in kept:
                _delete(path)


def probable(key: Column, keys: DataFrame) -> Column:
    """True for each key (a long, not null) that is in keys' only column, and for few others: a bit for each hash, 32 bits
    a key and at most 2**27, so what is sent to executors is bounded by 16 MB. (From some ten million keys on ever more
    others pass, which costs their shuffle and changes no result: whoever asks joins afterwards.)"""
    spark = keys.sparkSession
    name = keys.columns[0]
    n = keys.count()
    words = max(64, min(MOST_FILTER_BITS, 1 << (max(1, n) * FILTER_BITS - 1).bit_length()) >> 6)
    spot = lambda c: F.pmod(F.xxhash64(c, F.lit("filter")), F.lit(words * 64))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))
    at = keys.select(spot(F.col(name)).alias("p"))
    set_ = at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(bit(F.col("p"))).alias("bits"))
    every = spark.range(words).join(set_, F.col("id") == F.col("word"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    dense = materialize(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("dense")), "filter")
    p = spot(key)
    return F.get(dense.scalar(), F.shiftright(p, 6).cast("int")).bitwiseAND(bit(p)) != 0


def join_hot(rows: DataFrame, table: DataFrame, on: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table, which has one row for each key and in `size` how many of the `total` rows hold it.

    Keys with 1/4096 of all rows or more (and HOT_ROWS at least) are hot, 4,096 at most: they are broadcast, so their rows
    go nowhere. The others meet by a shuffle in which no key is large. Where keys of both kinds are there, rows are read twice.
    table is one of materialize()."""
    other = fresh(f"{on}__", [*rows.columns, *table.columns])
    table = table.withColumnRenamed(on, other)
    least = F.lit(max(HOT_ROWS, -(-total // MOST_HOT)))
    hot, cold = F.broadcast(table.where(F.col(size) >= least)), table.where(F.col(size) < least)
    if hot.isEmpty():
        return rows.join(cold, rows[on] == cold[other], how).drop(other)
    if cold.isEmpty():
        return rows.join(hot, rows[on] == hot[other], how).drop(other)
    met = rows.join(hot, rows[on] == hot[other])
    rest = rows.join(hot, rows[on] == hot[other], "left_anti")
    return met.unionByName(rest.join(cold, rest[on] == cold[other], how)).drop(other)


def drop_rows(docs: DataFrame, gone: DataFrame, again: DataFrame, doc_id: str, digest: Column) -> DataFrame:
    """docs without the rows whose (doc_id, digest of the text) is in gone (g_id, g_digest); of the rows of a key in again
    (the same columns) the one of least JSON stays. Texts stay where they are, but for rows whose id may be in either."""
    both = gone.select("g_id", "g_digest", F.lit(False).alias("again")).unionByName(again.select("g_id", "g_digest", F.lit(True).alias("again")))
    if both.isEmpty():
        return docs
    maybe = probable(F.xxhash64(docs[doc_id]), both.select(F.xxhash64("g_id").alias("h")))
    mine, flag, i, d = (fresh(x, docs.columns) for x in ("digest__", "again__", "gid__", "gdigest__"))
    both = both.toDF(i, d, flag)
    hit = docs.where(maybe).withColumn(mine, digest)
    hit = hit.join(both, hit[doc_id].eqNullSafe(both[i]) & (hit[mine] == both[d]), "left")
    out = docs.where(~maybe).unionByName(hit.where(F.col(flag).isNull()).select(*[hit[c] for c in docs.columns]))
    if not again.isEmpty():
        row = F.struct(*[hit[c] for c in docs.columns])
        once = hit.where(F.col(flag)).groupBy(hit[i].alias("k1"), hit[d].alias("k2")).agg(F.min_by(row, F.to_json(row)).alias("row"))
        out = out.unionByName(once.select("row.*"))
    return out


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each application: their Python workers import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    code = Path(tempfile.mkdtemp(prefix="snaptable-code-"), "snaptable_code.zip")
    with zipfile.ZipFile(code, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(code))
    atexit.register(shutil.rmtree, code.parent, ignore_errors=True)
    _shipped.add(app)


def held(make: Callable, *args):
    """make(*args), kept in this Python worker for its next tasks of the same kind: see only_asked()."""
    key = make, *args
    _asked.add(key)
    if key not in _held:
        _held[key] = make(*args)
    return _held[key]


def only_asked(make: Callable):
    """make(), after which this worker keeps what make() has asked held() for and nothing else: workers are reused, and
    other operators' tables would cost memory for nothing."""
    _asked.clear()
    out = make()
    if gone := _held.keys() - _asked:
        for key in gone:
            del _held[key]
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
    return out


def fresh(name: str, taken: Sequence[str]) -> str:
    """name, or name with underscores in front if the table has a column of that name (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """(offset, length) of runs of rows whose texts have at most SLICE_BYTES together, one row at least."""
    start = held = 0
    sizes = (pc.fill_null(pc.binary_length(c), 0).to_pylist() for c in columns)
    for i, n in enumerate(map(sum, zip(*sizes, strict=True))):
        if held and held + n > SLICE_BYTES:
            yield start, i - start
            start, held = i, 0
        held += n + 64
    if start < len(columns[0]):
        yield start, len(columns[0]) - start


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], Sequence[pa.Array]]], fields: Sequence[tuple[str, T.DataType, pa.DataType]], text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Append columns that a Python function computes from a text column, Arrow batch by Arrow batch.

    make() is called once a task and gives f(list of str or None) -> one Arrow array for each of fields.
    keep: the columns of df that come along (all by default). A kept column with the name of one in fields (in any case)
    gives way: it comes back with underscores in front.
    """
    keep = list(df.columns if keep is None else keep)
    names: list[str] = []
    for c in keep:
        names.append(fresh(c, [*names, *(n for n, _, _ in fields), *(x for x in keep if x != c)]) if c.lower() in {n.lower() for n, _, _ in fields} else c)
    inner = fresh("text__in", names)
    src = df.select(*[df[c].alias(n) for c, n in zip(keep, names, strict=True)], df[text].cast("string").alias(inner))
    schema = T.StructType([*(src.schema[c] for c in names), *(T.StructField(n, t) for n, t, _ in fields)])
    ship(df.sparkSession)
    kinds, at = [a for _, _, a in fields], len(names)
    names += [n for n, _, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = only_asked(make)
        for batch in batches:
            for start, n in slices(batch.column(at)):
                part = batch.slice(start, n)
                made = f(part.column(at).to_pylist())
                made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *made], names=names)

    return src.mapInArrow(run, schema)
