"""The pipeline, stage by stage, against what its stages should do to a small table; and the registered queries against SQL."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import tokenizers

import corpus_pipeline
from snaptable.llm import bpe, common, mixing, quality
from snaptable.llm.queries import ORACLE_SQL, QUERIES

from .test_corpus_ops import brute_exact, brute_near, fill

SF = "/root/testdata/sf0.001"


def brute_mix(rows):
    """(doc_id, text) -> copies: documents of each source in the order of their hashes, as far as its target goes."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()  # noqa: E731, S324
    sizes, by = Counter(), defaultdict(list)
    for r in rows:
        n = len([w for w in re.split(r"[\x20\x09-\x0D]+", r[1] or "") if w])
        sizes[r[3]] += n
        by[r[3]].append((int(md5(f"mix:{'' if r[0] is None else r[0]}:{md5(r[1] or '')}")[:15], 16) >> 24, n, (r[0], r[1])))
    out = {}
    for source, target in fill(sizes).items():
        base = int(target // sizes[source]) if sizes[source] else 0
        left, buckets = target - base * sizes[source], defaultdict(list)
        for h, n, key in by[source]:
            buckets[h].append((n, key))
        more = left > 0
        for h in sorted(buckets):
            n = sum(x for x, _ in buckets[h])
            if more and n > left:  # where the budget ends: in if that comes nearer
                more, last = False, n - left <= left
            else:
                last = more
            left -= n
            out |= {key: base + last for _, key in buckets[h]}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_brute_mix_agrees(spark, seed):
    rng = random.Random(seed)
    rows = [(i if rng.random() < 0.9 else None, " ".join(["w"] * rng.randrange(40)) + f" {i}", "en", rng.choice("abcde") if rng.random() < 0.9 else None, 1) for i in range(300)]
    want = brute_mix(rows)
    got = mixing.mixed_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == +Counter(want)


def test_pipeline(spark, tmp_path, fixture_rows):
    rng = random.Random(1)
    more = [(1000 + i, " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(rng.randint(60, 120))), "en", rng.choice("abc"), 5) for i in range(60)]
    rows = [*fixture_rows, *more]
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/documents.parquet")
    make = quality._maker(quality.BANDS, quality.CHUNK, quality.BAD_CHUNKS)
    rows = [r for r, kept in zip(rows, make([r[1] for r in rows])[-1], strict=True) if kept]
    exact = {(i, h) for i, _, _, kept, h in brute_exact(rows) if kept}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    digest = lambda t: hashlib.sha256(t.translate(low).encode()).hexdigest()
    rows = list({(r[0], digest(r[1])): r for r in rows if (r[0], digest(r[1])) in exact}.values())
    first = {(i, c) for i, c, _ in brute_near(rows)}
    rows = [r for r in rows if (r[0], r[0]) in first]
    copies = brute_mix(rows)
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    want = Counter()
    for r in rows:
        ids = library.encode(r[1], add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want[r[0], r[2], r[3], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(said.encode()).hexdigest()] += copies[r[0], r[1]]
    left = len(common._left)
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == +want and len(rows) > 40
    assert len(common._left) == left + 1  # the result; all other tables are gone
    spark.createDataFrame(rows, cols).selectExpr("*", "1 AS kept", "2 AS node", "map('k', doc_id) AS m", "text AS ids", "3 AS n_tokens").write.parquet(f"{tmp_path}/more/documents.parquet")
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, f"{tmp_path}/more").collect()) == +want


def test_stages_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "bpe"]
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").schema.simpleString() == docs.schema.simpleString()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rounded(df.select(*names).collect()) == rounded(cur.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_every_document_has_a_row(spark, name):
    if not Path(SF).is_dir():
        pytest.skip("no test tables here")
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()) == ids
