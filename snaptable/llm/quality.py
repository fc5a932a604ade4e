"""Quality rules: word and repetition counts, then compression bands.

zstandard's ratio (bytes before / after) of the whole text and of fixed chunks has to lie in a band that depends on the
length: short texts compress less. Above the band a text is repetitive, below it is incompressible (encoded data).
Hexadecimal digits compress like prose, so they are told by their bytes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SPACES, fresh, map_texts

SYMBOLS = "#*$%&|<>"
HEX_DIGITS, HEX_LETTERS = b"0123456789", b"abcdefABCDEF"
MIN_WORDS = 50
LEVEL, CHUNK, LEAST_CHUNK = 3, 4096, 512  # a rest below LEAST_CHUNK goes with the chunk before it
#: (bytes below, least ratio, greatest ratio)
#: The least ratios lie above wrapped base64 (to 1.33; in words of six 1.31 at 1,000 bytes, 1.38 at most), from 4,096 bytes on (full chunks
#: too) above base32 (1.59), and below pieces of manuals, READMEs, licenses and translations in 16 languages (1.42 and more from
#: 1,024 bytes, 1.80 from 4,096). Below 1,024 bytes both overlap by a little.
BANDS = ((384, 1.18, 2.8), (512, 1.24, 2.8), (768, 1.28, 2.8), (1024, 1.33, 2.8), (4096, 1.4, 3.2), (16384, 1.62, 3.6), (float("inf"), 1.62, 4.2))
#: A text goes if more than this share of its chunks is out of band.
BAD_CHUNKS = 0.25

FIELDS = [
    ("n_words", T.LongType(), pa.int64()), ("word_chars", T.LongType(), pa.int64()), ("n_symbols", T.LongType(), pa.int64()), ("n_dup_lines", T.LongType(), pa.int64()), ("n_repeat_words", T.LongType(), pa.int64()),
    ("base_failed", T.BooleanType(), pa.bool_()), ("ratio", T.DoubleType(), pa.float64()), ("n_chunks", T.LongType(), pa.int64()), ("n_bad_chunks", T.LongType(), pa.int64()), ("kept", T.BooleanType(), pa.bool_()),
]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more, first occurrences included."""
    import numpy as np

    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    k = len(seen)
    if k**3 < 2**63:
        key = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # numbers of pairs first, so that the key stays in 64 bits
        pair = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)[1]
        key = pair * k + ids[2:]
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    if len(n) == len(key):
        return 0
    hit = n[at] >= 2
    inside = np.zeros(len(words), bool)
    for d in range(3):
        inside[d : d + len(hit)] |= hit
    return int(inside.sum())


def in_band(raw: int, packed: int, bands=BANDS) -> bool:
    low, high = next((a, b) for most, a, b in bands if raw < most)
    return low <= raw / packed <= high


def chunks(raw: bytes, size: int = CHUNK) -> list[bytes]:
    """All of raw in chunks of `size`; what is left at the end makes a chunk too, or from a second chunk on, if it is below LEAST_CHUNK, lengthens the last."""
    starts = list(range(0, len(raw), size))
    if len(starts) > 1 and len(raw) - starts[-1] < LEAST_CHUNK:
        starts.pop()
    return [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)])]  # noqa: B905  none for no text


def is_hex(raw: bytes) -> bool:
    """At least nine tenths of the bytes besides white space are hexadecimal digits, of both kinds as in encoded data (a table of numbers has few letters)."""
    n = len(raw.translate(None, SPACES.encode()))
    letters, digits = n - len(raw.translate(None, HEX_LETTERS + SPACES.encode())), n - len(raw.translate(None, HEX_DIGITS + SPACES.encode()))
    return n > 0 and 10 * (letters + digits) >= 9 * n and 5 * letters >= n and 5 * digits >= 2 * n


def _maker(bands, chunk, bad_share):
    import zstandard

    zip_ = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress

    def one(text: str | None) -> tuple:
        text = text or ""
        raw = text.encode()
        words = raw.split()
        n = len(words)
        chars = len(text) - sum(map(text.count, SPACES))
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        repeat = repeated_words(words)
        failed = n < MIN_WORDS or 100 * repeat > 50 * n
        ratio, parts, bad = 1.0, 0, 0
        if raw:
            packed = len(zip_(raw))
            ratio = len(raw) / packed
            for part in chunks(raw, chunk):
                parts += 1
                bad += is_hex(part) or not in_band(len(part), len(zip_(part)), bands)
        kept = not failed and not is_hex(raw) and in_band(len(raw), packed, bands) and bad <= bad_share * parts
        return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, ratio, parts, bad, kept

    return lambda texts: list(zip(*map(one, texts), strict=True)) if texts else [[] for _ in FIELDS]


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None, bands=BANDS, chunk: int = CHUNK, bad_share: float = BAD_CHUNKS) -> DataFrame:
    """The columns `keep` of docs (default: doc_id) plus FIELDS, one row per row.

    base_failed: fewer than 50 words, or over half of them in repeated windows of three words. kept: not base_failed,
    the whole text in the band of its length and not hexadecimal, and at most `bad_share` of its chunks out of theirs or
    hexadecimal; every byte lies in one chunk. A null text counts as empty: no words, so base_failed; ratio is 1. Rows are
    judged one by one, so ties and repeated rows need no rule; an empty table gives none. A kept column with the name of
    a result comes back with an underscore in front. Work and memory grow with one text at a time, however long.
    """
    return map_texts(docs, lambda: _maker(bands, chunk, bad_share), FIELDS, text, ["doc_id"] if keep is None else keep)


def drop_low_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with their columns as they are, whatever their names; nulls, repeated rows, empty tables and very long texts as there."""
    flag = fresh("kept_", docs.columns)
    kept = [(flag, T.BooleanType(), pa.bool_())]

    def make():
        f = _maker(BANDS, CHUNK, BAD_CHUNKS)
        return lambda texts: [f(texts)[-1]]

    return map_texts(docs, make, kept, text).where(f"`{flag}`").drop(flag)


#: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; the compression bands have no SQL form.
BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM w, unnest(range(1, len(ws) - 1)) u(i)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n >= 2) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(ws) AS base_failed
FROM w LEFT JOIN c USING (r)
"""
