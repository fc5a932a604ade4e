"""Secret scans: fixed patterns, then sliding-window Shannon entropy over candidate strings.

A candidate is a run of 20 or more key characters, letters of one case alone included. A window of 20 characters slides
over it; the counts, and with them the sum of c*log2(c), change by one character in and one out a step. Windows whose
entropy reaches the limit of the candidate's character class make a span, and spans that overlap are one. The allow-list
knows whole candidates, and the pieces between slashes that hold the hottest window of a span: a sample or a word
elsewhere in a path hides nothing. Letters of one case are told from compound words by the height of their limit alone,
which about a third of random strings of 40 such letters reach, and almost no word.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

KINDS = ("assign", "access", "hex", "entropy")
_either = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)
_KEYS = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
ASSIGN = re.compile(rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A match that is too short never hides a longer one here, so the least length stands in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
WINDOW = 20
#: Class of a candidate: pattern and least entropy in bits a character of a window.
CLASSES = (("hex", re.compile(r"[0-9A-Fa-f]+"), 2.8), ("word", re.compile(r"[a-z_-]+|[A-Z_-]+"), 3.9), ("lower", re.compile(r"[a-z0-9]+"), 3.5), ("upper", re.compile(r"[A-Z0-9]+"), 3.5), ("mixed", re.compile(r".+"), 3.75))
#: What is no secret, as a whole or as a piece between slashes: UUIDs, numbers with separators, dates, words of up to 18 letters, with a number or none, joined by signs.
ALLOW = (
    re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),
    re.compile(r"[0-9_/+-]+"),
    re.compile(r"(?:(?:(?:[A-Z]?[a-z]{1,18}|[A-Z]{1,18})[0-9]{0,4}|[0-9]{1,4})(?:[/_+-]+|$))+"),
)
#: A piece with one of these is a sample or an alphabet; the one whole sample key that has slashes.
SAMPLE = re.compile(r"EXAMPLE|0123456789|abcdefghij|ABCDEFGHIJ")
SAMPLE_KEY = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
#: Letters of both cases alone are words run together if these have so many letters on average.
CAMEL, CAMEL_LETTERS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+"), 3.5
LN = [0.0, 0.0, *(n * log2(n) for n in range(2, WINDOW + 1))]


def hot_spans(s: str, limit: float, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, end, hottest) of the unions of overlapping windows of s whose entropy reaches limit; hottest: where the first window of greatest entropy in it starts."""
    counts = Counter(s[:window])
    total = sum(LN[c] for c in counts.values())
    most = window * (log2(window) - limit) + 1e-9  # entropy = log2(w) - total / w
    out: list[list] = []
    for i in range(len(s) - window + 1):
        if i:
            gone, come = s[i - 1], s[i + window - 1]
            if gone != come:
                a, b = counts[gone], counts[come]
                total += LN[a - 1] - LN[a] + LN[b + 1] - LN[b]
                counts[gone], counts[come] = a - 1, b + 1
        if total <= most:
            if out and i < out[-1][1]:
                out[-1][1] = i + window
                if total < out[-1][3] - 1e-9:
                    out[-1][2:] = i, total
            else:
                out.append([i, i + window, i, total])
    return [(a, b, c) for a, b, c, _ in out]


def allowed(s: str) -> bool:
    """The allow-list knows s, a whole candidate or a piece of one."""
    return any(a.fullmatch(s) for a in ALLOW) or s.isalpha() and not s.islower() and not s.isupper() and len(s) >= CAMEL_LETTERS * len(CAMEL.findall(s))


def hidden(s: str, hottest: int, window: int = WINDOW) -> bool:
    """The pieces between slashes that hold a quarter of the hottest window or more are all allowed, or one is a sample."""
    at, pieces = 0, []
    for piece in s.split("/"):
        if min(at + len(piece), hottest + window) - max(at, hottest) >= window // 4:
            pieces.append(piece)
        at += len(piece) + 1
    return all(map(allowed, pieces)) or any(map(SAMPLE.search, pieces))


def entropy_spans(s: str) -> list[tuple[int, int]]:
    """(start, end) in a candidate."""
    body = s.rstrip("=")
    if allowed(body) or body == SAMPLE_KEY or not any(map(str.isalpha, body)):
        return []
    limit = next(limit for _, p, limit in CLASSES if p.fullmatch(body))
    return [(a, b) for a, b, hottest in hot_spans(body, limit) if not hidden(body, hottest)]


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind. An entropy span inside a span of a pattern is left out."""
    text = text or ""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    base = list(spans)
    for m in CANDIDATE.finditer(text):
        at = m.start()
        spans += [("entropy", at + a, at + b) for a, b in entropy_spans(m[0]) if not any(x <= at + a and at + b <= y for _, x, y in base)]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FIELDS = [("n_assign", T.LongType(), pa.int64()), ("n_access", T.LongType(), pa.int64()), ("n_hex", T.LongType(), pa.int64()), ("n_entropy", T.LongType(), pa.int64()), ("base_sha256", T.StringType(), pa.string()), ("spans", T.StringType(), pa.string())]


def _make():
    def one(text):
        spans = find(text)
        n = Counter(k for k, _, _ in spans)
        return *(n[k] for k in KINDS), hashlib.sha256(joined(x for x in spans if x[0] != "entropy").encode()).hexdigest(), joined(spans)

    return lambda texts: list(zip(*map(one, texts), strict=True)) if texts else [[] for _ in FIELDS]


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: doc_id) plus counts by kind, base_sha256 and spans, one row per row.

    A null text counts as empty: no spans, and base_sha256 is the digest of the empty string. Rows are scanned one by
    one over their whole text, so ties and repeated rows need no rule, and memory grows with one text. spans lists
    kind:start:end (code points, end exclusive), by start, then kind. Other columns are not read; a kept one with the name
    of a result comes back with an underscore in front. An empty table gives no rows.
    """
    return map_texts(docs, _make, FIELDS, text, ["doc_id"] if keep is None else keep)


def redact(docs: DataFrame, text: str = "text", mark: str = "[{kind}]", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: doc_id) plus `redacted`: the text with every span replaced; null stays null. Kept columns, ties and empty tables as in scan()."""

    def one(t):
        if t is None:
            return None
        out, at = [], 0
        for kind, a, b in find(t):
            if a >= at:
                out += [t[at:a], mark.format(kind=kind)]
            at = max(at, b)
        return "".join([*out, t[at:]])

    return map_texts(docs, lambda: lambda texts: [list(map(one, texts))], [("redacted", T.StringType(), pa.string())], text, ["doc_id"] if keep is None else keep)


#: Numbers of base matches; positions and entropy have no SQL form.
BASE_SQL = rf"""
SELECT doc_id, len(list_filter(regexp_extract_all(t, '({_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8))::BIGINT AS n_assign,
       len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16))::BIGINT AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32))::BIGINT AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
