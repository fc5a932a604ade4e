"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word with the piece model's word mark in front. The forward score of a prefix (its best segmentation)
depends on the prefix alone, so it is computed once for each node of the trie, from the scores of its ancestors; a
node where a pre-token ends gives that pre-token's count, which is stored and looked up from then on. A node keeps its
state in an automaton of the pieces, so that only pieces which end there are looked at, not every substring that might be one.
"""

from __future__ import annotations

from itertools import chain
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import held, map_texts

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Nodes in a worker's trie, about 100 MB, and words whose counts it knows, about 45 MB; where there are more, either starts
#: anew before the next slice, which costs time and changes no count.
MOST_NODES = 500_000
#: Steps between states that a worker remembers besides those that the pieces spell, about 30 MB.
MOST_STEPS = 300_000
FIELDS = [("n_pretokens", T.LongType(), pa.int64()), ("n_tokens", T.LongType(), pa.int64())]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def load_pieces(path: str) -> dict[str, float]:
    """Ordinary pieces with log-probabilities by Zipf's law over their ranks: the file ranks its pieces and holds no frequencies."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {p: -log(r + 2) for r, p in enumerate(ranked)}


class Pieces:
    """Which pieces end at a character: an Aho-Corasick automaton, so that no substring is cut out to be looked up.

    A state is the longest prefix of a piece that ends at the character; hits[state] has (characters, score, tokens) of
    each piece that ends there, and of the last character's UTF-8 bytes if it is no piece itself.
    """

    def __init__(self, pieces: dict[str, float]):
        self.byte = min(pieces.values(), default=0.0) - 10
        self.step: dict[int, int] = {}
        self.fail: list[int] = [0]
        self.hits: list[tuple[tuple[int, float, int], ...]] = [()]
        state = {"": 0}
        for p in sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)}, key=len):
            before, c = state[p[:-1]], ord(p[-1])
            fail = self.next(self.fail[before], c) if before else 0
            state[p] = self.step[before << 21 | c] = len(self.hits)
            own = ((len(p), pieces[p], 1),) if p in pieces else ()
            self.hits.append(own + (self.hits[fail] or (() if own and len(p) == 1 else self.raw(c))))
            self.fail.append(fail)
        self.most = len(self.step) + MOST_STEPS

    def raw(self, c: int) -> tuple[tuple[int, float, int], ...]:
        """The character as bytes: all that can be said of it in state 0, where no piece has it."""
        size = len(chr(c).encode())
        return ((1, size * self.byte, size),)

    def next(self, state: int, c: int) -> int:
        step, fail, at = self.step, self.fail, state
        while (found := step.get(at << 21 | c)) is None and at:
            at = fail[at]
        return found or 0

    def learn(self, state: int, c: int) -> int:
        """next(), remembered as long as there is room."""
        found = self.next(state, c)
        if len(self.step) < self.most:
            self.step[state << 21 | c] = found
        return found


class Trie:
    """Best segmentations of prefixes: the highest score, then the fewest tokens. A character without a piece is its UTF-8 bytes, one token each."""

    def __init__(self, pieces: dict[str, float], most: int = MOST_NODES):
        self.pieces, self.most = Pieces(pieces), most
        self.counts: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count, self.state = [0.0], [0], [0]

    def insert(self, token: str) -> int:
        """The count of token; only nodes that were not there are computed."""
        return self.insert_all([token])[0]

    def insert_all(self, tokens: list[str]) -> list[int]:
        """The counts of tokens. Each token is followed from where it leaves the one before, so sorted ones go fastest."""
        child, score, count, states, auto = self.child, self.score, self.count, self.state, self.pieces
        step, hits = auto.step, auto.hits
        out, last, path = [], "", [0]
        for token in tokens:
            i = 0
            for a, b in zip(token, last, strict=False):
                if a != b:
                    break
                i += 1
            del path[i + 1 :]
            last, node = token, path[i]
            points = iter(map(ord, token[i:]))
            for c in points:
                if (found := child.get(node << 21 | c)) is None:
                    break
                path.append(node := found)
            else:
                out.append(count[node])
                continue
            at = states[node]
            for c in chain((c,), points):
                if (found := step.get(at << 21 | c)) is None:
                    found = auto.learn(at, c)
                at = found
                best, n = None, 0
                for size, s, k in hits[at] or auto.raw(c):
                    j = path[-size]
                    s += score[j]
                    if best is None or s > best:
                        best, n = s, k + count[j]
                    elif s == best:
                        n = min(n, k + count[j])
                child[node << 21 | c] = node = len(score)
                score.append(best)
                count.append(n)
                states.append(at)
                path.append(node)
            out.append(n)
        return out

    def tokens(self, words: list[bytes]) -> int:
        return self.tokens_of([words])[0]

    def tokens_of(self, texts: list[list[bytes]]) -> list[int]:
        """The number of tokens of each text, given as its words."""
        words = set().union(*texts)
        if missing := words.difference(self.counts):
            if len(self.score) > self.most:
                self.clear()
            if len(self.counts) > self.most:
                self.counts = {w: self.counts[w] for w in words - missing}
            new = sorted(missing)
            self.counts.update(zip(new, self.insert_all([MARK + w.decode() for w in new]), strict=True))
        return [sum(map(self.counts.__getitem__, ws)) for ws in texts]


def _load(path: str) -> Trie:
    return Trie(load_pieces(path))


def trie(path: str) -> Trie:
    return held(_load, path)


def _maker(path):
    def make():
        t = trie(path)

        def f(texts):
            words = [(x or "").encode().split() for x in texts]
            return [list(map(len, words)), t.tokens_of(words)]

        return f

    return make


def count_tokens(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The columns `keep` of docs (default: doc_id) plus n_pretokens (words) and n_tokens, one row per row.

    A null text counts as empty: 0 and 0. Whole texts are counted, however long; repeated rows get the same counts, and of
    equally good segmentations the one of fewest tokens counts. Other columns are not read; a kept one with the name of a
    result comes back with an underscore in front. An empty table gives no rows.
    """
    return map_texts(docs, _maker(path or default_path()), FIELDS, text, ["doc_id"] if keep is None else keep)
