"""BPE encoding and decoding through a table of distinct words.

No merge crosses white space, so a text's ids are its words' ids put together by position. Each Python worker keeps a
table of the distinct words it has met: a word is encoded once, later positions look its ids up. Decoding joins ids
with the table of pieces.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, held, map_texts

VOCABULARY = "word_bpe_49k.json"
#: Words in a worker's table, about 60 MB; a fuller table starts anew, which costs time and changes no result.
MOST_WORDS = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def coder(path: str) -> WordTable:
    return held(WordTable, path)


class WordTable:
    """word (bytes) -> ids as little-endian unsigned 32-bit integers (bytes); pieces: by id."""

    def __init__(self, path: str, most: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        if self.tok.decoder is not None:
            raise ValueError("only vocabularies without a decoder are decoded by joining pieces")
        self.pieces = {i: p for p, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.words: dict[bytes, bytes] = {}
        self.most = most

    def add(self, words: set[bytes]) -> None:
        import numpy as np

        if len(self.words) + len(words) > self.most:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        for w, e in zip(new, self.tok.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
            self.words[w] = np.asarray(e.ids, "<u4").tobytes()

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids as bytes, and the decoded text."""
        import numpy as np

        words = (text or "").encode().split()
        if missing := {w for w in set(words) if w not in self.words}:
            self.add(set(words) if len(self.words) + len(missing) > self.most else missing)
        ids = b"".join([self.words[w] for w in words])
        return ids, " ".join([self.pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


DIGESTS = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
IDS = [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("decoded", T.StringType(), pa.string())]


def _digests(path):
    def make():
        encode = coder(path).encode

        def f(texts):
            out = []
            for t in texts:
                ids, decoded = encode(t)
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            return list(zip(*out, strict=True)) if out else [[] for _ in DIGESTS]

        return f

    return make


def _ids(path):
    def make():
        import numpy as np

        encode = coder(path).encode

        def f(texts):
            both = [encode(t) for t in texts]
            ends = np.cumsum([0, *(len(i) // 4 for i, _ in both)])
            flat = np.frombuffer(b"".join([i for i, _ in both]), "<i4")
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), [d for _, d in both]]

        return f

    return make


def encode_digests(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The columns `keep` of docs (default: doc_id) plus n_tokens and the digests of ids and decoded text, one row per row.

    As the tokenizers library encodes (no special tokens added; their strings in a text become their ids, as there) and
    decodes (special tokens kept). A null text counts as empty: 0 tokens. Rows need no order; repeats give the same. A
    very long text is encoded whole, word by word. Other columns are not read; a kept one with the name of a result comes
    back with an underscore in front. An empty table gives no rows.
    """
    return map_texts(docs, _digests(path or default_path()), DIGESTS, text, ["doc_id"] if keep is None else keep)


def encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """As encode_digests, with the columns ids (array<int>) and decoded (string) themselves."""
    return map_texts(docs, _ids(path or default_path()), IDS, text, ["doc_id"] if keep is None else keep)


def encode_by_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The same through one table of distinct words for the whole corpus: doc_id, ids, decoded, one row per row.

    Distinct texts are split in Spark, each distinct word is encoded once, and ids come back by a join on the word and by
    position; decoding joins ids with pieces. It shuffles every word position twice, several times the text's size, so
    encode() is the way for large tables. Null texts count as empty; null and repeated ids keep their rows.
    """
    path = path or default_path()
    spark = docs.sparkSession
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")).withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    words = rows.groupBy("h").agg(F.first("text").alias("text")).select("h", F.posexplode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("pos", "word"))
    coded = encode(words.select("word").where("word IS NOT NULL").distinct(), "word", ["word"], path).select(F.col("word").alias("w"), "ids")
    tokens = words.join(coded, F.col("word") == F.col("w"), "left").select("h", "pos", F.posexplode_outer("ids").alias("k", "id"))
    table = [(i, p) for i, p in coder(path).pieces.items()]  # as large as the vocabulary
    pieces = spark.createDataFrame(table, "piece_id long, piece string")
    tokens = tokens.join(pieces, F.col("id") == F.col("piece_id"), "left")
    made = tokens.groupBy("h").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "k", "id", "piece")))).alias("t"))
    return rows.drop("text").join(made, "h").select("doc_id", F.col("t.id").alias("ids"), F.array_join("t.piece", " ").alias("decoded"))
