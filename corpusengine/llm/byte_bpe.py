"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

The vocabulary of a rank file (base64 bytes, rank) is written as a sentencepiece BPE model:
byte b is the character U+0100 + b, a piece's score is its negative rank, so the merge of
the lowest rank goes first, and normalisation is the identity. Each match of the splitting
pattern is encoded on its own; a match that is a token as a whole is that token. Decoding
maps ids to their bytes.

Defined results: a null text counts as empty (no ids); null ids decode to empty bytes;
every text is encoded whole, whatever its length; extra columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusengine.session import small_batches

#: Bounds of a worker's cache of encoded chunks: entries, and characters of an entry.
CACHE_ENTRIES, CACHE_CHARS = 100_000, 48
#: Texts that are looked up in the cache together.
BATCH = 256
BYTE_CHAR = [chr(0x100 + b) for b in range(256)]
NORMAL, UNKNOWN, UNUSED, BPE = 1, 2, 5, 2
OTHER_BLANK = re.compile(r"[^\S \n]")


def regular(text: str) -> bool:
    """Whether every space stands between two characters that aren't blanks (no other blank but newline occurs)."""
    return not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or OTHER_BLANK.search(text))


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: pieces in the order of their ranks, gaps unused, the unknown piece last."""
    by_rank = {r: t for t, r in ranks.items()}
    size = max(by_rank, default=-1) + 1

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))

    pieces = [piece("".join(BYTE_CHAR[b] for b in by_rank[r]), -float(r), NORMAL) if r in by_rank else piece(f"<gap{r}>", 0.0, UNUSED) for r in range(size)]
    trainer = _number(3, BPE) + _number(4, size + 1) + _number(40, size) + b"".join(_number(k, (1 << 64) - 1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + piece("<unk>", 0.0, UNKNOWN) + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    """Encodes texts batch by batch; a cache keeps the ids of chunks that follow a space."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str):
        import public_tokenizers
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        # in this pattern a space between two other characters always begins a match, so such texts fall apart there
        self.at_spaces = pattern == public_tokenizers.PATTERN
        self.whole = {t.decode("latin-1"): struct.pack("<I", r) for t, r in ranks.items()}
        self.table = {b: BYTE_CHAR[b] for b in range(256)}
        self.cache: dict[str, bytes] = {}
        self.token = {r: t for t, r in ranks.items()}.__getitem__

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ``ids`` stand for."""
        return b"".join(map(self.token, np.frombuffer(ids, dtype="<u4").tolist()))

    def matches(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, split by the pattern."""
        split = [[m.encode().decode("latin-1") for m in self.split(t)] for t in texts]
        known = self.whole
        new = list({m for ms in split for m in ms if m not in known})
        ids = self.pieces.encode([m.translate(self.table) for m in new], num_threads=1)
        found = {m: struct.pack(f"<{len(x)}I", *x) for m, x in zip(new, ids, strict=True)}
        return [b"".join([known[m] if m in known else found[m] for m in ms]) for ms in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        out: list[bytes | list[str]] = []
        heads, new = [], set()
        for t in texts:
            head, *rest = t.split(" ") if self.at_spaces and regular(t) else [t]
            heads.append(head)
            out.append(rest)
            new.update(rest)
        todo = [c for c in new if c not in self.cache]
        found = dict(zip(todo, self.matches([" " + c for c in todo]), strict=True))
        self.cache.update(found)
        done = [first + b"".join(map(self.cache.__getitem__, rest)) for first, rest in zip(self.matches(heads), out, strict=True)]
        for c in todo:
            if len(c) > CACHE_CHARS:
                del self.cache[c]
        return done


@lru_cache(maxsize=2)
def encoder_of(content: bytes, pattern: str) -> Encoder:
    """A worker process makes an encoder once; a task leaves its cache empty."""
    ranks = read_ranks(content)
    return Encoder(sentencepiece_model(ranks), ranks, pattern)


class ByteBpe:
    """Column functions ``encode`` and ``decode`` of one vocabulary.

    The rank file is read here, once; it has a fixed size, whatever the documents are.
    """

    def __init__(self, spark: SparkSession, rank_file: str, pattern: str):
        small_batches(spark)
        with open(rank_file, "rb") as f:
            content = f.read()
        shared = spark.sparkContext.broadcast((content, pattern))

        @pandas_udf("binary")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = encoder_of(*shared.value)
            for texts in batches:
                rows = [t or "" for t in texts]
                yield pd.Series([x for k in range(0, len(rows), BATCH) for x in encoder.encode(rows[k : k + BATCH])], dtype=object)
            encoder.cache.clear()

        @pandas_udf("binary")
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = encoder_of(*shared.value)
            for ids in batches:
                yield pd.Series([encoder.decode(x or b"") for x in ids], dtype=object)

        @pandas_udf("ids binary, decoded_sha256 string")
        def round_trip(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            encoder = encoder_of(*shared.value)
            for texts in batches:
                rows = [t or "" for t in texts]
                ids = [x for k in range(0, len(rows), BATCH) for x in encoder.encode(rows[k : k + BATCH])]
                yield pd.DataFrame({"ids": ids, "decoded_sha256": [hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids]}, dtype=object)
            encoder.cache.clear()

        self._encode, self._decode, self._round_trip = encode, decode, round_trip

    def encode(self, text: Column) -> Column:
        """Ids as little-endian unsigned 32-bit integers."""
        return self._encode(text)

    def round_trip(self, text: Column) -> Column:
        """Struct of ``ids`` and of the hash of the bytes decoded from them, in one Python worker."""
        return self._round_trip(text)

    def decode(self, ids: Column) -> Column:
        """The bytes that ``ids`` stand for."""
        return self._decode(ids)


def encode_documents(docs: DataFrame, codec: ByteBpe, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``n_tokens``."""
    return docs.withColumn("ids", codec.encode(F.col(text))).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


def decode_documents(docs: DataFrame, codec: ByteBpe) -> DataFrame:
    """``docs`` (with ``ids``) with ``decoded``."""
    return docs.withColumn("decoded", codec.decode(F.col("ids")))


def encode_and_decode(docs: DataFrame, codec: ByteBpe, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``decoded_sha256``, which proves the way back; columns of these names are replaced."""
    met = docs.drop("ids", "n_tokens", "decoded_sha256").withColumn("_bpe", codec.round_trip(F.col(text)))
    kept = [c for c in met.columns if c != "_bpe"]
    return met.select(*kept, F.col("_bpe.ids").alias("ids"), (F.length("_bpe.ids") / 4).cast("long").alias("n_tokens"), F.col("_bpe.decoded_sha256").alias("decoded_sha256"))
