"""Exact dedup with a two-pass Bloom filter.

Texts are equal when they are identical after deleting blanks. In pass one every task sets
the bits of its own rows' hashes in two planes, once and twice, cut into pieces of 2^16
bits; only the planes travel, two bytes a bit that is set, and the pieces of all tasks are
merged. The bits set at least twice are the Bloom filter of possibly repeated hashes. Pass
two probes it: a hash with a bit that was set only once is the only one of its kind, and its
row passes straight through. Only the other rows shuffle, as (hash, id, length), and are
grouped exactly, so false positives of the filter cost a little shuffling and never a wrong
result.

The filter has ``bits_per_row`` bits a document, but no more than ``max_bits`` (32 MB), the
proven bound of what is broadcast. Beyond some 17 million documents it thus has fewer bits a
row, more rows shuffle (thin ones: hash, id, length), and results stay exact.

Defined results: a null text counts as empty; empty texts are equal to each other; of equal
texts the longest original stays, then the smallest id (null ids last), then the first row,
so exactly one row of a group is kept, also where rows repeat with one id; extra columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusengine.llm.graphs import join_groups
from corpusengine.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
N_HASHES = 3
#: Bits of a piece of a plane, and hashes that a task collects before it sends its planes.
PIECE, FLUSH = 1 << 16, 1 << 20


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def hashed_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_chars, text_sha256, row, carried columns): a hundredth of the documents' bytes, written once."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.length(text), F.lit(0)).alias("n_chars"),
        F.sha2(normalised(F.col(text)), 256).alias("text_sha256"),
        *carry,
    )
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()))


def bit_places(sha: Column, n_bits: int) -> Column:
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(sha, F.lit(k)), F.lit(n_bits)) for k in range(N_HASHES)]))


def planes(places: np.ndarray) -> pd.DataFrame:
    """Pieces of a task's two planes: the bits that ``places`` set once, and those they set again."""
    bit, n = np.unique(places, return_counts=True)
    starts = np.flatnonzero(np.diff(bit // PIECE, prepend=-1))
    ends = np.append(starts[1:], len(bit))
    short = (bit % PIECE).astype("<u2")
    rows = [(int(bit[i] // PIECE), short[i:j][n[i:j] == 1].tobytes(), short[i:j][n[i:j] > 1].tobytes()) for i, j in zip(starts, ends, strict=True)]
    return pd.DataFrame(rows, columns=["piece", "once", "twice"])


def merge_planes(df: pd.DataFrame) -> pd.DataFrame:
    """The bits of a piece that are set at least twice over all tasks, as bytes."""
    once, twice = np.zeros(PIECE, bool), np.zeros(PIECE, bool)
    for a, b in zip(df["once"], df["twice"], strict=True):
        bit = np.frombuffer(a, "<u2")
        twice[bit] |= once[bit]
        once[bit] = True
        twice[np.frombuffer(b, "<u2")] = True
    return pd.DataFrame({"piece": df["piece"].iloc[:1], "bits": [np.packbits(twice, bitorder="little").tobytes()]})


def repeated_bits(hashed: DataFrame, n_bits: int) -> np.ndarray:
    """The filter's bits set by at least two rows, as bytes (bit p in byte p // 8); ``n_bits`` / 8 bytes at most."""

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, n = [], 0
        for df in batches:
            kept += [np.concatenate(df["places"].to_list())] if len(df) else []
            n += len(df)
            if n >= FLUSH:
                yield planes(np.concatenate(kept))
                kept, n = [], 0
        if kept:
            yield planes(np.concatenate(kept))

    sent = hashed.select(bit_places(F.col("text_sha256"), n_bits).alias("places")).mapInPandas(collect, "piece int, once binary, twice binary")
    bits = np.zeros(-(-n_bits // PIECE) * PIECE // 8, np.uint8)
    for r in sent.groupBy("piece").applyInPandas(merge_planes, "piece int, bits binary").toLocalIterator():
        bits[r["piece"] * (PIECE // 8) : (r["piece"] + 1) * (PIECE // 8)] = np.frombuffer(r["bits"], np.uint8)
    return bits


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits_per_row: int = 16, max_bits: int = 1 << 28, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: carried columns, doc_id, keep_id, group_size, kept, text_sha256, possibly_repeated."""
    hashed = hashed_rows(docs, text, doc_id, carry)
    n_rows = hashed.count()
    n_bits = min(max(1024, bits_per_row * n_rows), max_bits)
    bits = hashed.sparkSession.sparkContext.broadcast(repeated_bits(hashed, n_bits))

    @pandas_udf("boolean")
    def possibly_repeated(places: pd.Series) -> pd.Series:
        if not len(places):
            return pd.Series([], dtype=bool)
        sizes = places.map(len).to_numpy()
        p = np.concatenate(places.to_list())
        hit = bits.value[p >> 3] >> (p & 7).astype(np.uint8) & 1
        return pd.Series(np.minimum.reduceat(hit, np.cumsum(sizes) - sizes).astype(bool))

    probed = hashed.withColumn("possibly_repeated", possibly_repeated(bit_places(F.col("text_sha256"), n_bits)))
    rows = materialize(probed)
    alone = rows.filter(~F.col("possibly_repeated")).select(*carry, "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "possibly_repeated")

    suspects = rows.filter("possibly_repeated")
    # longest first, then smallest id with nulls last, then first row
    best = F.min_by(F.struct("doc_id", "row"), F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "row"))
    groups = materialize(suspects.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size")))
    met = join_groups(suspects, groups, "text_sha256", "group_size", n_rows)
    return alone.unionByName(met.select(*carry, "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "possibly_repeated"))
