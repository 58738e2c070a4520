"""Cross-tokenizer alignment: two tokenizers' ids of the same bytes, linked where their ends meet.

Byte offsets where a token of A and a token of B both end cut a text into groups; all A and
B tokens of a group are linked. An id pair's count is the number of documents that hold it
linked.

The first pass aligns every document and writes, per task, each pair with the number of its
documents that hold it. The distinct pairs are dealt into buckets by hash, and each bucket
gets a minimal perfect hash. Counts are dense vectors indexed by it: leaves of the tree
add up the partial counts of a bucket, and the leaves' vectors are added ``FAN_IN`` at a
time. The second pass aligns the documents again and looks counts up. Pairs of the highest
counts, at most ``most_pairs``, are broadcast as one perfect hash with verified keys; pairs
beyond that bound leave the pass as thin rows and meet their counts in a shuffle. The
highest count of every A id is a vector as long as A's vocabulary.

Both tokenizers begin a token at a space that follows a character other than white space, so
such spaces cut a text into chunks that are aligned on their own, each distinct chunk of a
batch once. ``Aligner`` tests the vocabularies for that property and aligns whole texts
where they lack it.

Defined results: a null or empty text, and one whose tokens of A or B don't give its bytes
back, has no tokens (zeros and an empty hash); repeated rows are documents of their own and
each counts; ids may be null; extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusengine.llm.perfect_hash import PerfectHash
from corpusengine.session import materialize, scratch_scope, small_batches

#: A pair is a * SHIFT + b, so ids lie below SHIFT.
SHIFT = 1 << 24
#: Characters of texts aligned together; chunks that a worker remembers; chunks that B encodes as one text.
TEXTS, CACHE_ENTRIES, TOGETHER = 1 << 21, 500_000, 32
#: Distinct pairs of a bucket in the mean, at most; leaves of a bucket's tree; vectors added at once.
BUCKET, LEAVES, FAN_IN = 1 << 17, 16, 4
SPACE = "▁"
CUT = re.compile(r"(?<=\S) ")
ODD_SPACE = re.compile(r"\s ")


def byte_of_character() -> dict[str, int]:
    """Byte-level BPE writes printable bytes of Latin-1 as themselves and the others, in order, from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def ranks_of(a_file: bytes) -> dict[bytes, int] | None:
    """Bytes of the tokens of a byte-level BPE, if its merges come in the order of their ids, as ranks; else None."""
    model, of = json.loads(a_file)["model"], byte_of_character()
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if ids != sorted(ids) or len(model["vocab"]) != len(ids) + len(of) or model.get("ignore_merges"):
        return None
    return {bytes(of[c] for c in token): k for token, k in model["vocab"].items()}


class Growing:
    """A numpy array that rows are appended to."""

    def __init__(self, kind):
        self.room, self.size = np.zeros(1 << 10, dtype=kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.zeros(self.size + 2 * len(more), dtype=self.room.dtype)])
        self.room[self.size : self.size + len(more)] = more
        self.size += len(more)

    @property
    def rows(self) -> np.ndarray:
        return self.room[: self.size]


class Aligner:
    """Aligns texts by chunks; A is a byte-level BPE in a file of the tokenizers library, B a sentencepiece model.

    Aligned chunks are remembered as numbers: the ids of their pairs in a flat array, how
    often each chunk and pair occurs, and sums over a chunk's links. What is remembered is
    bounded and outlives a task.
    """

    def __init__(self, a_file: bytes, b_file: bytes):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        of = byte_of_character()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        byte = [self.b.is_byte(k) for k in range(len(pieces))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if x else p.replace(SPACE, " ").encode() for p, x in zip(pieces, byte, strict=True)]
        self.a_length = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        split = json.loads(a_file).get("pre_tokenizer") or {}
        # only with the byte-level pattern of A and pieces of B that don't run across a space are chunks independent
        self.by_chunks = split.get("type") == "ByteLevel" and split.get("use_regex", False) and not any(re.search(rf"[^\s{SPACE}]{SPACE}", p) for p, x in zip(pieces, byte, strict=True) if not x)
        ranks = ranks_of(a_file) if self.by_chunks else None
        # the same merges as ranks: many chunks then take one call
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        names = lambda n, mark: np.array([f"{k}{mark}" for k in range(n)], dtype=object)
        self.names = {mark: names(len(self.a_bytes) if mark != ";" else len(pieces), mark) for mark in "|,;"}
        self.b_names = names(len(pieces), ",")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.said: list[str] = []
        self.good, self.n_a, self.n_b, self.n_groups, self.n_links, self.first = (Growing(k) for k in (bool, *[np.int64] * 5))
        self.uses = Growing(np.int64)
        self.pair_ids: dict[int, int] = {}
        self.pairs, self.entries = Growing(np.int64), Growing(np.int32)

    def keep_frequent(self) -> None:
        """Forget all chunks but the half that came most often; the pairs stay."""
        most = min(CACHE_ENTRIES // 2, len(self.known))
        kept = np.sort(np.argpartition(-self.uses.rows, most - 1)[:most])
        names = list(self.known)
        self.known = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.said = [self.said[k] for k in kept.tolist()] if self.said else []
        n = self.n_links.rows[kept]
        ends = np.cumsum(n)
        at = np.arange(n.sum()) + np.repeat(self.first.rows[kept] - (ends - n), n)
        entries, first = self.entries.rows[at], ends - n
        columns = [x.rows[kept] for x in (self.good, self.n_a, self.n_b, self.n_groups, self.n_links)]
        self.good, self.n_a, self.n_b, self.n_groups, self.n_links, self.first, self.entries, self.uses = (Growing(x.dtype) for x in (*columns, first, entries, first))
        for column, rows in zip((self.good, self.n_a, self.n_b, self.n_groups, self.n_links, self.first, self.entries, self.uses), (*columns, first, entries, np.zeros(most, np.int64)), strict=True):
            column.add(rows)

    def chunks(self, text: str) -> list[str]:
        """Chunks whose texts, each after a space, make up a space and the text."""
        if not self.by_chunks:
            return [text]
        if text[-1] != " " and text[0] != " " and not ODD_SPACE.search(text):
            return text.split(" ")
        found = CUT.split(text)
        if len(found) > 1 and not found[-1]:
            # B gives an empty text no tokens at all, so a last space stays with its chunk
            found[-2:] = [found[-2] + " "]
        return found

    def together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Flat ids of A and B, and the byte ends, of chunks that are encoded in one call; None if that doesn't give the bytes."""
        joined = " " + " ".join(chunks)
        want = joined.encode()
        flat_a = self.fast.encode_to_numpy(joined, disallowed_special=()).astype(np.int64)
        flat_b = np.array([x for ids in self.b.encode([" ".join(chunks[k : k + TOGETHER]) for k in range(0, len(chunks), TOGETHER)], num_threads=1) for x in ids], dtype=np.int64)
        if b"".join(map(self.a_bytes.__getitem__, flat_a.tolist())) != want or b"".join(map(self.b_bytes.__getitem__, flat_b.tolist())) != want:
            return None
        return flat_a, flat_b, np.cumsum([len(c) + 1 for c in (chunks if want.isascii() else map(str.encode, chunks))])

    def one_by_one(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same of chunks encoded each on its own, and which of them give their bytes; the others take none."""
        ids_a = [e.ids for e in self.a.encode_batch([" " + c for c in chunks], add_special_tokens=False)]
        ids_b = self.b.encode(chunks, num_threads=1)
        want = [(" " + c).encode() for c in chunks]
        good = np.array([w == b"".join(map(self.a_bytes.__getitem__, a)) == b"".join(map(self.b_bytes.__getitem__, b)) for w, a, b in zip(want, ids_a, ids_b, strict=True)], dtype=bool)
        flat = lambda ids: np.array([x for one, ok in zip(ids, good, strict=True) if ok for x in one], dtype=np.int64)
        return flat(ids_a), flat(ids_b), np.cumsum([len(w) * ok for w, ok in zip(want, good, strict=True)], dtype=np.int64), good

    def learn(self, chunks: list[str], say: bool) -> None:
        """Remember ``chunks``, with their groups as text if ``say``."""
        plain = [c for c in chunks if c and not c[-1].isspace() and len(c) < TEXTS] if self.fast else []
        odd = [c for c in chunks if not c or c[-1].isspace() or len(c) >= TEXTS] if self.fast else chunks
        if plain:
            found = self.together(plain)
            if found is None:
                odd = odd + plain
            else:
                self.add(plain, *found, np.ones(len(plain), dtype=bool), say)
        if odd:
            self.add(odd, *self.one_by_one(odd), say)

    def add(self, chunks: list[str], flat_a: np.ndarray, flat_b: np.ndarray, ends: np.ndarray, good: np.ndarray, say: bool) -> None:
        end_a, end_b = np.cumsum(self.a_length[flat_a]), np.cumsum(self.b_length[flat_b])
        at = np.searchsorted(end_b, end_a)
        common = end_a[end_b[np.minimum(at, len(end_b) - 1)] == end_a] if len(end_b) else end_a[:0]
        # a token's group is the number of common ends before its own end
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        size_a, size_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        from_a, from_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        chunk = np.searchsorted(ends, common)
        links, count = self.links(flat_a, flat_b, from_a, from_b, size_a, size_b)
        in_chunk = np.repeat(chunk, count)
        n = lambda where, weights=None: np.bincount(where, weights=weights, minlength=len(chunks)).astype(np.int64)
        n_pairs = n(in_chunk)
        first = self.entries.size + np.cumsum(n_pairs) - n_pairs
        found, back = np.unique(links, return_inverse=True)
        before = len(self.pair_ids)
        ids = np.array([self.pair_ids.setdefault(p, len(self.pair_ids)) for p in found.tolist()], dtype=np.int32)
        self.pairs.add(found[ids >= before])
        self.entries.add(ids[back] if len(ids) else ids)
        for column, rows in ((self.good, good), (self.n_a, n(chunk[group_a])), (self.n_b, n(chunk[group_b])), (self.n_groups, n(chunk)), (self.n_links, n_pairs), (self.first, first)):
            column.add(rows)
        self.uses.add(np.zeros(len(chunks), dtype=np.int64))
        if say:
            place_a, place_b = np.arange(len(flat_a)) + from_b[group_a], np.arange(len(flat_b)) + (from_a + size_a)[group_b]
            tokens = np.empty(len(flat_a) + len(flat_b), dtype=object)
            last_a, last_b = (np.append(np.diff(g) != 0, True)[: len(g)] for g in (group_a, group_b))
            tokens[place_a] = np.where(last_a, self.names["|"][flat_a], self.names[","][flat_a])
            tokens[place_b] = np.where(last_b, self.names[";"][flat_b], self.b_names[flat_b])
            tokens, cut = tokens.tolist(), np.cumsum(n(chunk[group_a]) + n(chunk[group_b])).tolist()
            self.said += ["".join(tokens[x:y]) for x, y in zip([0, *cut[:-1]], cut, strict=True)]
        for c in chunks:
            self.known[c] = len(self.known)

    @staticmethod
    def links(flat_a: np.ndarray, flat_b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of each group, one after another, and their number by group."""
        count = size_a * size_b
        starts = np.cumsum(count) - count
        step = np.arange(count.sum()) - np.repeat(starts, count)
        wide = np.repeat(size_b, count)
        return flat_a[np.repeat(from_a, count) + step // wide] * SHIFT + flat_b[np.repeat(from_b, count) + step % wide], count

    def batch(self, texts: list[str], say: bool = False) -> Batch:
        rows = [self.chunks(t) if t else [] for t in texts]
        new = set().union(*rows)
        new.difference_update(self.known)
        new = list(new)
        at = 0
        while at < len(new):
            end, held = at, 0
            while end < len(new) and (end == at or held + len(new[end]) <= TEXTS):
                held += len(new[end])
                end += 1
            self.learn(new[at:end], say)
            at = end
        part = Batch(self, [list(map(self.known.__getitem__, r)) for r in rows])
        self.uses.rows[:] += np.bincount(part.chunk, minlength=len(self.known))
        return part

    def crowded(self, say: bool) -> bool:
        """Whether all must be forgotten, pairs too: there is too much of it, or it has no texts."""
        return self.pairs.size > 8 * CACHE_ENTRIES or self.entries.size > 24 * CACHE_ENTRIES or bool(self.known) and say != bool(self.said)

    def make_room(self, say: bool) -> bool:
        """Whether the chunks got other numbers, as there were too many of them."""
        if self.crowded(say):
            self.forget()
        elif len(self.known) > CACHE_ENTRIES:
            self.keep_frequent()
        else:
            return False
        return True


class Batch:
    """Texts as lists of the numbers of aligned chunks."""

    def __init__(self, aligner: Aligner, rows: list[list[int]]):
        self.aligner = aligner
        if not aligner.good.rows.all():
            bad = set(np.flatnonzero(~aligner.good.rows).tolist())
            rows = [[] if not bad.isdisjoint(r) else r for r in rows]
        self.rows = rows
        self.size = np.array([len(r) for r in rows], dtype=np.int64)
        self.chunk = np.fromiter(chain.from_iterable(rows), dtype=np.int64, count=int(self.size.sum()))
        self.doc = np.repeat(np.arange(len(rows)), self.size)

    def expand(self) -> tuple[np.ndarray, np.ndarray]:
        """Document and pair of every entry of the distinct chunks of each document."""
        n = max(len(self.aligner.known), 1)
        doc, chunk = np.divmod(distinct(self.doc * n + self.chunk), n)
        return self.entries_of(doc, chunk)

    def entries_of(self, doc: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.aligner.n_links.rows[chunk]
        starts = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(self.aligner.first.rows[chunk] - starts, n)
        return np.repeat(doc, n), self.aligner.entries.rows[at]

    def held(self) -> np.ndarray:
        """How many of the documents hold each of the aligner's pairs."""
        n = max(self.aligner.pairs.size, 1)
        doc, pair = self.expand()
        return np.bincount(distinct(doc * n + pair) % n, minlength=self.aligner.pairs.size)

    def per_doc(self, of_chunk: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of_chunk[self.chunk], dtype=np.int64)])
        ends = np.cumsum(self.size)
        return sums[ends] - sums[ends - self.size]


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


@lru_cache(maxsize=1)
def aligner_of(a_file: bytes, b_file: bytes) -> Aligner:
    """A worker process makes an aligner once; its millions of small objects make no cycles, so none are looked for."""
    gc.disable()
    return Aligner(a_file, b_file)


def some_texts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``TEXTS`` characters, or of one text."""
    at = held = 0
    for k, t in enumerate(texts):
        if k > at and held + len(t) > TEXTS:
            yield at, k
            at, held = k, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def partial_counts(docs: DataFrame, shared, text: str) -> DataFrame:
    """(pair, n): pairs with the number of a task's documents that hold them linked; a pair may come more than once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(*shared.value)
        aligner.make_room(say=False)
        counts = np.zeros(aligner.pairs.size, dtype=np.int64)

        def found() -> pa.RecordBatch:
            own = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(aligner.pairs.rows[own]), pa.array(counts[own])], names=["pair", "n"])

        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for at, end in some_texts(texts):
                if aligner.crowded(say=False):
                    yield found()
                    counts = np.zeros(0, dtype=np.int64)
                aligner.make_room(say=False)
                held = aligner.batch(texts[at:end]).held()
                held[: len(counts)] += counts
                counts = held
        yield found()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "pair long, n long")


def _bytes_of(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


def _array_of(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype="<i8")


def pair_counts(partials: DataFrame) -> DataFrame:
    """(bucket, keys, counts): the distinct pairs of ``partials`` in the order of their perfect hash, and their dense counts."""
    rows = partials.count()
    n_buckets = max(1, -(-rows // BUCKET))
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), "pair"), F.lit(n_buckets)).cast("int")

    def keys_of(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": df["bucket"].iloc[:1], "keys": [_bytes_of(PerfectHash(df["pair"].to_numpy()).keys)]})

    hashes = materialize(partials.select("pair").distinct().withColumn("bucket", bucket).groupBy("bucket").applyInPandas(keys_of, "bucket int, keys binary"))

    def leaf(mine: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        # the hash of the same keys is built alike everywhere, so keys are all that is kept of it
        made = PerfectHash(_array_of(keys["keys"].iloc[0]))
        vector, at = np.zeros(len(made.keys), dtype=np.int64), made.index(mine["pair"].to_numpy())
        np.add.at(vector, at, mine["n"].to_numpy())
        return pd.DataFrame({"bucket": mine["bucket"].iloc[:1], "node": mine["node"].iloc[:1], "vector": [_bytes_of(vector)]})

    def added(df: pd.DataFrame) -> pd.DataFrame:
        total = _array_of(df["vector"].iloc[0]).copy()
        for v in df["vector"].iloc[1:]:
            total += _array_of(v)
        return pd.DataFrame({"bucket": df["bucket"].iloc[:1], "node": df["node"].iloc[:1], "vector": [_bytes_of(total)]})

    node = F.pmod(F.xxhash64(F.lit("leaf"), F.spark_partition_id(), "n"), F.lit(LEAVES)).cast("int")
    mine = partials.withColumns({"bucket": bucket, "node": node}).groupBy("bucket", "node")
    copies = hashes.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(LEAVES - 1)))).groupBy("bucket", "node")
    vectors = mine.cogroup(copies).applyInPandas(lambda a, b: leaf(a, b) if len(a) else pd.DataFrame({"bucket": [], "node": [], "vector": []}), "bucket int, node int, vector binary")
    width = LEAVES
    while width > 1:
        width = -(-width // FAN_IN)
        vectors = vectors.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int")).groupBy("bucket", "node").applyInPandas(added, "bucket int, node int, vector binary")
    return materialize(hashes.join(vectors.select("bucket", F.col("vector").alias("counts")), "bucket"))


def highest_counts(counts: DataFrame, vocabulary: int) -> np.ndarray:
    """The highest count of every A id: one number for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.maximum.at(best, _array_of(keys) // SHIFT, _array_of(n))
        a = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(best[a])], names=["a", "best"])

    found = counts.select("keys", "counts").mapInArrow(run, "a long, best long").groupBy("a").agg(F.max("best").alias("best")).toPandas()
    best = np.zeros(vocabulary, dtype=np.int64)
    best[found["a"].to_numpy(dtype=np.int64)] = found["best"].to_numpy(dtype=np.int64)
    return best


def frequent_pairs(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Pairs and counts above a power of two that at most ``most`` pairs reach, and the others as (pair, count)."""

    def level(n: np.ndarray) -> np.ndarray:
        return np.floor(np.log2(n)).astype(np.int64)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(64, dtype=np.int64)
        for batch in batches:
            for n in batch.column(0).to_pylist():
                found += np.bincount(level(_array_of(n)), minlength=64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(found)], names=["level", "pairs"])

    sizes = {r["level"]: r["n"] for r in counts.select("counts").mapInArrow(levels, "level long, pairs long").groupBy("level").agg(F.sum("pairs").alias("n")).collect()}
    least, total = 64, 0
    while least and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)

    def split(often: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    keys, n = _array_of(keys), _array_of(n)
                    own = (level(n) >= least) == often
                    if own.any():
                        yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(n[own])], names=["pair", "count"])

        return counts.select("keys", "counts").mapInArrow(run, "pair long, count long")

    table = split(True).toArrow()
    return table.column("pair").to_numpy(), table.column("count").to_numpy(), split(False)


def align_documents(docs: DataFrame, a_file: str, b_file: str, text: str = "text", doc_id: str = "doc_id", most_pairs: int = 1 << 21) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The two files are vocabularies of a fixed size, read here once and broadcast.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    with open(a_file, "rb") as f, open(b_file, "rb") as g:
        files = f.read(), g.read()
    shared = spark.sparkContext.broadcast(files)
    with scratch_scope(spark):
        counts = pair_counts(materialize(partial_counts(docs, shared, text)))
        best = highest_counts(counts, SHIFT if (size := len(Aligner(*files).a_bytes)) > SHIFT else size)
        often, n_often, seldom = frequent_pairs(counts, most_pairs)
        made = PerfectHash(often)
        values = np.zeros(len(often), dtype=np.int64)
        values[made.index(often)] = n_often
        lookup = spark.sparkContext.broadcast((made, values, best))
        seldom = materialize(seldom, keep=True)
        thin = materialize(second_pass(docs, shared, lookup, text, doc_id), keep=True)
    rare = thin.filter("size(pairs) > 0").select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    of_a = spark.createDataFrame([(int(a), int(best[a])) for a in np.flatnonzero(best)], "a long, best long")
    met = rare.join(seldom, "pair").withColumn("a", F.floor(F.col("pair") / SHIFT)).join(F.broadcast(of_a), "a")
    late = met.groupBy("row").agg(F.sum(F.when(F.col("count") == F.col("best"), F.col("times")).otherwise(0)).alias("late_best"), F.sum(F.col("times") * F.col("count")).alias("late_sum"))
    out = thin.drop("pairs", "times").join(late, "row", "left")
    more = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "late_best"), more("count_sum", "late_sum"), "groups_sha256")


def second_pass(docs: DataFrame, shared, lookup, text: str, doc_id: str) -> DataFrame:
    """(row, doc_id, numbers, hash, pairs, times): the documents' numbers over the pairs that ``lookup`` has, and their other pairs."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(*shared.value)
        made, values, best = lookup.value
        count, sums, tops, late = np.zeros(0, np.int64), *(Growing(k) for k in (np.int64, np.int64, bool))

        def look_up() -> None:
            """Counts of pairs, and sums of chunks, that came with the last texts."""
            nonlocal count
            fresh = aligner.pairs.rows[len(count) :]
            index = made.index(fresh)
            count = np.concatenate([count, np.where(index >= 0, values[np.maximum(index, 0)] if len(values) else 0, 0)])
            start = aligner.first.rows[sums.size] if sums.size < aligner.first.size else aligner.entries.size
            pair = aligner.entries.rows[start:]
            ends = np.cumsum(aligner.n_links.rows[sums.size :])
            per_chunk = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[np.concatenate([[0], ends])])
            n = count[pair]
            late.add(per_chunk(n == 0) > 0)
            tops.add(per_chunk((n > 0) & (n == best[aligner.pairs.rows[pair] // SHIFT])))
            sums.add(per_chunk(n))

        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for at, end in some_texts(texts):
                if aligner.make_room(say=True):
                    count, sums, tops, late = np.zeros(0, np.int64), *(Growing(k) for k in (np.int64, np.int64, bool))
                part = aligner.batch(texts[at:end], say=True)
                look_up()
                numbers = [part.per_doc(x.rows) for x in (aligner.n_a, aligner.n_b, aligner.n_groups, aligner.n_links, tops, sums)]
                said = aligner.said
                hashes = [hashlib.sha256("".join(map(said.__getitem__, r))[:-1].encode()).hexdigest() if r else "" for r in part.rows]
                pairs: list[np.ndarray] = [np.zeros(0, np.int64)] * len(part.rows)
                times = list(pairs)
                own = late.rows[part.chunk]
                if own.any():
                    doc, pair = part.entries_of(part.doc[own], part.chunk[own])
                    key, n = np.unique((doc * len(count) + pair)[count[pair] == 0], return_counts=True)
                    cuts = np.searchsorted(key // len(count), np.arange(len(part.rows) + 1))
                    key = aligner.pairs.rows[key % len(count)]
                    pairs, times = ([x[y:z] for y, z in zip(cuts[:-1], cuts[1:], strict=True)] for x in (key, n))
                lists = [pa.array(x, type=pa.list_(pa.int64())) for x in (pairs, times)]
                columns = [batch.column(0)[at:end], batch.column(1)[at:end], *map(pa.array, numbers), pa.array(hashes, type=pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "pairs", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, pairs array<long>, times array<long>")
