"""Token-id files: documents as ids of a tokenizer, range-coded in checksummed blocks.

A file holds ``docs_per_file`` documents, more or less, in ascending id order; files
follow each other in that order too. It is a sequence of blocks of at most ``BLOCK`` ids, of
whole documents or of one piece of a longer document, each coded from an empty model and checked by the CRC-32 of its ids, with an
index of what it holds. The container is Parquet,
one row per block, so any store that Spark writes to will do, and a lost task is written
again as a whole.

Defined results: a null text counts as empty and holds the end id only; null ids come last,
equal ids in the order of their ids' bytes; repeated rows are stored each; extra columns
are not read. An empty table gives no file rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusengine.llm.alignment import byte_of_character
from corpusengine.llm.range_coder import BLOCK, decode_blocks, encode_blocks
from corpusengine.session import materialize, small_batches

#: Blocks coded in step; entries and length of the cache of encoded chunks; characters of plain texts encoded together, and one text more; bounds a worker's memory.
LANES, CACHE_ENTRIES, CACHE_CHARS, TOGETHER = 384, 200_000, 48, 1 << 20
#: Words of plain texts that are remembered: bits of their number, most bytes and most ids.
WORD_BITS, WORD_BYTES, WORD_IDS = 18, 16, 8
#: Bytes of the words' two keys, by length.
KEY_BYTES = np.array([[(1 << 8 * min(max(n - k, 0), 8)) - 1 for k in (0, 8)] for n in range(WORD_BYTES + 1)], np.uint64)
#: What word_bpe_49k.json does to a text before its merges, and the mark of a word's last character.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
END = "</w>"
#: Texts that composing leaves as they are: one byte a character in Latin-1. What starts a word there, and so differs from what stands before: 0 blanks, 1 letters, 2 digits, 3 signs.
PLAIN = re.compile("[\\t-\\r -~À-ÖØ-öø-ÿ]*")
LETTERS, DIGITS = [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)], [*range(0x30, 0x3A)]
SIGNS = [k for k in range(0x21, 0x7F) if not chr(k).isalnum()]
KINDS = np.zeros(256, np.uint8)
KINDS[LETTERS], KINDS[DIGITS], KINDS[SIGNS] = 1, 2, 3
#: The character that stands for one at a word's end: capitals, control characters and two signs, none of which a plain text has in lower case.
LAST = {chr(k): chr(k).upper() for k in LETTERS} | {"ß": "×", "ÿ": "÷"} | {chr(k): chr(k) for k in DIGITS} | {chr(k): chr(i) for i, k in enumerate(SIGNS)}
AT_END = np.arange(256, dtype=np.uint8)
AT_END[[ord(c) for c in LAST]] = [ord(c) for c in LAST.values()]
#: The same by bytes of UTF-8; those before a word's end, and those at it.
LAST_BYTE = {c.encode()[-1]: to.encode()[-1] for c, to in LAST.items()}
INNER = {b for k in (*LETTERS, *SIGNS) for b in chr(k).encode()}
MARKED = f"[^{(ends := re.escape(''.join(LAST.values())))} ]*[{ends}]"
#: Files whose offsets one task sums up.
GROUP = 4096
FILES = "file_no int, block_no int, n_ids int, crc32 long, whole boolean, payload binary, seq array<long>, doc_id array<long>, start array<long>, n_tokens array<long>, piece array<int>, size array<int>"


def splits_at_blanks(spec: dict) -> bool:
    """Whether the tokenizer is known to drop blanks and never to look across them: its normalizer and pattern are those of word_bpe_49k.json."""
    return spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == PRE_TOKENIZER and not spec.get("post_processor") and not any(x["normalized"] or x["lstrip"] or x["rstrip"] or re.search(r"\s", x["content"]) for x in spec["added_tokens"])


def plain_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids of the tokens that plain words have, as ranks by their bytes with the last as in ``LAST_BYTE``, if merging by such ranks gives what the merges give; else None.

    It does if the merges come in the order of their ids, and each token, merged by the
    tokens before it, ends as the pair that its own merge joins.
    """
    model = spec["model"]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return None
    of = byte_of_character()

    def raw(token: str) -> bytes | None:
        body = [of.get(c) for c in token.removesuffix(END)]
        if not body or not all(b in INNER for b in body[:-1]) or body[-1] not in (LAST_BYTE if token.endswith(END) else INNER):
            return None
        return bytes([*body[:-1], LAST_BYTE[body[-1]] if token.endswith(END) else body[-1]])

    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in merges]
    if None in ids or any(a >= b for a, b in pairwise(ids)):
        return None
    made = set(ids)
    ranks = {x: k for t, k in model["vocab"].items() if k not in made and (x := raw(t))}
    if any(bytes([b]) not in ranks for b in INNER | set(LAST_BYTE.values())) or max(ranks.values()) > min(ids):
        return None
    for (left, right), k in zip(merges, ids, strict=True):
        if not (token := raw(left + right)):
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[best] + parts[best + 1] not in ranks:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if parts != [raw(left), raw(right)]:
            return None
        ranks[token] = k
    return ranks


def word_ends(text: np.ndarray) -> np.ndarray:
    """Where the words of ``PATTERN`` end in a plain text in lower case, as bytes of Latin-1 with a blank at both ends."""
    kinds = KINDS[text]
    ends = (kinds > 0) & (kinds == 2)
    ends[:-1] |= (kinds[:-1] != kinds[1:]) & (kinds[:-1] > 0)
    # 's, 't, 'm, 'd, 're, 've and 'll are words, where the apostrophe starts one
    at = np.flatnonzero(text == ord("'"))
    at = at[kinds[at - 1] != 3]
    one, two = text[at + 1], text[np.minimum(at + 2, len(text) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    ends[at[short | long]] = False
    ends[at[short] + 1] = True
    ends[at[long] + 1] = False
    ends[at[long] + 2] = True
    return ends


class WordEncoder:
    """Ids of texts by a tokenizer.

    One that drops blanks and never looks across them gives a text the ids of its chunks
    between blanks one after another, so chunks are encoded once and looked up afterwards;
    any other gets whole texts. Plain texts are cut into words by the tokenizer's pattern
    and merged by ranks, many in one call, where they aren't found among the words met before,
    of which a table of fixed size keeps the last of each hash, compared in full; other texts
    are left to the tokenizers library.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.merge = Tokenizer.from_str(content), {}, None
        spec = json.loads(content)
        self.by_chunks = splits_at_blanks(spec)
        if self.by_chunks and (ranks := plain_ranks(spec)):
            import tiktoken

            self.merge = tiktoken.Encoding("words", pat_str=MARKED, mergeable_ranks=ranks, special_tokens={})
            self.added = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or r"(?!)")
            self.ends_word = np.zeros(max(ranks.values()) + 1, bool)
            self.words, self.word_sizes = np.zeros((2, 1 << WORD_BITS), np.uint64), np.zeros(1 << WORD_BITS, np.uint8)
            self.word_ids = np.zeros((1 << WORD_BITS, WORD_IDS), np.uint16)
            self.ends_word[[k for t, k in spec["model"]["vocab"].items() if t.endswith(END) and k < len(self.ends_word)]] = True

    def is_plain(self, text: str) -> bool:
        return self.merge is not None and PLAIN.fullmatch(text) is not None and not self.added.search(text)

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        at = np.cumsum([len(t) + 1 for t in texts]) // TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
        return [x for a, b in pairwise(cuts) for x in self.encode_together(texts[a:b])]

    def encode_together(self, texts: list[str]) -> list[bytes]:
        text = np.frombuffer(f" {' '.join(texts)} {chr(0) * WORD_BYTES}".lower().encode("latin-1"), np.uint8)
        ends, inside = word_ends(text), KINDS[text] > 0
        starts, stops = np.flatnonzero(inside[1:] & (ends[:-1] | ~inside[:-1])) + 1, np.flatnonzero(ends) + 1
        short, keys, slots = self.keys_of(text, starts, stops - starts)
        met = short & (self.words[0].take(slots) == keys[0]) & (self.words[1].take(slots) == keys[1])
        sizes, new = np.where(met, self.word_sizes.take(slots), 0).astype(np.int64), np.flatnonzero(~met)
        fresh, sizes[new] = self.merged(text, starts[new], stops[new])
        at = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.word_ids.reshape(-1).take(np.repeat(slots * WORD_IDS - at[:-1], sizes) + np.arange(at[-1]), mode="clip")
        ids[np.repeat(~met, sizes)] = fresh
        self.remember(short[new], keys[:, new], slots[new], sizes[new], fresh)
        # a text's ids end with its last word
        raw, cuts = ids.astype("<u2").tobytes(), 2 * at[np.searchsorted(stops, np.cumsum([len(t) + 1 for t in texts]), "right")]
        return [raw[a:b] for a, b in pairwise([0, *cuts.tolist()])]

    def keys_of(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words have at most ``WORD_BYTES`` bytes; these bytes as two keys a word, and its place in the table."""
        keys = np.lib.stride_tricks.sliding_window_view(text, WORD_BYTES)[starts].view("<u8")
        keys = (keys & KEY_BYTES[np.minimum(sizes, WORD_BYTES)]).T
        mixed = keys[0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x165667B19E3779F9) >> np.uint64(64 - WORD_BITS)
        return sizes <= WORD_BYTES, keys, mixed.astype(np.int64)

    def merged(self, text: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by ranks, and how many each has."""
        at = np.concatenate(([0], np.cumsum(stops - starts)))
        marked, last = text[np.repeat(starts - at[:-1], stops - starts) + np.arange(at[-1])], at[1:] - 1
        marked[last] = AT_END[marked[last]]
        ids = self.merge.encode_to_numpy(marked.tobytes().decode("latin-1"), disallowed_special=())
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(starts):
            raise ValueError("words and ids don't match")
        return ids, np.diff(ends, prepend=0)

    def remember(self, short: np.ndarray, keys: np.ndarray, slots: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Put words with their ids into the table, one a slot."""
        kept = np.flatnonzero(short & (sizes <= WORD_IDS))
        slots, one = np.unique(slots[kept], return_index=True)
        kept = kept[one]
        self.words[:, slots], self.word_sizes[slots] = keys[:, kept], sizes[kept]
        places = (np.cumsum(sizes) - sizes)[kept, None] + np.arange(WORD_IDS)
        self.word_ids[slots] = ids.take(places, mode="clip") if len(kept) else 0

    def encode_chunks(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        split = [t.replace("\n", " ").split(" ") if self.by_chunks else [t] for t in texts]
        todo = list({c for s in split for c in s if c not in self.cache})
        for k in range(0, len(todo), 4096):
            part = todo[k : k + 4096]
            self.cache.update((c, np.array(e.ids, dtype="<u2").tobytes()) for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True))
        out = [b"".join(map(self.cache.__getitem__, s)) for s in split]
        for c in todo:
            if len(c) > CACHE_CHARS:
                del self.cache[c]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.is_plain(t) for t in texts]
        ways = {True: self.encode_plain, False: self.encode_chunks}
        done = {way: iter(ways[way]([t for t, p in zip(texts, plain, strict=True) if p == way])) for way in set(plain)}
        return [next(done[p]) for p in plain]


@lru_cache(maxsize=2)
def encoder_of(content: str) -> WordEncoder:
    """A worker process makes an encoder once and keeps its cache between tasks."""
    return WordEncoder(content)


def token_ids(docs: DataFrame, tokenizer_file: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids): little-endian unsigned 16-bit integers, the end id last."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        content = f.read()
    shared, end = spark.sparkContext.broadcast(content), np.array([end_id], dtype="<u2").tobytes()

    @pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(shared.value)
        for texts in batches:
            rows = [t or "" for t in texts]
            yield pd.Series([x + end for k in range(0, len(rows), 256) for x in encoder.encode(rows[k : k + 256])], dtype=object)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), encode(F.col(text)).alias("ids"))


class FileWriter:
    """Cuts one file's documents into blocks and codes many of them at once."""

    def __init__(self, file_no: int):
        self.file_no, self.n_blocks, self.n_docs, self.n_ids = file_no, 0, 0, 0
        self.ids, self.index, self.room = [], [], BLOCK
        self.blocks: list[tuple[np.ndarray, list, bool]] = []

    def _close(self, whole: bool = True) -> None:
        if self.ids:
            self.blocks.append((np.concatenate(self.ids), self.index, whole))
            self.ids, self.index, self.room = [], [], BLOCK

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at, piece = 0, 0
        if len(ids) > self.room:
            self._close()
        alone = len(ids) > BLOCK
        while at < len(ids):
            part = ids[at : at + self.room]
            self.ids.append(part)
            self.index.append((self.n_docs, doc_id, self.n_ids, len(ids), piece, len(part)))
            at, piece, self.room = at + len(part), piece + 1, self.room - len(part)
            if not self.room or alone:
                self._close(whole=not alone)
        self.n_docs, self.n_ids = self.n_docs + 1, self.n_ids + len(ids)

    def rows(self, last: bool = False) -> Iterator[pd.DataFrame]:
        if last:
            self._close()
        while len(self.blocks) >= LANES or last and self.blocks:
            now, self.blocks = self.blocks[:LANES], self.blocks[LANES:]
            coded = encode_blocks([ids for ids, _, _ in now])
            columns = [list(zip(*index, strict=True)) for _, index, _ in now]
            frame = {
                "file_no": self.file_no,
                "block_no": range(self.n_blocks, self.n_blocks + len(now)),
                "n_ids": [len(ids) for ids, _, _ in now],
                "crc32": [zlib.crc32(ids.astype("<u4").tobytes()) for ids, _, _ in now],
                "whole": [whole for _, _, whole in now],
                "payload": coded,
            }
            for k, name in enumerate(("seq", "doc_id", "start", "n_tokens", "piece", "size")):
                frame[name] = [list(c[k]) for c in columns]
            self.n_blocks += len(now)
            yield pd.DataFrame(frame)


def write_files(tokens: DataFrame, ids: DataFrame, docs_per_file: int = 8192) -> DataFrame:
    """Write ``tokens`` (doc_id, ids) as files and return them as read back from the shared folder.

    One shuffle deals the documents out by ranges of their ids, as Spark samples them, and
    sorts each range; a range is a file, numbered in the order of the ids. Rows of one id
    stay together; many of one id make a long file, not a wrong one. ``ids`` (doc_id) tells
    how many files there are; tokens are written first, as the sample reads them too.
    """
    tokens = materialize(tokens.withColumn("none", F.col("doc_id").isNull()))
    n_files = max(1, -(-ids.count() // docs_per_file))
    placed = tokens.repartitionByRange(n_files, "none", "doc_id").sortWithinPartitions("none", "doc_id", "ids").withColumn("file_no", F.spark_partition_id())

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = None
        for df in batches:
            for number, none, doc_id, raw in zip(df["file_no"], df["none"], df["doc_id"], df["ids"], strict=True):
                if writer is None or writer.file_no != number:
                    if writer is not None:
                        yield from writer.rows(last=True)
                    writer = FileWriter(number)
                writer.add(None if none else int(doc_id), np.frombuffer(raw, "<u2"))
            if writer is not None:
                yield from writer.rows()
        if writer is not None:
            yield from writer.rows(last=True)

    whole_ids = F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id")  # null would make pandas use floats
    return materialize(placed.select("file_no", "none", whole_ids, "ids").mapInPandas(write, FILES))


def read_files(files: DataFrame) -> DataFrame:
    """(file_no, seq, doc_id, start, n_tokens, piece, ids) of every document's pieces, blocks decoded and checked.

    ``start`` counts from the file's first id; ``ids`` are little-endian unsigned 32-bit integers.
    """
    schema = "file_no int, seq long, doc_id long, start long, n_tokens long, piece int, ids binary"

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for df in batches:
            held.append(df)
            while sum(map(len, held)) >= LANES:
                df = pd.concat(held)
                yield df.iloc[:LANES]
                held = [df.iloc[LANES:]]
        if sum(map(len, held)):
            yield pd.concat(held)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in together(batches):
            out = []
            for ids, row in zip(decode_blocks(list(part["payload"]), list(part["n_ids"])), part.itertuples(), strict=True):
                raw = ids.astype("<u4").tobytes()
                if zlib.crc32(raw) != row.crc32:
                    raise ValueError(f"block {row.block_no} of file {row.file_no} is damaged")
                ends = np.cumsum(row.size)
                out += [(row.file_no, row.seq[i], row.doc_id[i], row.start[i], row.n_tokens[i], row.piece[i], raw[4 * (e - row.size[i]) : 4 * e]) for i, e in enumerate(ends)]
            names = ["file_no", "seq", "doc_id", "start", "n_tokens", "piece", "ids"]
            columns = dict(zip(names, zip(*out, strict=True), strict=True)) if out else {n: [] for n in names}
            yield pd.DataFrame(columns | {"doc_id": pd.array(columns["doc_id"], dtype="Int64")})

    return files.mapInPandas(read, schema)


def documents_of(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: ``start`` counts all ids of the documents before it.

    Every block is decoded once. Whole documents pass straight through; only pieces meet.
    A file's offset is summed up in two levels, groups of files and files of a group, so no
    task holds all files.
    """
    from pyspark.sql import Window

    totals = materialize(files.groupBy("file_no").agg(F.sum("n_ids").alias("n")).withColumn("part", F.floor(F.col("file_no") / GROUP)))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("file_no")) - F.col("n")
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part")) - F.col("n"))
    offsets = totals.withColumn("within", within).join(before.select("part", "before"), "part").select("file_no", (F.col("within") + F.col("before")).alias("offset"))
    columns = ["file_no", "doc_id", "start", "n_tokens", "ids"]
    whole = read_files(files.filter("whole")).select(*columns)
    pieces = read_files(files.filter("not whole"))
    join = F.expr("aggregate(sort_array(collect_list(struct(piece, ids))), X'', (a, x) -> concat(a, x.ids))")
    split = pieces.groupBy("file_no", "seq", "doc_id", "start", "n_tokens").agg(join.alias("ids")).drop("seq")
    both = whole.unionByName(split.select(*columns))
    return both.join(materialize(offsets), "file_no").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids")
