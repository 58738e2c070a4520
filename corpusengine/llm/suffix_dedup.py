"""Suffix-array dedup: remove bytes of 50-byte strings that also start in an earlier document.

Sorting every suffix would move each byte fifty times. A string of ``LENGTH`` bytes always
holds one of its text's sampled places: in each window of ``WINDOW`` consecutive ``K``-byte
grams the one of the smallest hash, a choice that depends on the string alone. So only the
suffixes at sampled places are sorted, with the ``REACH`` bytes before them at hand, and of
those only the ones whose gram may stand in two documents (a first pass writes the repeated
grams into a bitmap of at most ``MAX_BITS`` bits; false positives cost work, not results).

A repeated gram mostly stands in one context (``REACH`` bytes before it, ``LENGTH`` from
it), as in copies of a text; then equality of the context's 64-bit hash settles every string
around it, and no suffix moves. The other grams' suffixes, where matches begin and end, are
sorted. Each task sorts its suffixes into runs, cut into parts and front-coded: the length
of the prefix shared with the suffix before, and the rest. A part's runs are merged by a
loser tree whose nodes know the prefix shared with the last winner, so known prefixes are
never compared again, and the merged order comes with its shared prefixes. From these
follows, for every sampled place and every start before it, whether the string occurs in a
document with a smaller id. Equal contexts of one batch are exchanged once, for the smallest
id; a passage of any number of copies meets as often as there are batches.

Defined results: a null text counts as empty; documents with null ids neither remove nor
lose anything; documents with one id don't remove each other's bytes; repeated rows give a
row each; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusengine.session import materialize, small_batches

LENGTH, K = 50, 24
WINDOW = LENGTH - K + 1
REACH = LENGTH - K
KEY = 8 + LENGTH
MAX_BITS = 1 << 28
#: Texts longer than this are searched in overlapping parts.
PART = 1 << 22
FLUSH = 1 << 19
#: Documents to a part of the merge, roughly.
DOCS_PER_PART = 1024
#: The place that marks a document in which a context stands several times.
MORE = -1
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_HASH = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x94D049BB133111EB) >> np.uint64(29))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, x in (("up", BASE), ("down", INVERSE)):
            row = np.full(size, x, np.uint64)
            row[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def sampled(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that are sampled in ``text`` (bytes), and the hashes of the grams there."""
    if len(text) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, hashes = [], []
    for low in range(0, len(text) - LENGTH + 1, PART):
        part = text[low : low + PART + LENGTH - 1]
        up, down = powers(len(part))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(BYTE_HASH[part] * up, out=sums[1:])
            h = (sums[K:] - sums[:-K]) * down[: len(part) - K + 1]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        v = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        wide = 1
        while 2 * wide <= WINDOW:
            v = np.minimum(v[:-wide], v[wide:])
            wide *= 2
        if WINDOW > wide:
            v = np.minimum(v[: len(v) - (WINDOW - wide)], v[WINDOW - wide :])
        at = (v & np.uint64(0xFFFFFF)).astype(np.int64)
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        places.append(at + low)
        hashes.append(h[at])
    at, h = np.concatenate(places), np.concatenate(hashes)
    if len(places) > 1:
        at, first = np.unique(at, return_index=True)
        h = h[first]
    # sampled hashes are the least of their windows; mixed once more they are spread evenly again
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return at, h ^ (h >> np.uint64(32))


def repeated_grams(docs: DataFrame, n_bits: int, n_buckets: int) -> np.ndarray:
    """Bitmap of the sampled grams that stand in two documents: a bit per hash, ``n_bits`` / 8 bytes."""
    shift = np.uint64(64 - (n_buckets.bit_length() - 1))
    per = n_bits // n_buckets

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pd.DataFrame:
            h, d = np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept])
            kept.clear()
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            first = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
            starts = np.flatnonzero(first)
            ends = np.concatenate((starts[1:], [len(h)])) - 1
            twice = d[starts] != d[ends]
            h = h[starts]
            cuts = np.searchsorted(h >> shift, np.arange(n_buckets + 1, dtype=np.uint64))
            rows = [(b, h[i:j].tobytes(), twice[i:j].tobytes()) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
            return pd.DataFrame(rows, columns=["bucket", "hashes", "twice"])

        n = 0
        for df in batches:
            for doc, text in zip(df["doc_id"], df["text"], strict=True):
                _, h = sampled(np.frombuffer(text.encode(), np.uint8))
                if len(h):
                    kept.append((h, np.full(len(h), doc, np.int64)))
                    n += len(h)
            if n >= 2 * FLUSH:
                yield flush()
                n = 0
        if n:
            yield flush()

    def merge(df: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in df["hashes"]])
        twice = np.concatenate([np.frombuffer(x, bool) for x in df["twice"]])
        order = np.argsort(h, kind="stable")
        h, twice = h[order], twice[order]
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        bits = np.zeros(per // 8, np.uint8)
        p = (h[again | twice] & np.uint64(per - 1)).astype(np.int64)
        np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
        return pd.DataFrame({"bucket": [int(df["bucket"].iloc[0])], "bits": [bits.tobytes()]})

    found = docs.mapInPandas(collect, "bucket int, hashes binary, twice binary")
    return gather_bits(found.groupBy("bucket").applyInPandas(merge, "bucket int, bits binary"), "bucket", n_bits, per)


def front_code(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Shared prefix with the key before, and what follows it, of sorted keys (a row of bytes each)."""
    shared = np.zeros(len(keys), np.uint8)
    differ = keys[1:] != keys[:-1]
    shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])
    rest = np.arange(keys.shape[1])[None, :] >= shared[:, None]
    return shared.tobytes(), keys[rest].tobytes()


def front_decode(shared: bytes, rest: bytes) -> list[bytes]:
    out, at, before = [], 0, b""
    for n in shared:
        step = KEY - n
        before = before[:n] + rest[at : at + step]
        at += step
        out.append(before)
    return out


def merge_runs(runs: list[list[bytes]], shared: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
    """Sorted order of all runs' keys as (run, place), and each key's shared prefix with the one before.

    ``shared`` are the runs' own shared prefixes. A node of the loser tree holds the run that
    lost there and the prefix its key shares with the winner that it lost to.
    """
    k = 1
    while k < max(len(runs), 1):
        k *= 2
    place = [0] * k
    head: list[bytes | None] = [(runs[r][0] if r < len(runs) and runs[r] else None) for r in range(k)]

    def play(r: int, hr: int, t: int, ht: int) -> tuple[int, int, int, int]:
        """Winner and loser of two runs' heads, with the prefixes shared with the last winner."""
        a, b = head[r], head[t]
        if b is None:
            return r, hr, t, ht
        if a is None:
            return t, ht, r, hr
        if hr > ht:
            return r, hr, t, ht
        if ht > hr:
            return t, ht, r, hr
        x, y = a[hr:], b[hr:]
        if x == y:
            return (r, hr, t, KEY) if r < t else (t, hr, r, KEY)
        n = len(x)
        common = hr + n - 1 - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() - 1) // 8
        return (r, hr, t, common) if x < y else (t, hr, r, common)

    loser, common = [0] * k, [0] * k
    level = [(r, 0) for r in range(k)]
    at = k
    while len(level) > 1:
        at //= 2
        nxt = []
        for i in range(0, len(level), 2):
            w, hw, lo, hl = play(*level[i], *level[i + 1])
            loser[at + i // 2], common[at + i // 2] = lo, hl
            nxt.append((w, hw))
        level = nxt
    (w, hw) = level[0]
    order, prefix = [], []
    while head[w] is not None:
        order.append((w, place[w]))
        prefix.append(hw)
        place[w] += 1
        i = place[w]
        if i < len(runs[w]):
            head[w], hw = runs[w][i], shared[w][i]
        else:
            head[w], hw = None, 0
        node = (k + w) // 2
        while node:
            w, hw, loser[node], common[node] = play(w, hw, loser[node], common[node])
            node //= 2
    return order, prefix


def occurs_before(prefix: np.ndarray, left: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each place, in sorted order, bit a: the string starting a bytes before it stands in a smaller document."""
    masks = np.zeros(len(doc), np.uint32)
    group = np.cumsum(prefix < 8 + K)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, len(doc)))
    several = np.repeat(np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts), sizes)
    if not several.any():
        return masks
    hashed = np.zeros(len(doc), np.uint64)
    up, _ = powers(REACH + 1)
    for a in range(REACH + 1):
        with np.errstate(over="ignore"):
            if a:
                hashed = hashed + BYTE_HASH[left[:, a - 1]] * up[a]
            key = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + np.cumsum(prefix < 8 + LENGTH - a).astype(np.uint64) * BASE
        fit = np.flatnonzero(several & (n_left >= a) & (n_right >= LENGTH - a))
        if not len(fit):
            continue
        order = fit[np.argsort(key[fit], kind="stable")]
        k = key[order]
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        least = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.append(starts, len(k))))
        masks[order] |= (least < doc[order]).astype(np.uint32) << np.uint32(a)
    return masks


RUN = "part int, shared binary, rest binary, near binary, docs binary, who binary, places binary"
MET = "part int, known boolean, grams binary, contexts binary, docs binary, who binary, places binary, masks binary"
FOUND = "part int, bits binary, bucket int, docs binary, who binary, places binary, masks binary"
COVER = "doc_id long, text_key long, places binary, masks binary"
NEAR = np.dtype([("left", np.uint8, (REACH,)), ("n_left", np.uint8), ("n_right", np.uint8)])
WHO = np.dtype([("doc", "<i8"), ("key", "<i8")])


class Bitmap:
    """Probes a broadcast bitmap of grams."""

    def __init__(self, bits, n_bits: int, n_buckets: int):
        self.bits, self.shift, self.per = bits, np.uint64(64 - (n_buckets.bit_length() - 1)), np.uint64(n_bits // n_buckets)

    def has(self, h: np.ndarray) -> np.ndarray:
        p = (h >> self.shift).astype(np.int64) * int(self.per) + (h & (self.per - np.uint64(1))).astype(np.int64)
        return self.bits.value[p >> 3] >> (p & 7).astype(np.uint8) & 1 == 1


def places_of(df: pd.DataFrame, grams: Bitmap) -> Iterator[tuple]:
    """(who, places, gram hashes, keys, near) of each text's sampled places whose gram is in the bitmap."""
    for doc, key, text in zip(df["doc_id"], df["text_key"], df["text"], strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)
        at, h = sampled(raw)
        hit = grams.has(h)
        at, h = at[hit], h[hit]
        if not len(at):
            continue
        padded = np.concatenate((np.zeros(REACH, np.uint8), raw, np.zeros(LENGTH, np.uint8)))
        keys = np.empty((len(at), KEY), np.uint8)
        keys[:, :8] = h.astype(">u8").view(np.uint8).reshape(-1, 8)
        keys[:, 8:] = padded[at[:, None] + REACH + np.arange(LENGTH)]
        near = np.zeros(len(at), NEAR)
        near["left"] = padded[at[:, None] + REACH - 1 - np.arange(REACH)]
        near["n_left"], near["n_right"] = np.minimum(at, REACH), np.minimum(len(raw) - at, LENGTH)
        yield np.full(len(at), np.array((doc, key), WHO)), at.astype("<i4"), h, keys, near


def every_start(near: np.ndarray) -> np.ndarray:
    """Mask of all starts a that leave a string inside the text: a <= n_left and LENGTH - a <= n_right."""
    n_left, n_right = near["n_left"].astype(np.int64), near["n_right"].astype(np.int64)
    ends, begins = np.left_shift(1, n_left + 1), np.left_shift(1, np.maximum(LENGTH - n_right, 0))
    return np.maximum(ends - begins, 0).astype("<u4")


def context_hash(keys: np.ndarray, near: np.ndarray) -> np.ndarray:
    whole = np.concatenate((keys[:, 8:], near.view(np.uint8).reshape(len(near), -1)), axis=1)
    up, _ = powers(whole.shape[1])
    with np.errstate(over="ignore"):
        return (BYTE_HASH[whole] * up).sum(axis=1)


def _docs(who: np.ndarray) -> tuple[bytes, bytes]:
    table, index = np.unique(who, return_inverse=True)
    return table.tobytes(), index.astype("<i4").tobytes()


def _who(df: pd.DataFrame) -> np.ndarray:
    return np.concatenate([np.frombuffer(d, WHO)[np.frombuffer(w, "<i4")] for d, w in zip(df["docs"], df["who"], strict=True)])


def _cuts(part: np.ndarray, n_parts: int) -> Iterator[tuple[int, int, int]]:
    cuts = np.searchsorted(part, np.arange(n_parts + 1))
    return ((p, i, j) for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i)


def contexts(docs: DataFrame, grams: Bitmap, n_parts: int) -> DataFrame:
    """Hashes of repeated grams and of their whole contexts, a row per part and batch of places.

    Of equal contexts in a batch only those of the smallest document go on; the others are
    known to be found in a smaller document, whole.
    """
    shift = np.uint64(64 - (n_parts.bit_length() - 1))

    def flush(kept: list) -> pd.DataFrame:
        who, at, h, c, masks = (np.concatenate(x) for x in zip(*kept, strict=True))
        kept.clear()
        order = np.lexsort((who["doc"], c, h))
        who, at, h, c, masks = who[order], at[order], h[order], c[order], masks[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        # of equal contexts in one document the first place stands for all, and a mark tells that there are more
        more = np.concatenate(([False], ~new[1:] & (who[1:] == who[:-1])))
        marks = np.unique(who[more])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        known = who["doc"] > who["doc"][first]
        if len(marks):
            keep = np.flatnonzero(~more)
            who, at, h, c, masks, known = (np.concatenate((x[keep], y)) for x, y in ((who, marks), (at, np.full(len(marks), MORE, at.dtype)), (h, np.zeros(len(marks), h.dtype)), (c, np.zeros(len(marks), c.dtype)), (masks, np.zeros(len(marks), masks.dtype)), (known, np.ones(len(marks), bool))))
        rows = []
        for flag in (False, True):
            # what is known is dealt by document, so that no gram's copies meet in one part
            i = np.flatnonzero(known == flag)
            part = bucket_of(who[i], n_parts) if flag else (h[i] >> shift).astype(np.int64)
            by_part = np.argsort(part, kind="stable")
            i, part = i[by_part], part[by_part]
            for p, lo, hi in _cuts(part, n_parts):
                k = i[lo:hi]
                rows.append((p, flag, b"" if flag else h[k].tobytes(), b"" if flag else c[k].tobytes(), *_docs(who[k]), at[k].tobytes(), masks[k].tobytes()))
        return pd.DataFrame(rows, columns=["part", "known", "grams", "contexts", "docs", "who", "places", "masks"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, n = [], 0
        for df in batches:
            for who, at, h, keys, near in places_of(df, grams):
                kept.append((who, at, h, context_hash(keys, near), every_start(near)))
                n += len(at)
                if n >= FLUSH:
                    yield flush(kept)
                    n = 0
        if n:
            yield flush(kept)

    return docs.mapInPandas(run, MET)


def bucket_of(who: np.ndarray, n_parts: int) -> np.ndarray:
    """Where a document's found places meet: spread over the parts by id."""
    with np.errstate(over="ignore"):
        return ((who["doc"].astype(np.uint64) * BASE) >> np.uint64(40)).astype(np.int64) % n_parts


def _packed(who: np.ndarray, at: np.ndarray, masks: np.ndarray, n_parts: int, part: int, bits: bytes | None = None) -> pd.DataFrame:
    """Found places, a row per bucket of documents, and one row of bits."""
    bucket = bucket_of(who, n_parts)
    order = np.argsort(bucket, kind="stable")
    who, at, masks, bucket = who[order], at[order], masks[order].astype("<u4"), bucket[order]
    rows = [(part, None, b, *_docs(who[i:j]), at[i:j].tobytes(), masks[i:j].tobytes()) for b, i, j in _cuts(bucket, n_parts)]
    if bits is not None:
        rows.append((part, bits, -1, b"", b"", b"", b""))
    return pd.DataFrame(rows, columns=["part", "bits", "bucket", "docs", "who", "places", "masks"])


def by_document(df: pd.DataFrame) -> pd.DataFrame:
    """The found places of a bucket's documents, a row per document."""
    who = _who(df)
    at = np.concatenate([np.frombuffer(x, "<i4") for x in df["places"]])
    masks = np.concatenate([np.frombuffer(x, "<u4") for x in df["masks"]])
    order = np.lexsort((at, who["key"], who["doc"]))
    who, at, masks = who[order], at[order], masks[order]
    starts = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
    ends = np.append(starts[1:], len(who))
    return pd.DataFrame({"doc_id": who["doc"][starts], "text_key": who["key"][starts], "places": [at[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], "masks": [masks[i:j].tobytes() for i, j in zip(starts, ends, strict=True)]})


def meet(n_bits: int, n_parts: int):
    """Reducer of ``contexts``: whole contexts found in smaller documents, and a bitmap of grams that stand in several contexts."""
    per = n_bits // n_parts

    def run(df: pd.DataFrame) -> pd.DataFrame:
        known, open_ = df[df["known"]], df[~df["known"]]
        bits = None
        parts = [(_who(x), np.concatenate([np.frombuffer(y, "<i4") for y in x["places"]]), np.concatenate([np.frombuffer(y, "<u4") for y in x["masks"]])) for x in (known, open_) if len(x)]
        if len(open_):
            bits = np.zeros(per // 8, np.uint8)
            who, at, masks = parts.pop()
            h = np.concatenate([np.frombuffer(x, np.uint64) for x in open_["grams"]])
            c = np.concatenate([np.frombuffer(x, np.uint64) for x in open_["contexts"]])
            order = np.lexsort((who["doc"], c, h))
            who, at, masks, h, c = who[order], at[order], masks[order], h[order], c[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            several = np.flatnonzero(new[1:] & (h[1:] == h[:-1])) + 1
            p = (h[several] & np.uint64(per - 1)).astype(np.int64)
            np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
            found = who["doc"] > who["doc"][first]
            parts.append((who[found], at[found], masks[found]))
        who, at, masks = (np.concatenate(x) for x in zip(*parts, strict=True))
        return _packed(who, at, masks, n_parts, int(df["part"].iloc[0]), None if bits is None else bits.tobytes())

    return run


def suffix_runs(docs: DataFrame, grams: Bitmap, n_parts: int) -> DataFrame:
    """Front-coded sorted runs of the suffixes at grams that stand in several contexts, a row per part and run.

    Of equal contexts in a run the smallest document's stands for all, once.
    """
    shift = np.uint64(64 - (n_parts.bit_length() - 1))

    def flush(kept: list) -> pd.DataFrame:
        who, at, h, keys, near = (np.concatenate(x) for x in zip(*kept, strict=True))
        kept.clear()
        whole = np.concatenate((keys, near.view(np.uint8).reshape(len(near), -1)), axis=1)
        order = np.lexsort((who["doc"], whole.view(f"S{whole.shape[1]}").ravel()))
        whole = whole[order]
        new = np.concatenate(([True], (whole[1:] != whole[:-1]).any(axis=1)))
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        more = np.concatenate(([False], ~new[1:] & (who[order][1:] == who[order][:-1])))
        order = order[(who["doc"][order] == who["doc"][order[first]]) & ~more]
        rows = []
        for p, i, j in _cuts((h[order] >> shift).astype(np.int64), n_parts):
            k = order[i:j]
            rows.append((p, *front_code(keys[k]), near[k].tobytes(), *_docs(who[k]), at[k].tobytes()))
        return pd.DataFrame(rows, columns=["part", "shared", "rest", "near", "docs", "who", "places"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, n = [], 0
        for df in batches:
            for found in places_of(df, grams):
                kept.append(found)
                n += len(found[1])
                if n >= FLUSH // 4:
                    yield flush(kept)
                    n = 0
        if n:
            yield flush(kept)

    return docs.mapInPandas(run, RUN)


def merge_part(df: pd.DataFrame, n_parts: int) -> pd.DataFrame:
    """Places of one part whose strings stand in smaller documents."""
    runs = [front_decode(s, r) for s, r in zip(df["shared"], df["rest"], strict=True)]
    order, prefix = merge_runs(runs, list(df["shared"]))
    starts = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
    index = np.fromiter((starts[r] + i for r, i in order), np.int64, len(order))
    near = np.concatenate([np.frombuffer(x, NEAR) for x in df["near"]])[index]
    who, at = _who(df)[index], np.concatenate([np.frombuffer(x, "<i4") for x in df["places"]])[index]
    masks = occurs_before(np.array(prefix, np.int64), near["left"], near["n_left"].astype(int), near["n_right"].astype(int), who["doc"])
    keep = masks != 0
    return _packed(who[keep], at[keep], masks[keep], n_parts, int(df["part"].iloc[0]))


def gather_bits(rows: DataFrame, key: str, n_bits: int, per: int) -> np.ndarray:
    """A bitmap from its parts: ``n_bits`` / 8 bytes, 32 MB at most."""
    bits = np.zeros(n_bits // 8, np.uint8)
    for r in rows.select(key, "bits").toLocalIterator():
        bits[r[key] * (per // 8) : (r[key] + 1) * (per // 8)] = np.frombuffer(r["bits"], np.uint8)
    return bits


def equal_starts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All starts in ``raw`` of strings that also start at one of ``starts``, by their 64-bit hashes."""
    out, wanted = [], None
    for both in (False, True):
        found = []
        for low in range(0, len(raw) - LENGTH + 1, PART):
            part = raw[low : low + PART + LENGTH - 1]
            up, down = powers(len(part))
            with np.errstate(over="ignore"):
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(BYTE_HASH[part] * up, out=sums[1:])
                h = (sums[LENGTH:] - sums[:-LENGTH]) * down[: len(part) - LENGTH + 1]
            if both:
                out.append(np.flatnonzero(np.isin(h, wanted)) + low)
            else:
                found.append(h[starts[(starts >= low) & (starts < low + PART)] - low])
        wanted = wanted if both else np.unique(np.concatenate(found))
    return np.concatenate(out)


def removed_bytes(raw: np.ndarray, places: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which bytes of ``raw`` a found string covers."""
    places, more = places.astype(np.int64), bool((places == MORE).any())
    begins = [places[(masks >> np.uint32(a) & 1) == 1] - a for a in range(REACH + 1)]
    change = np.zeros(len(raw) + 1, np.int32)
    at = np.unique(np.concatenate(begins))
    if more and len(at):
        at = equal_starts(raw, at)
    np.add.at(change, at, 1)
    np.add.at(change, at + LENGTH, -1)
    return np.cumsum(change[: len(raw)]) > 0


def suffix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    searched = rows.filter("doc_id is not null")
    n_docs = searched.count()
    n_bits = min(max(1 << 16, 1 << (256 * n_docs).bit_length()), MAX_BITS)
    n_parts = 1 << max(n_docs // DOCS_PER_PART, 32).bit_length()
    n_parts = min(n_parts, n_bits >> 10)
    share = docs.sparkSession.sparkContext.broadcast
    sought = keyed.filter("doc_id is not null")
    grams = Bitmap(share(repeated_grams(searched, n_bits, n_parts)), n_bits, n_parts)
    met = materialize(contexts(sought, grams, n_parts).groupBy("part", "known").applyInPandas(meet(n_bits, n_parts), FOUND))
    mixed = Bitmap(share(gather_bits(met.filter("bits is not null"), "part", n_bits, n_bits // n_parts)), n_bits, n_parts)
    partly = suffix_runs(sought, mixed, n_parts).groupBy("part").applyInPandas(lambda df: merge_part(df, n_parts), FOUND)
    found = met.filter("bits is null").unionByName(partly)
    cover = materialize(found.groupBy("bucket").applyInPandas(by_document, COVER))

    @pandas_udf("struct<n_removed long, n_spans long, kept binary>")
    def remove(texts: pd.Series, places: pd.Series, masks: pd.Series) -> pd.DataFrame:
        out = []
        for t, at, m in zip(texts, places, masks, strict=True):
            raw = np.frombuffer(t.encode(), np.uint8)
            gone = removed_bytes(raw, np.frombuffer(at, "<i4"), np.frombuffer(m, "<u4"))
            spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((int(gone.sum()), spans, raw[~gone].tobytes()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    met = keyed.join(cover, ["doc_id", "text_key"], "left")
    none = F.lit(0).cast("long")
    size = F.octet_length("text").cast("long").alias("n_bytes")
    untouched = met.filter("places is null").select("doc_id", size, none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    cleaned = met.filter("places is not null").select("doc_id", size, remove("text", "places", "masks").alias("r")).select("doc_id", "n_bytes", "r.n_removed", "r.n_spans", "r.kept")
    return untouched.unionByName(cleaned).withColumn("kept_sha256", F.sha2("kept", 256))
