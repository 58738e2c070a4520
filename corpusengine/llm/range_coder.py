"""Adaptive context-mixing range coder for blocks of token ids, sections of many blocks in step.

A block is coded on its own, from an empty model. In front stand the ids it has, as gaps; from
then on an id is its number among them, and a block of one id ends there. A block is cut into at most ``SECTIONS`` sections of
one length, which go in step and share the block's model. For each id the model has three
predictions: the number that last followed the last two of the section (order 2), the one that
last followed the last one (order 1), each with a confidence, and the frequencies of the numbers
so far (order 0). Adaptive counts, kept per pair of confidences, mix them into the probabilities
of three events: order 2 is right, order 1 is right, neither. For neither the number's
place among the frequencies follows. What the model knows grows by segments, each an eighth of
what went before, so within a segment its tables stand still.

Each section has a coder with a 48-bit range, which emits 16 bits at a time; carries stay in the
emitted digits and are settled at the end. Ranges are whole numbers in doubles, which divide
faster and are exact below 2^53. All state is an array with one place per section, so numpy does
a step of all sections at once; the decoder runs the same model. Blocks go by falling length,
so those that have ended drop off the end of the arrays.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np

#: Ids of a block; its sections, each of ``SHORT`` ids at least where there are several.
BLOCK, SECTIONS, SHORT = 8192, 16, 256
#: Slots of order 2; one step of a prediction's confidence (0 to 3, in its upper bits) and the bits of its number.
SIZE2, SURE, NUMBER = 1 << 13, 1 << 13, (1 << 13) - 1
#: Parts of a range that events share out, events after which counts are halved, and bits of a number's count.
PARTS, LIMIT, COUNT = 1 << 12, 1 << 12, 14
#: Ranges of ids whose gaps are coded alike: small ids stand closer.
RANGES = np.array([0, *(1 << k for k in range(8, 17))])
FULL, LOW, DIGIT = 2.0**48, 2.0**32, 2.0**16


def segments(n: int) -> list[int]:
    """Steps at which the model learns, and ``n``."""
    at = [0]
    while at[-1] < n:
        at.append(min(at[-1] + max(1, at[-1] // 8), n))
    return at


class Model:
    """Predictions of the sections of blocks in step; ``steps``, ``width`` (sections) and ``distinct`` (numbers) by block, by falling steps."""

    def __init__(self, steps: np.ndarray, width: np.ndarray, distinct: np.ndarray):
        self.steps, self.width, self.distinct = steps, width, distinct
        k = len(steps)
        self.block = np.repeat(np.arange(k), width)
        self.starts, self.stops = np.concatenate(([0], np.cumsum(distinct))), np.cumsum(width)
        self.next1, self.next2 = np.zeros(self.starts[-1], np.uint16), np.zeros(k * SIZE2, np.uint16)
        self.counts, self.events = np.ones(self.starts[-1], np.int64), np.ones((k * 16, 3), np.int64)
        self.base1, self.base2, self.base16 = self.starts[self.block], self.block * SIZE2, self.block * 16
        self.numbers = np.concatenate([np.arange(d, dtype=np.uint16) for d in distinct])
        #: sections at work, by step
        self.alive = np.searchsorted(-steps[self.block], -np.arange(steps[0])).tolist()
        self.nothing, self.history = np.zeros(len(self.block), np.uint16), None

    def begin(self, since: int, upto: int, decoding: bool = False) -> None:
        """Tables of the segment of steps ``since`` to ``upto``, with what the last one had."""
        k, m = int(np.searchsorted(-self.steps, -since)), self.alive[since]
        size, contexts = self.starts[k], self.events[: k * 16]
        if self.history is not None:
            at1, at2, found1, found2, mix, event, x = (h[:, :m] for h in self.history)
            for following, at, found in ((self.next1, at1, found1), (self.next2, at2, found2)):
                following[at] = np.where(found & NUMBER == x, found + SURE * (found < 3 * SURE).astype(np.uint16), np.where(found >= SURE, found - SURE, x))
            self.counts[:size] += np.bincount((self.base1[:m] + x).ravel(), minlength=size)
            contexts += np.bincount((mix * 3 + event).ravel(), minlength=contexts.size).reshape(-1, 3)
            full = contexts.sum(axis=1) > LIMIT
            contexts[full] = (contexts[full] + 1) >> 1
        counts = self.counts[:size]
        # where a number begins among all blocks' frequencies, and its count in the last bits
        self.places = np.cumsum(counts)
        self.places -= counts
        self.first = self.places[self.base1[:m]]
        self.places <<= COUNT
        self.places |= counts
        self.total = (self.distinct + since * self.width).astype(float)[self.block[:m]]
        if decoding:
            self.table = np.repeat(self.numbers[:size], counts)
        total = contexts.sum(axis=1)
        self.bound1 = (contexts[:, 0] * (PARTS - 3) // total + 1).astype(float)
        self.bound2 = ((contexts[:, 0] + contexts[:, 1]) * (PARTS - 3) // total + 2).astype(float)
        self.history = [np.empty((upto - since, m), t) for t in (np.intp, np.intp, np.uint16, np.uint16, np.intp, np.uint8, np.uint16)]
        self.row = -1

    def predict(self, so_far: np.ndarray, s: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers that orders 1 and 2 expect at step ``s``, and where in ``PARTS`` the second and third event begin; of the first ``m`` sections."""
        last, before = so_far[s - 1, :m] if s else self.nothing[:m], so_far[s - 2, :m] if s > 1 else self.nothing[:m]
        self.row += 1
        at1, at2, found1, found2, mix = (h[self.row, :m] for h in self.history[:5])
        np.add(self.base1[:m], last, out=at1)
        np.add(self.base2[:m], (last * 40503 + before * 30011) >> 3, out=at2)
        found1[:], found2[:] = self.next1.take(at1), self.next2.take(at2)
        np.add(self.base16[:m], (found2 >> 13 << 2) + (found1 >> 13), out=mix)
        return found1 & NUMBER, found2 & NUMBER, self.bound1.take(mix), self.bound2.take(mix)

    def store(self, x: np.ndarray, hit: np.ndarray, event: np.ndarray) -> None:
        """Numbers of the step, and which sections had one of the first two events."""
        events, numbers = (h[self.row, : len(x)] for h in self.history[5:])
        events[:], numbers[:] = 2, x
        events[hit] = event


def shape(lengths: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks with more than one number by falling steps; their steps and sections."""
    width = np.clip(lengths // SHORT, 1, SECTIONS)
    steps = -(-lengths // width)
    order = np.argsort(-steps, kind="stable")
    order = order[distinct[order] > 1]
    return order, steps[order], width[order]


def rice_bits(counts: np.ndarray) -> np.ndarray:
    """Low bits of a gap in each range, by how many ids it has."""
    return np.maximum(np.frexp((np.diff(RANGES) * 7 // (10 * np.maximum(counts, 1))).astype(float))[1] - 1, 0)


def head_of(known: np.ndarray) -> bytes:
    """The ids of a block, ascending: which ranges have some, how many, and their gaps by Golomb-Rice codes, upper parts first."""
    counts = np.diff(np.searchsorted(known, RANGES))
    begins, low = np.repeat(RANGES[:-1], counts), np.repeat(rice_bits(counts), counts)
    gaps = known.astype(np.int64)
    gaps[1:] -= np.maximum(gaps[:-1] + 1, begins[1:])
    gaps[:1] -= begins[:1]
    ones = np.cumsum((gaps >> low) + 1) - 1
    upper, ends = np.zeros(ones[-1] + 1, np.uint8), np.cumsum(low)
    upper[ones] = 1
    lower = np.repeat(gaps, low) >> np.repeat(ends, low) - 1 - np.arange(ends[-1]) & 1
    sizes = [byte for c in counts[counts > 0].tolist() for byte in ((c,) if c < 128 else (c & 127 | 128, c >> 7))]
    mask = int((counts > 0) @ (1 << np.arange(len(counts))))
    return mask.to_bytes(2, "little") + bytes(sizes) + np.packbits(upper).tobytes() + np.packbits(lower.astype(np.uint8)).tobytes()


def from_head(coded: bytes) -> tuple[np.ndarray, int]:
    """The ids of a block, and where its sections begin."""
    mask, at, counts = int.from_bytes(coded[:2], "little"), 2, np.zeros(len(RANGES) - 1, np.int64)
    for k in range(len(counts)):
        if mask >> k & 1:
            counts[k], at = (coded[at], at + 1) if coded[at] < 128 else (coded[at] & 127 | coded[at + 1] << 7, at + 2)
    n, low = int(counts.sum()), np.repeat(rice_bits(counts), counts)
    # upper parts have less than four bits an id, as low bits go by counts
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(coded[at : at + n // 2 + 1], np.uint8)))[:n]
    at += int(ones[-1]) // 8 + 1
    ends = np.cumsum(low)
    begin, size = ends - low, -(-int(ends[-1]) // 8)
    raw = np.frombuffer(coded[at : at + size] + bytes(4), np.uint8).astype(np.int64)
    window = raw[begin >> 3] << 16 | raw[(begin >> 3) + 1] << 8 | raw[(begin >> 3) + 2]
    gaps = np.diff(ones, prepend=-1) - 1 << low | window >> 24 - low - (begin & 7) & (1 << low) - 1
    ids = np.cumsum(gaps + 1)
    firsts = np.cumsum(counts) - counts
    before = np.where(counts > 0, np.append(0, ids)[firsts], 0)
    return (ids - 1 + np.repeat(RANGES[:-1] - before, counts)).astype(np.uint16), at + size


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids (at most ``BLOCK``, below 65536) as bytes."""
    lengths, known = np.array([len(b) for b in blocks], np.int64), []
    room = np.zeros(1 << 16, np.uint16)
    for ids in blocks:
        ids = np.sort(ids, kind="stable")
        known.append(ids[np.diff(ids, prepend=ids[:1] ^ 1) != 0])
    out = [head_of(ids) if len(ids) else b"" for ids in known]
    distinct = np.array([len(ids) for ids in known], np.int64)
    order, steps, width = shape(lengths, distinct)
    if not len(order):
        return out
    model, n = Model(steps, width, distinct[order]), int(steps[0])
    lanes, ends = len(model.block), model.stops.tolist()
    numbers = np.zeros((lanes, n), np.uint16)
    for i, w, size, end in zip(order.tolist(), width.tolist(), steps.tolist(), ends, strict=True):
        room[known[i]] = np.arange(len(known[i]))
        padded = np.zeros(w * size, np.uint16)
        padded[: lengths[i]] = room[blocks[i]]
        numbers[end - w : end, :size] = padded.reshape(w, size)
    numbers = np.ascontiguousarray(numbers.T)
    all_low, all_size, emitted = np.zeros(lanes), np.full(lanes, FULL), []
    for since, upto in pairwise(segments(n)):
        model.begin(since, upto)
        for s in range(since, upto):
            m = model.alive[s]
            low, size, x = all_low[:m], all_size[:m], numbers[s, :m]
            id1, id2, bound1, bound2 = model.predict(numbers, s, m)
            hit = np.flatnonzero((id1 == x) | (id2 == x))
            second = id2[hit] != x[hit]
            model.store(x, hit, second)
            part = np.floor(size * (1 / PARTS))
            bound2 *= part
            begin1, begin2, low_then = bound1[hit] * part[hit], bound2[hit], low[hit]
            size -= bound2
            low += bound2
            size /= model.total[:m]
            np.floor(size, out=size)
            place = model.places.take(model.base1[:m] + x)
            low += size * ((place >> COUNT) - model.first[:m])
            size *= place & (1 << COUNT) - 1
            low[hit] = low_then + begin1 * second
            size[hit] = np.where(second, begin2 - begin1, begin1)
            while size.min() < LOW:
                small = size < LOW
                digit = np.floor(low * (1 / LOW))
                emitted.append((digit.astype(np.uint32), small))
                low[:] = np.where(small, (low - digit * LOW) * DIGIT, low)
                size *= np.where(small, DIGIT, 1.0)
    # a section ends with a multiple of LOW in its range; the digits behind it are 0
    emitted.append((np.ceil(all_low / LOW).astype(np.uint32), np.ones(lanes, bool)))
    digits, kept, carry = np.zeros((len(emitted), lanes), np.uint16), np.zeros((len(emitted), lanes), bool), np.zeros(lanes, np.uint32)
    for at in range(len(emitted) - 1, -1, -1):
        digit, small = emitted.pop()
        m = len(digit)
        digit += carry[:m]
        carry[:m] = np.where(small, digit >> 16, carry[:m])
        digits[at, :m], kept[at, :m] = digit & 0xFFFF, small
    used = kept.sum(axis=0)
    coded = np.ascontiguousarray(digits.T)[np.ascontiguousarray(kept.T)].astype("<u2")
    stops = np.concatenate(([0], np.cumsum(used))).tolist()
    for i, w, end in zip(order.tolist(), width.tolist(), ends, strict=True):
        out[i] += used[end - w : end - 1].astype("<u2").tobytes() + coded[stops[end - w] : stops[end]].tobytes()
    return out


def decode_blocks(coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block; ``lengths`` are their numbers of ids."""
    lengths = np.array(lengths, np.int64)
    heads = [from_head(c) if size else (np.zeros(0, np.uint16), 0) for c, size in zip(coded, lengths, strict=True)]
    out = [np.repeat(ids, size if len(ids) == 1 else 0) for (ids, _), size in zip(heads, lengths, strict=True)]
    distinct = np.array([len(ids) for ids, _ in heads], np.int64)
    order, steps, width = shape(lengths, distinct)
    if not len(order):
        return out
    model, n = Model(steps, width, distinct[order]), int(steps[0])
    lanes, streams = len(model.block), []
    for i, w in zip(order.tolist(), width.tolist(), strict=True):
        raw = np.frombuffer(coded[i][heads[i][1] :], "<u2")
        streams += np.split(raw[w - 1 :], np.cumsum(raw[: w - 1]))
    used = np.array([len(p) for p in streams])
    # a section reads two digits behind its last
    digits = np.zeros((lanes, int(used.max()) + 4), np.uint16)
    digits[np.arange(digits.shape[1]) < used[:, None]] = np.concatenate(streams)
    flat = digits.reshape(-1)
    all_code, all_size, all_at = digits[:, 0] * 2.0**32 + digits[:, 1] * 2.0**16 + digits[:, 2], np.full(lanes, FULL), np.arange(lanes) * digits.shape[1] + 3
    seen = np.zeros((n, lanes), np.uint16)
    for since, upto in pairwise(segments(n)):
        model.begin(since, upto, decoding=True)
        for s in range(since, upto):
            m = model.alive[s]
            code, size, at_digit, total, first = all_code[:m], all_size[:m], all_at[:m], model.total[:m], model.first[:m]
            id1, id2, bound1, bound2 = model.predict(seen, s, m)
            part = np.floor(size * (1 / PARTS))
            bound2 *= part
            hit = np.flatnonzero(code < bound2)
            begin1, begin2, code_then = bound1[hit] * part[hit], bound2[hit], code[hit]
            size -= bound2
            code -= bound2
            code[hit] = 0
            size /= total
            np.floor(size, out=size)
            place = np.floor(code / size)
            np.minimum(place, total - 1, out=place)
            place += first
            x = model.table.take(place.astype(np.intp))
            place = model.places.take(model.base1[:m] + x)
            code -= size * ((place >> COUNT) - first)
            size *= place & (1 << COUNT) - 1
            second = code_then >= begin1
            code[hit] = code_then - begin1 * second
            size[hit] = np.where(second, begin2 - begin1, begin1)
            x[hit] = np.where(second, id1[hit], id2[hit])
            seen[s, :m] = x
            model.store(x, hit, second)
            while size.min() < LOW:
                small = size < LOW
                code[:] = np.where(small, code * DIGIT + flat.take(at_digit), code)
                size *= np.where(small, DIGIT, 1.0)
                at_digit += small
    seen = np.ascontiguousarray(seen.T)
    for i, w, size, end in zip(order.tolist(), width.tolist(), steps.tolist(), model.stops.tolist(), strict=True):
        out[i] = heads[i][0][seen[end - w : end, :size].ravel()[: lengths[i]]]
    return out
