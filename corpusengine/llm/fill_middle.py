"""Fill-in-the-middle transformation of texts, column by column of each Arrow batch.

A text is cut into lines; two draws choose where its prefix and its middle end. The work on
a batch is a chain of ``pyarrow.compute`` kernels: texts are split into list arrays, the
lists are flattened with the index of their parent, units get their ordinal within the
parent, the ordinal gives each unit its role (prefix, middle, suffix), units of one role are
filtered out and become lists again, and ``binary_join`` makes pieces of them. ``restore``
is the way back, by expressions.

Draws are made from the SHA-256 of ``seed:doc_id``: its first four groups of eight hex
digits. So a document's form depends on its id alone, whatever the partitions are.

Defined results: a null text counts as empty; an empty text, and one that holds a sentinel,
stays as it is (form ``plain``); a null id draws as an empty string would; repeated rows are
rows of their own with equal results; columns named ``n``, ``form``, ``prefix_chars``,
``middle_chars`` or ``output`` are replaced, other columns pass through. Texts are taken
whole; a batch goes through the kernels in slices of at most ``SLICE`` bytes, or one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusengine.session import small_batches

#: Bytes of texts that go through the kernels together.
SLICE = 8 << 20
OUTPUT = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Form:
    """Sentinels, seed, the share of documents that are transformed, and of those in suffix-first order (in hundredths)."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 7
    rate: int = 100
    suffix_first: int = 50


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def modulo(x: pa.Array, m: pa.Array | int) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, m), m))


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Flattened lines with their line breaks, the parent of each, and the number of lines of each text."""
    lists = pc.split_pattern(texts, "\n")
    parent = pc.list_parent_indices(lists)
    pieces = pc.list_flatten(lists)
    ends = np.diff(np.append(parent.to_numpy(), len(texts))) != 0 if len(pieces) else np.zeros(0, bool)
    units = pc.binary_join_element_wise(pieces, pc.if_else(pa.array(ends), "", "\n"), "")
    # what follows the last line break is a line only if it is not empty
    full = pc.greater(pc.binary_length(units), 0)
    units, parent = units.filter(full), parent.filter(full).to_numpy()
    return units, parent, np.bincount(parent, minlength=len(texts))


def pieces_of(units: pa.Array, parent: np.ndarray, role: np.ndarray, k: int, rows: int) -> pa.Array:
    """For each of ``rows`` texts, its units of role ``k`` joined."""
    own = role == k
    offsets = np.concatenate([[0], np.cumsum(np.bincount(parent[own], minlength=rows))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), units.filter(pa.array(own))), "")


def transform(texts: pa.Array, h: list[pa.Array], form: Form) -> list[pa.Array]:
    """The columns ``OUTPUT`` of one slice; ``h`` has the draws."""
    texts = pc.fill_null(texts, "")
    units, parent, n = units_of(texts)
    count = pa.array(n.astype(np.int64))
    one, two = (modulo(x, pc.add(count, 1)) for x in h[:2])
    first, second = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    starts = np.cumsum(n) - n
    ordinal = np.arange(len(units)) - starts[parent]
    role = (ordinal >= first.to_numpy()[parent]).astype(np.int8) + (ordinal >= second.to_numpy()[parent])
    prefix, middle, suffix = (pieces_of(units, parent, role, k, len(texts)) for k in range(3))
    holds = pc.equal(count, 0)
    for mark in (form.prefix, form.suffix, form.middle):
        holds = pc.or_(holds, pc.match_substring(texts, mark))
    plain = pc.or_(holds, pc.greater_equal(modulo(h[2], 100), form.rate))
    back = pc.less(modulo(h[3], 100), form.suffix_first)
    join = lambda *parts: pc.binary_join_element_wise(*parts, "")
    output = pc.if_else(plain, texts, pc.if_else(back, join(form.suffix, suffix, form.prefix, prefix, form.middle, middle), join(form.prefix, prefix, form.suffix, suffix, form.middle, middle)))
    name = pc.if_else(plain, "plain", pc.if_else(back, "spm", "psm"))
    chars = lambda part: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(part).cast(pa.int64()))
    return [count, name, chars(prefix), chars(middle), output]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``SLICE`` bytes, or of one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, side="right")))
        yield at, end
        at = end


def fill_in_middle(docs: DataFrame, form: Form = Form(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with n (lines), form, prefix_chars, middle_chars (code points, null where plain) and output."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in OUTPUT]
    lead = "_"
    while any(f"{lead}h{k}" in docs.columns for k in range(4)) or f"{lead}text" in docs.columns:
        lead += "_"
    names = [f"{lead}text", *(f"{lead}h{k}" for k in range(4))]
    ready = docs.select(*kept, F.col(text).alias(names[0]), *[h.alias(x) for x, h in zip(names[1:], draws(F.col(doc_id), form.seed), strict=True)])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ready.select(*kept).schema]
    schema = ", ".join([*fields, "n long", "form string", "prefix_chars long", "middle_chars long", "output string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in slices(batch.column(names[0])):
                part = batch.slice(at, end - at)
                made = transform(part.column(names[0]), [part.column(x) for x in names[1:]], form)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *made], names=[*kept, *OUTPUT])

    return ready.mapInArrow(run, schema)


def restore(output: Column, name: Column, form: Form = Form()) -> Column:
    """The text that ``output`` of form ``name`` was made from."""
    literal = lambda s: "\\Q" + s + "\\E"
    part = F.split(output, "|".join(map(literal, (form.prefix, form.suffix, form.middle))))
    at = lambda k: F.get(part, F.lit(k))
    return F.when(name == "plain", output).when(name == "spm", F.concat(at(2), at(3), at(1))).otherwise(F.concat(at(1), at(3), at(2)))
