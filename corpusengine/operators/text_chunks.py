"""Recursive chunks of long texts as one Spark SQL expression: no Python worker, no shuffle.

``chunks_of(text)`` is SQL for an array of (text, tokens), so the same words serve data
frames (``chunk_documents``) and the SQL table function ``chunks``.

A text is cut at lines that begin with ``Table N:``. A table reaches from its title over
everything up to its first row of figures and over the rows and short labels after it; the
second blank line in a row or a line of prose ends it, as does the next title. Tables of up
to ``max_table`` tokens stay whole. All else is split at blank lines and, where a piece is
above ``max_tokens``, at each finer separator in turn, at last every ``4 * max_tokens``
characters; then pieces are joined greedily, and a new chunk starts with the last pieces of
the one before, as far as they fit into ``overlap`` tokens.

Null, empty and blank texts give no rows. Repeated rows are chunked each. A text is one
value of a row, so a task needs a few times the memory of its largest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators from coarse to fine, each with its pattern. Fixed values.
SEPARATORS = {r"\n\n": r"\n\n", r"\n": r"\n", ". ": r"\. ", "? ": r"\? ", "! ": "! ", "; ": "; ", ", ": ", ", " ": " "}
#: Blank characters of Unicode and the four separators of ASCII, as SQL escapes.
BLANKS = "".join(rf"\u{n:04x}" for n in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: A table's title, and the characters of figures. Fixed values.
TITLE = r"Table[\s\x1c-\x1f]+\d+:"
FIGURES = r"[\d%.,\-/±()\[\]\s\x1c-\x1f]"
#: Chunks are gathered in blocks, so that adding one copies no long array.
BLOCK = 512


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _strip(text: str) -> str:
    return f"btrim({text}, '{BLANKS}')"


def tokens_sql(text: str) -> str:
    """A quarter of the characters, one at least, none for an empty text."""
    return f"IF({text} = '', 0, greatest(1, CAST(length({text}) DIV 4 AS INT)))"


def _blocks(text: str, max_table: int) -> str:
    """Array of (s, whole): prose and tables in order."""
    kind = rf"""IF({_strip('line')} = '', 0, IF(length(regexp_replace(line, r'(?U){FIGURES}', '')) / length({_strip('line')}) < 0.35D, 1,
        IF(length({_strip('line')}) < 45 AND NOT endswith({_strip('line')}, '.'), 2, 3)))"""
    ends = "transform(kinds, (k, i) -> first > 0 AND i >= first AND (k = 3 OR k = 0 AND get(kinds, i - 1) = 0))"
    upto = _strip(r"array_join(slice(lines, 1, n), '\n')")
    table = _let("body", upto, f"named_struct('s', body, 'whole', {tokens_sql('body')} <= {max_table})")
    rest = r"named_struct('s', array_join(slice(lines, n + 1, size(lines)), '\n'), 'whole', false)"
    cut = "IF(array_position(ends, true) = 0, size(lines), CAST(array_position(ends, true) AS INT) - 1)"
    both = _let("n", cut, f"array({table}, {rest})")
    both = _let("kinds", f"transform(lines, line -> {kind})", _let("first", "array_position(kinds, 1)", _let("ends", ends, both)))
    both = _let("lines", r"split(part, r'\n', -1)", both)
    parts = rf"split({text}, r'(?mdU)(?=^{TITLE})', -1)"
    return rf"flatten(transform({parts}, part -> IF(part RLIKE r'(?U)^{TITLE}', {both}, array(named_struct('s', part, 'whole', false)))))"


def _pieces(text: str, max_tokens: int) -> str:
    """Array of (x, n, k): pieces with their separators, characters and tokens."""
    found = f"array(named_struct('s', {text}, 't', ''))"
    for level, (mark, pattern) in enumerate(SEPARATORS.items()):
        apart = f"filter(transform(cut, (s, i) -> named_struct('s', {_strip('s')}, 't', IF(i < size(cut) - 1, '{mark}', p.t))), q -> q.s <> '')"
        apart = _let("cut", f"split(p.s, r'{pattern}', -1)", apart)
        # the coarsest separator always splits
        if level > 0:
            apart = f"IF({tokens_sql('p.s')} <= {max_tokens}, array(p), {apart})"
        found = f"flatten(transform({found}, p -> {apart}))"
    hard = _let("cut", f"regexp_extract_all(p.s, r'(?s).{{1,{4 * max_tokens}}}', 0)", "transform(cut, (s, i) -> concat(s, IF(i < size(cut) - 1, '', p.t)))")
    found = f"flatten(transform({found}, p -> IF({tokens_sql('p.s')} <= {max_tokens}, array(concat(p.s, p.t)), {hard})))"
    return f"transform({found}, x -> named_struct('x', x, 'n', length(x), 'k', {tokens_sql('x')}))"


def _joined(pieces: str, max_tokens: int, overlap: int) -> str:
    """Array of strings: pieces joined greedily, with overlap."""
    fits = f"""aggregate(reverse(a.held), named_struct('n', 0, 'k', 0, 'open', true),
        (o, h) -> IF(o.open AND o.k + h.k <= {overlap}, named_struct('n', o.n + 1, 'k', o.k + h.k, 'open', true), named_struct('n', o.n, 'k', o.k, 'open', false)), o -> o.n)"""
    held = f"concat({_let('n', fits, 'slice(a.held, size(a.held) - n + 1, n)')}, array(p))"
    chunk = "filter(array(array_join(transform(a.held, h -> h.x), '')), c -> c <> '')"
    size = f"greatest(1, CAST(aggregate({held}, 0, (m, h) -> m + h.n) DIV 4 AS INT))"
    more = f"""named_struct('full', IF(size(a.done) < {BLOCK}, a.full, concat(a.full, array(a.done))),
        'done', IF(size(a.done) < {BLOCK}, concat(a.done, {chunk}), {chunk}), 'held', {held}, 'k', {size})"""
    same = "named_struct('full', a.full, 'done', a.done, 'held', concat(a.held, array(p)), 'k', a.k + p.k)"
    start = "named_struct('full', CAST(array() AS ARRAY<ARRAY<STRING>>), 'done', CAST(array() AS ARRAY<STRING>), 'held', CAST(array() AS ARRAY<STRUCT<x: STRING, n: INT, k: INT>>), 'k', 0)"
    return f"aggregate({pieces}, {start}, (a, p) -> IF(a.k + p.k > {max_tokens}, {more}, {same}), a -> concat(flatten(a.full), a.done, {chunk}))"


def _normal(text: str) -> str:
    return _strip(rf"regexp_replace(replace(coalesce({text}, ''), '\r\n', '\n'), r'[ \t]+', ' ')")


def chunks_of(text: str, max_tokens: int = 150, overlap: int = 50, max_table: int = 1000) -> str:
    """SQL for the chunks, an array of (text, tokens), of the SQL expression ``text``."""
    joined = _joined(_pieces("b.s", max_tokens), max_tokens, overlap)
    prose = f"transform(filter({joined}, c -> {_strip('c')} <> ''), c -> named_struct('text', {_strip('c')}, 'tokens', {tokens_sql('c')}))"
    whole = f"array(named_struct('text', b.s, 'tokens', {tokens_sql('b.s')}))"
    return f"flatten(transform({_blocks(_normal(text), max_table)}, b -> IF(b.whole, {whole}, {prose})))"


def chunk_column(text: str, max_tokens: int = 150, overlap: int = 50, max_table: int = 1000) -> Column:
    return F.expr(chunks_of(text, max_tokens, overlap, max_table))


def chunk_documents(docs: DataFrame, max_tokens: int = 150, overlap: int = 50, max_table: int = 1000) -> DataFrame:
    """(doc_id, chunk_index, text, tokens) of every document."""
    rows = docs.select("doc_id", F.posexplode(chunk_column("text", max_tokens, overlap, max_table)).alias("chunk_index", "chunk"))
    return rows.select("doc_id", "chunk_index", "chunk.text", "chunk.tokens")


def table_blocks(docs: DataFrame, max_table: int = 1000) -> DataFrame:
    """(doc_id, block, whole, text): the blocks that chunks are cut from; ``whole`` for a table that stays in one piece."""
    rows = docs.select("doc_id", F.posexplode(F.expr(_blocks(_normal("text"), max_table))).alias("at", "b")).filter(F.expr(f"{_strip('b.s')} <> ''"))
    return rows.select("doc_id", F.col("at").alias("block"), "b.whole", F.col("b.s").alias("text"))


def register_chunks(spark) -> None:
    """The SQL table function ``chunks(text)``: (chunk_index, text, tokens)."""
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION chunks(body STRING) RETURNS TABLE (chunk_index INT, text STRING, tokens INT)
        RETURN SELECT at, c.text, c.tokens FROM (SELECT posexplode({chunks_of('body')}) AS (at, c))"""
    )
