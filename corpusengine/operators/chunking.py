"""Chunkers of pages, tables and figures: one document in, many rows out. Long texts: ``text_chunks``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusengine.operators.ordered import walk_groups

NUMBERISH = r"[0-9%.,\-/±()\[\]\s]"


def tokens_of(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def is_data_row(line: Column) -> Column:
    """Mostly digits and number signs: less than 35 % other characters."""
    return F.length(F.regexp_replace(line, NUMBERISH, "")) / F.greatest(F.length(line), F.lit(1)) < 0.35


def is_table_line(line: Column) -> Column:
    return is_data_row(line) | ((F.length(line) < 45) & ~line.endswith("."))


def hard_split(docs: DataFrame, max_tokens: int = 150) -> DataFrame:
    """Windows of ``4 * max_tokens`` characters, natively: doc_id, chunk_index, text."""
    step = 4 * max_tokens
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / step).cast("int")), lambda i: F.struct(i.alias("chunk_index"), F.substr("text", i * step + 1, F.lit(step)).alias("text")))
    rows = docs.filter(F.length("text") > 0).select("doc_id", cuts.alias("c"))
    return rows.select("doc_id", F.explode("c").alias("c")).select("doc_id", "c.chunk_index", "c.text")


#: Tags of an item -> its label, and characters of texts that stand for others.
ITEM_TAGS = {"h1": "section_header", "h2": "section_header", "h3": "section_header", "h4": "section_header", "p": "text", "li": "text", "table": "table"}
CHARACTERS = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def items_of_pages(pages: DataFrame) -> DataFrame:
    """Ordered items (doc_id, seq, label, text) of HTML pages: section_header, text and table items.

    An item begins with its tag and ends at the next tag of an item, opening or closing;
    scripts, styles and comments go, other tags only mark nothing. Blank items are left out.
    """
    tags = "|".join(ITEM_TAGS)
    body = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    marked = F.regexp_replace(body, rf"(?i)<({tags})(\s[^>]*)?>", "\x01$1\x02")
    marked = F.regexp_replace(F.regexp_replace(marked, rf"(?i)</({tags})\s*>", "\x01\x02"), r"<[^>]*>", "")
    text = F.substring_index("part", "\x02", -1)
    for written, meant in CHARACTERS.items():
        text = F.replace(text, F.lit(written), F.lit(meant))
    label = F.create_map(*[F.lit(x) for pair in ITEM_TAGS.items() for x in pair])[F.lower(F.substring_index("part", "\x02", 1))]
    parts = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.split(marked, "\x01")).alias("at", "part")).filter("at > 0")
    items = parts.select("doc_id", "at", label.alias("label"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text")).filter("label is not null and text <> ''")
    return items.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).alias("seq"), "label", "text")


def with_sections(items: DataFrame) -> DataFrame:
    """Items with their section number and heading (a header carries forward)."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("label") == "section_header", F.col("text"))
    return items.withColumn("section", F.count(head).over(w)).withColumn("heading", F.last(head, ignorenulls=True).over(w))


def section_chunks(items: DataFrame, max_tokens: int = 150) -> DataFrame:
    """Prose of each section joined up to ``max_tokens``, prefixed with its heading; an item is never split."""

    def pack(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, size, part = [], 0, 0
        for doc_id, section, _, heading, text in rows:
            prefix = f"[Section: {heading}]\n" if isinstance(heading, str) else ""
            if held and size + tokens_of(text) > max_tokens:
                body = prefix + " ".join(held)
                yield doc_id, section, part, body, tokens_of(body)
                held, size, part = [], 0, part + 1
            held.append(text)
            size += tokens_of(text)
        body = prefix + " ".join(held)
        yield doc_id, section, part, body, tokens_of(body)

    prose = with_sections(items).filter("label = 'text'").select("doc_id", "section", "seq", "heading", "text")
    packed = walk_groups(prose, ["doc_id", "section"], ["seq"], pack, "doc_id long, section long, part int, text string, tokens int")
    return number_chunks(packed, "section", "part")


def number_chunks(chunks: DataFrame, *order: str) -> DataFrame:
    """Document-wide chunk numbers in the given order."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)


def table_rows(tables: DataFrame) -> DataFrame:
    """One chunk per row of ``tables`` (doc_id, seq, heading, caption, columns, rows): ``Row [label]: col=val, ...``; repeated columns are numbered."""
    c = F.col("columns")
    names = F.transform(c, lambda x, i: F.when(F.size(F.filter(F.slice(c, F.lit(1), i + 1), lambda y: y == x)) > 1, F.concat(x, F.lit(" ("), F.size(F.filter(F.slice(c, F.lit(1), i + 1), lambda y: y == x)).cast("string"), F.lit(")"))).otherwise(x))
    rows = tables.withColumn("names", names).select("doc_id", "seq", "heading", "caption", "names", F.posexplode("rows").alias("row", "cells"))
    pairs = F.zip_with(F.slice("names", F.lit(2), F.greatest(F.size("names") - 1, F.lit(0))), F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))), lambda n, v: F.concat(n, F.lit("="), v))
    line = F.concat(F.lit("Row ["), F.coalesce(F.get("cells", F.lit(0)), F.lit("")), F.lit("]: "), F.array_join(pairs, ", "))
    text = F.concat_ws("\n", F.concat(F.lit("[Section: "), F.col("heading"), F.lit("]")), F.concat(F.lit("Table: "), F.col("caption")), line)
    return rows.select("doc_id", "seq", "row", text.alias("text"))


def figure_chunks(figures: DataFrame) -> DataFrame:
    """Section, caption and description lines; figures without a description give nothing."""
    text = F.concat_ws("\n", F.concat(F.lit("[Section: "), F.col("heading"), F.lit("]")), F.concat(F.lit("Figure: "), F.col("caption")), F.col("description"))
    return figures.filter("description <> ''").select("doc_id", "seq", text.alias("text"))


def page_batches(docs: DataFrame, size: int = 5) -> DataFrame:
    """Work units (doc_id, first_page, end_page) of documents with ``n_pages``."""
    starts = docs.filter("n_pages > 0").select("doc_id", "n_pages", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pages").cast("long") - 1, F.lit(size).cast("long"))).alias("first_page"))
    return starts.select("doc_id", "first_page", F.least(F.col("first_page") + size, F.col("n_pages")).cast("long").alias("end_page"))


def drop_boilerplate(blocks: DataFrame, share: float = 0.5, least: int = 3) -> DataFrame:
    """``blocks`` (doc_id, page, block) without those on at least max(3, half) of a document's pages."""
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"))
    often = blocks.groupBy("doc_id", F.md5("block").alias("h")).agg(F.count_distinct("page").alias("n"))
    bad = often.join(pages, "doc_id").filter((F.col("n_pages") >= least) & (F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("n_pages") * share))))
    return blocks.withColumn("h", F.md5("block")).join(bad, ["doc_id", "h"], "left_anti").drop("h")


def recover_pages(attempts: DataFrame) -> DataFrame:
    """The text of the first stage that worked per page (doc_id, page, stage, ok, text); lost pages have none."""
    ok = F.col("ok")
    return attempts.groupBy("doc_id", "page").agg(F.min_by(F.when(ok, F.col("text")), F.when(ok, F.col("stage"))).alias("text"), F.min(F.when(ok, F.col("stage"))).alias("stage"), (~F.bool_or("ok")).alias("lost"))
