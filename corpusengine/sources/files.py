"""Scans of files, golden sets and routing tests; admission of uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = ("pdf", "docx", "txt", "csv")
PARSED = ("txt", "csv")
MAX_BYTES = 50 * 1024 * 1024
#: Marks of items that a golden set's author has not filled in yet.
PLACEHOLDERS = "REPLACE|SET_AFTER"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): each file as one string."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def csv_as_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): header line ``HEADERS: a | b``, then one line of cells a row, each with its newline.

    Quoted cells may hold commas, doubled quotes and line breaks; blank lines are left out, and so are empty files.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("raw"))
    cell = r'("(?:[^"]++|"")*+"|[^,\r\n]*+)(,|\r?\n|$)'
    part = lambda k: F.regexp_extract_all("raw", F.lit(cell), F.lit(k))
    cells = files.select("path", F.arrays_zip(part(1).alias("text"), part(2).alias("mark")).alias("c"))
    before = lambda i: F.coalesce(F.get("c", i - 1)["mark"], F.lit("\n"))
    blank = lambda x, i: (x["text"] == "") & (x["mark"] != ",") & (before(i) != ",")
    bare = lambda t: F.when(t.startswith('"'), F.replace(F.regexp_replace(t, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(t)
    shown = F.transform("c", lambda x, i: F.when(blank(x, i), "").otherwise(F.concat(bare(x["text"]), F.when(x["mark"] == ",", " | ").otherwise("\n"))))
    content = F.array_join(shown, "")
    return cells.select("path", F.when(content != "", F.concat(F.lit("HEADERS: "), content)).otherwise("").alias("content"))


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def admit_uploads(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected uploads (filename, size_bytes), the latter with a reason."""
    name = F.col("filename")
    reason = F.when(name.isNull() | (name == ""), "null_name").when(~name.contains(".") | ~extension(name).isin(*TYPES), "bad_type").when(F.col("size_bytes") > MAX_BYTES, "too_large")
    judged = files.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def dispatch(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose format can be parsed here, with ``format``, and the others."""
    kind = extension(F.col("path"))
    typed = files.withColumn("format", kind)
    return typed.filter(kind.isin(*PARSED)), typed.filter(~kind.isin(*PARSED))


def stored_chunks(chunks: DataFrame) -> DataFrame:
    """What a keyword index is rebuilt from: no vectors, no chunks without tenant or text."""
    return chunks.filter("tenant is not null and text <> ''").select("tenant", "doc_id", "chunk_index", "text")


def golden_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Items of a golden set file (a list, or an object with ``items``), and those left out for placeholders."""
    raw = spark.read.json(path, multiLine=True)
    items = raw.select(F.explode("items").alias("i")).select("i.*") if "items" in raw.columns else raw
    typed = items.filter("type is not null")
    open_ = F.to_json(F.struct("*")).rlike(PLACEHOLDERS)
    return typed.filter(~open_), typed.filter(open_)


def routing_tests(spark: SparkSession, path: str, prefix: str = "PLAN_") -> DataFrame:
    raw = spark.read.json(path, multiLine=True)
    t = raw.select(F.explode("tests").alias("t")).select("t.*").filter(F.col("id").startswith(prefix))
    return t.select("id", "question", F.col("expected_planner_decision.source").alias("expected_source"), F.col("expected_planner_decision.tool").alias("expected_tool"), F.col("must_not_select").alias("forbidden"), F.lower(F.regexp_extract("id", r"^[A-Z]+_([A-Z]+)", 1)).alias("category"))


def latest_pages(listing: DataFrame, tenant: str, skip: int = 0, n: int = 20) -> DataFrame:
    """One page of a tenant's documents, newest first."""
    return listing.filter(F.col("tenant") == tenant).orderBy(F.desc("created_at"), "doc_id").offset(skip).limit(n)


def pages_per_tenant(listing: DataFrame, skip: int = 0, n: int = 20) -> DataFrame:
    w = Window.partitionBy("tenant").orderBy(F.desc("created_at"), "doc_id")
    return listing.withColumn("place", F.row_number().over(w)).filter((F.col("place") > skip) & (F.col("place") <= skip + n))
