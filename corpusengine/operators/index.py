"""Keyword index: postings per tenant, BM25+ scores, top-k.

A chunk that shares no term with a query still scores the floor, the sum of idf * delta, so
it can fill the top-k. Candidates are the matching chunks and the first k chunks of the
scope: with fewer than k matches those hold enough unmatched ones, so no cross join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusengine.functions.similarity import stems
from corpusengine.functions.text import words
from corpusengine.session import materialize

K1, B, DELTA = 1.5, 0.75, 1.0


def _terms(df: DataFrame, text: str, keep: list[str], stem: bool) -> DataFrame:
    """``keep``, term and dl (number of words of the text), a row per word; a text without words has one row with a null term."""
    terms = df.select(*keep, words(F.col(text)).alias("ws")).select(*keep, F.size("ws").cast("long").alias("dl"), F.explode_outer("ws").alias("term"))
    if not stem:
        return terms
    return terms.join(stems(terms), "term", "left").drop("term").withColumnRenamed("stem", "term")


def build_index(chunks: DataFrame, stem: bool = False, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``chunks`` (tenant, doc_id, chunk_index, text) as postings (tenant, term, doc_id, chunk_index, tf, dl),
    terms (tenant, term, df) and stats (tenant, n, avgdl).

    With ``only`` (tenant, term) no other terms are counted; where that table is small,
    Catalyst broadcasts it and words that nobody asks for are never shuffled.
    """
    key = ["tenant", "doc_id", "chunk_index"]
    every = _terms(chunks, "text", key, stem).filter("term is not null")
    wanted = every if only is None else every.join(only, ["tenant", "term"], "left_semi")
    postings = wanted.groupBy(*key, "term", "dl").agg(F.count("*").alias("tf"))
    stats = chunks.groupBy("tenant").agg(F.count("*").alias("n"), F.avg(F.size(words(F.col("text")))).alias("avgdl"))
    terms = postings.groupBy("tenant", "term").agg(F.count("*").alias("df"))
    return postings, terms, stats


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int = 10, stem: bool = False) -> DataFrame:
    """Top ``k`` of each query (query_id, tenant, text, optional document_id): query_id, tenant, doc_id, chunk_index, score, rank.

    The document scope narrows candidates only; statistics stay those of the tenant.
    """
    if "document_id" not in queries.columns:
        queries = queries.withColumn("document_id", F.lit(None).cast("long"))
    asked = _terms(queries, "text", ["query_id", "tenant"], stem).filter("term is not null").groupBy("query_id", "tenant", "term").agg(F.count("*").alias("qtf"))
    postings, terms, stats = build_index(chunks, stem, materialize(asked.select("tenant", "term").distinct()))
    postings = materialize(postings)
    terms = postings.groupBy("tenant", "term").agg(F.count("*").alias("df"))
    weighted = asked.join(terms, ["tenant", "term"]).join(stats, "tenant").withColumn("idf", F.col("qtf") * F.log((F.col("n") + 1) / F.col("df")))
    floor = weighted.groupBy("query_id", "tenant").agg(F.sum(F.col("idf") * DELTA).alias("floor"))
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl")) + F.col("tf")
    matched = weighted.join(postings, ["tenant", "term"]).groupBy("query_id", "tenant", "doc_id", "chunk_index").agg(F.sum(F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("gain"))
    scoped = queries.select("query_id", "tenant", "document_id")
    first = chunks.select("tenant", "doc_id", "chunk_index").withColumn("r", F.row_number().over(Window.partitionBy("tenant").orderBy("doc_id", "chunk_index"))).filter(F.col("r") <= k).drop("r")
    wide = scoped.filter("document_id is null").join(first, "tenant").select("query_id", "tenant", "doc_id", "chunk_index")
    inside = chunks.select("tenant", "doc_id", "chunk_index").withColumn("r", F.row_number().over(Window.partitionBy("tenant", "doc_id").orderBy("chunk_index"))).filter(F.col("r") <= k).drop("r")
    narrow = scoped.join(inside, (scoped["tenant"] == inside["tenant"]) & (scoped["document_id"] == inside["doc_id"])).select("query_id", inside["tenant"], "doc_id", "chunk_index")
    fill = wide.unionByName(narrow).withColumn("gain", F.lit(0.0))
    all_of = matched.unionByName(fill).groupBy("query_id", "tenant", "doc_id", "chunk_index").agg(F.max("gain").alias("gain"))
    scored = all_of.join(floor, ["query_id", "tenant"]).join(scoped, ["query_id", "tenant"]).filter("document_id is null or document_id = doc_id").withColumn("score", F.round(F.col("gain") + F.col("floor"), 6)).filter("score > 0")
    w = Window.partitionBy("query_id", "tenant").orderBy(F.desc("score"), "doc_id", "chunk_index")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "tenant", "doc_id", "chunk_index", "score", "rank")
