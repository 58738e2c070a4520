"""Registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from pyspark.sql import functions as F

from corpusengine.llm import oracles
from corpusengine.llm.alignment import align_documents
from corpusengine.llm.byte_bpe import ByteBpe, encode_and_decode
from corpusengine.llm.exact_dedup import exact_dedup
from corpusengine.llm.fill_middle import fill_in_middle, restore
from corpusengine.llm.jaccard_join import jaccard_join
from corpusengine.llm.license_scan import scan_licenses
from corpusengine.llm.mixing import mix_with_fit
from corpusengine.llm.quality_rules import judge_documents
from corpusengine.llm.suffix_dedup import suffix_dedup
from corpusengine.llm.token_files import documents_of, token_ids, write_files
from corpusengine.llm.tool_calls import REPLY, calls_of_turns, link_calls
from corpusengine.llm.toxicity import score_documents, train
from corpusengine.llm.url_filter import judge_pages
from corpusengine.session import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("n_blocks")


def op2_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(*calls_of_turns(table(spark, sf_dir, "conversations")), REPLY)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("possibly_repeated")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tokens = token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    files = write_files(tokens, docs.select(F.col("doc_id").cast("long").alias("doc_id")))
    return documents_of(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def multilingual_bpe(spark: SparkSession) -> ByteBpe:
    return ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = multilingual_bpe(spark)
    docs = encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), codec)
    return docs.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, fit = mix_with_fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.drop("text_key").withColumns({"pull": F.lit(fit.pull), "converged": F.lit(fit.converged), "reached": F.lit(fit.reached)})


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels"), learn_from=~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_license_scan, op2_chat_tool_calls, op3_jaccard_join, op4_exact_dedup, op5_url_filter, op6_quality_rules, op7_token_files, op8_suffix_dedup, op9_byte_bpe, op10_mixing, op11_fill_middle, op12_token_alignment, op13_toxicity]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": oracles.license_scan(),
        "op2_chat_tool_calls": oracles.TOOL_CALLS,
        "op4_exact_dedup": oracles.EXACT_DEDUP,
        "op5_url_filter": oracles.url_filter(),
        "op6_quality_rules": oracles.quality_rules(),
        "op11_fill_middle": oracles.FILL_MIDDLE,
    }
