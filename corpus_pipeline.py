"""Corpus pipeline: what is kept of a document table, stage by stage.

Each stage reads all that its predecessor kept, written as Parquet in between, so a lost
executor costs no more than the stage at work. Stages but the last return the columns of
``documents``; the last one adds the token ids of every document that stays. A stage reads
its operator's verdicts as a thin table keyed by the rows' places, and applies them where
the rows lie; no text is shuffled for it.

Defined results are those of the operators: null texts count as empty (and fall to the
quality rules), every row is judged by itself, and of rows repeated with id and text the
first one stays after exact dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusengine.llm.byte_bpe import encode_and_decode
from corpusengine.llm.exact_dedup import exact_dedup
from corpusengine.llm.jaccard_join import jaccard_join
from corpusengine.llm.mixing import mix
from corpusengine.llm.quality_rules import judge_documents
from corpusengine.llm.queries import multilingual_bpe
from corpusengine.llm.rows import decide
from corpusengine.session import materialize, table


def kept(judged: DataFrame, at: tuple[str, str]) -> DataFrame:
    """Place and copies of each row: one where it is kept, none else."""
    return judged.select(*at, F.col("kept").cast("int").alias("copies"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, or their host's record, reject go."""
    return decide(docs, lambda marked, at: kept(judge_documents(marked), at))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return decide(docs, lambda marked, at: kept(exact_dedup(marked, carry=at), at))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of connected near duplicates stays."""
    return decide(docs, lambda marked, at: kept(jaccard_join(marked, at=at), at))


def with_copies(mixed: DataFrame) -> DataFrame:
    """``mixed`` with ``copies``: how often a document is to be seen, by its rate.

    A rate counts relative to the mean rate of good tokens. Documents that are more likely
    good than not stay, at least once; of the others the whole part of a rate is certain and
    the rest is drawn by the hash of id and text, so toxic ones are thinned, and documents of
    a domain that is short of tokens are seen again.
    """
    good = F.col("n_tokens") * F.col("p_good")
    one = mixed.agg(F.sum(good * F.col("rate")) / F.sum(good)).first()[0] or 1.0
    rate = F.col("rate") / one
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("mixing"), "doc_id", "text_key"), 11) / float(1 << 53)
    drawn = F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")
    return mixed.withColumn("copies", F.when(F.col("p_good") > 0.5, F.greatest(F.floor(rate), F.lit(1))).otherwise(drawn).cast("int"))


def thinned(mixed: DataFrame) -> DataFrame:
    """The rows of ``mixed`` as often as they are seen, with ``kept``; those not seen once, not kept."""
    rows = with_copies(mixed).withColumn("kept", F.col("copies") > 0)
    return rows.withColumn("_seen", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).drop("_seen")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are thinned and repeated to the target weights by their fitted rates."""
    labels = table(spark, sf_dir, "labels")
    return decide(docs, lambda marked, at: with_copies(mix(marked, labels, carry=at)).select(*at, "copies"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and proof that they decode to the text."""
    codec = multilingual_bpe(spark)
    out = encode_and_decode(docs, codec)
    return out.select(*[c for c in docs.columns if c not in ("text", "ids", "n_tokens", "decoded_sha256")], "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_copies),
    ("n-gram jaccard join", near_copies),
    ("mixing to target weights", mixing),
    ("byte-level bpe", encoding),
]

#: SQL cannot express connected components of near copies, the fit or the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
