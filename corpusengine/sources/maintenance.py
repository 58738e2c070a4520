"""Table maintenance: replay-safe upserts, deletes, ingestion accounting, status."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusengine.functions.text import first_true, point_id

STALE = "INTERVAL 10 MINUTES"


def with_point_ids(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("id", point_id(F.col("doc_id"), F.col("chunk_index")))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows replace ``existing`` ones of equal keys; a replay changes nothing."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_documents(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of a document that comes again are dropped, then the new ones appended."""
    return upsert(existing, new, ["tenant", "doc_id"])


def delete_documents(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Tenant and document must both match."""
    return rows.join(tombstones.select("tenant", "doc_id").distinct(), ["tenant", "doc_id"], "left_anti")


def reuploads(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The latest document of each (tenant, filename), and the tombstones of the older ones."""
    w = Window.partitionBy("tenant", "filename").orderBy(F.desc("created_at"), F.desc("doc_id"))
    ranked = registry.withColumn("_n", F.row_number().over(w))
    return ranked.filter("_n = 1").drop("_n"), ranked.filter("_n > 1").drop("_n")


def pair_embeddings(chunks: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with their vectors, and keys that stand on one side only; nothing is cut to the shorter side."""
    keys = ["doc_id", "chunk_index"]
    met = chunks.withColumn("_c", F.lit(True)).join(embeddings.withColumn("_e", F.lit(True)), keys, "full")
    whole = met.filter("_c and _e").drop("_c", "_e")
    return whole, met.filter("_c is null or _e is null").select(*keys, F.when(F.col("_c").isNull(), "no chunk").otherwise("no embedding").alias("reason"))


def write_report(rows: DataFrame, size: int = 100) -> DataFrame:
    """Per document and batch of ``size`` chunks: stored, failed, failed chunk numbers (column ``ok``)."""
    batch = F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1) / size)
    return rows.withColumn("batch", batch).groupBy("doc_id", "batch").agg(F.count_if("ok").alias("stored"), F.count_if(~F.col("ok")).alias("failed"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("chunk_index")))).alias("failed_chunks"))


def latest_preferences(writes: DataFrame) -> DataFrame:
    """(tenant, key): last value and time of writing, first time of writing."""
    return writes.groupBy("tenant", "key").agg(F.max_by("value", "ts").alias("value"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def update_columns(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Non-null columns of ``changes`` replace those of ``rows``."""
    names = [c for c in changes.columns if c != key]
    met = rows.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in names]), key, "left")
    return met.withColumns({c: F.coalesce(f"_{c}", c) if c in rows.columns else F.col(f"_{c}") for c in names}).drop(*[f"_{c}" for c in names])


def embed(chunks: DataFrame, embed_fn: Callable[[list[str]], list[list[float] | None]], tries: int = 3, base_delay: float = 0.0) -> DataFrame:
    """``chunks`` with ``embedding`` and ``error``: a batch goes in one call; if that fails, each text is tried on its own.

    A text that fails ``tries`` times, after pauses of ``base_delay`` seconds that double, gets a null vector.
    """
    schema = f"{chunks._jdf.schema().toDDL()}, embedding ARRAY<DOUBLE>, error STRING"

    def alone(text: str) -> tuple[list[float] | None, str | None]:
        import time

        error = None
        for k in range(tries):
            if k and base_delay:
                time.sleep(base_delay * 2 ** (k - 1))
            try:
                return embed_fn([text])[0], None
            except Exception as e:  # noqa: BLE001  the item's failure is data here
                error = repr(e)
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            texts = list(df["text"])
            try:
                vectors = embed_fn(texts)
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                done = [(v, None) for v in vectors]
            except Exception:  # noqa: BLE001  what failed shows text by text
                done = [alone(t) for t in texts]
            yield df.assign(embedding=[v for v, _ in done], error=[e for _, e in done])

    return chunks.mapInPandas(run, schema)


def ingestion_summary(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, tokens, floor of the mean, failures of embedding or storing and their union."""
    failed = F.col("embed_failed") | F.col("store_failed")
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("tokens").alias("n_tokens"), F.floor(F.sum("tokens") / F.count("*")).alias("mean_tokens"), F.count_if(failed).alias("n_failed"), F.sort_array(F.collect_set(F.when(failed, F.col("chunk_index")))).alias("failed_chunks"))


def final_status(n_failed: Column, n_page_errors: Column, n_stored: Column) -> Column:
    return first_true([((n_failed == 0) & (n_page_errors == 0), "processed"), (n_stored > 0, "processed_with_gaps")], "failed")


def is_stale(status: Column, started_at: Column, as_of: Column) -> Column:
    return F.coalesce((status == "processing") & (started_at < as_of - F.expr(STALE)), F.lit(False))


def reconcile(registry: DataFrame, as_of: Column) -> DataFrame:
    stale = is_stale(F.col("status"), F.col("started_at"), as_of)
    return registry.withColumn("processing_error", F.when(stale, "stale: no progress for 10 minutes").otherwise(F.col("processing_error"))).withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def retry_eligible(status: Column, stale: Column) -> tuple[Column, Column]:
    ok = status.isin("failed", "processed_with_gaps") | ((status == "processing") & stale)
    return ok, F.when(~ok, F.when(status == "processing", "still processing").otherwise("nothing to retry"))


def retain(rows: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return rows.filter(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))


def write_reports(samples: DataFrame, report: DataFrame, folder: str, run: str) -> None:
    """Per-sample CSV and one JSON report with its time, under the name of the run; earlier runs stay."""
    samples.write.mode("errorifexists").csv(f"{folder}/samples/run={run}", header=True)
    report.withColumn("timestamp", F.current_timestamp()).write.mode("errorifexists").json(f"{folder}/report/run={run}")


def append_summaries(summaries: DataFrame, path: str) -> None:
    """Session summaries (tenant, session, summary, topics) appended with the time of writing."""
    summaries.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)
