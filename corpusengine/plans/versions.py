"""Queries over versioned tables: replacement, purge over several tables, retention by partition."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusengine.session import scratch_dir, table
from corpusengine.sources.versions import VersionedTable, purge

KEYS = ["tenant", "doc_id"]


def versioned(spark: SparkSession, by: str) -> VersionedTable:
    return VersionedTable(spark, f"{scratch_dir(spark)}/{uuid.uuid4().hex}", by)


def replaced_and_purged(spark: SparkSession, d: str) -> DataFrame:
    """Documents and their vectors: good documents written anew, twice by one batch, then toxic ones purged from both tables."""
    by = "pmod(xxhash64(tenant, doc_id), 16)"
    docs, vectors = versioned(spark, by), versioned(spark, by)
    rows = table(spark, d, "documents").select(F.col("source").alias("tenant"), "doc_id", "n_chars")
    labels = table(spark, d, "labels").join(rows, "doc_id")
    docs.upsert(rows, KEYS)
    vectors.upsert(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label").join(rows.select(*KEYS), "doc_id"), KEYS)
    for _ in range(2):
        docs.upsert(labels.filter("quality = 1").select(*KEYS, (F.col("n_chars") + 1).alias("n_chars")), KEYS, batch="good")
    purge([docs, vectors], labels.filter("toxic = 1"), KEYS, batch="toxic")
    return docs.read().join(vectors.read(), KEYS, "full").select("tenant", "doc_id", "n_chars", "label")


REPLACED = """WITH d AS (SELECT source AS tenant, doc_id, n_chars FROM documents), v AS (SELECT vec_id AS doc_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM d)),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT tenant, doc_id, CASE WHEN quality = 1 THEN n_chars + 1 ELSE n_chars END AS n_chars, v.label FROM d LEFT JOIN v USING (doc_id) LEFT JOIN l USING (doc_id) WHERE coalesce(toxic, 0) <> 1"""


def kept_days(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last seven days and of what came before them anew: older days leave the table as whole partitions."""
    events = versioned(spark, "to_date(ts)")
    rows = table(spark, d, "events")
    events.replace_partitions(rows.select("event_id", "user_id", "event_type", "ts"))
    last = rows.agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0]
    events.retain(f"part > date_sub('{last}', 7)")
    return events.read().groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


KEPT = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts::DATE > (SELECT max(ts)::DATE - 7 FROM events) GROUP BY ALL"

QUERIES = {"k_replaced_and_purged": (replaced_and_purged, REPLACED), "g_kept_days": (kept_days, KEPT)}
