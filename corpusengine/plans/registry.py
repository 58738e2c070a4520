"""All registered queries of the engine's own operators: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusengine.plans import corpus, judged, lists, runlog, versions

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.keyword_topk(spark, sf_dir)


def _all() -> dict[str, tuple[Query, str | None]]:
    return {**corpus.QUERIES, **runlog.QUERIES, **lists.QUERIES, **judged.QUERIES, **versions.QUERIES}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s is not None}
