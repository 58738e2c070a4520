"""Joins with hot keys and connected components, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusengine.session import materialize


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Inner join of ``rows`` with one row per ``key`` of ``groups``, whose column ``size`` counts the rows.

    Groups with a thousandth of all rows or more are a thousand at most, so they are
    broadcast and their rows stay where they are; the other groups are small, so the
    shuffle by key has no hot task.
    """
    limit = max(n_rows // 1000, 16)
    names = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) >= limit).select(key, F.struct(*names).alias("_hot"))
    cold = groups.filter(F.col(size) < limit)
    met = rows.join(F.broadcast(hot), key, "left")
    of_hot = met.filter("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in names])
    of_cold = met.filter("_hot is null").drop("_hot").join(cold, key).select(*rows.columns, *names)
    return of_hot.unionByName(of_cold)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, root) of every vertex of ``edges`` (a, b): root is the smallest vertex of its component.

    Alternates large-star and small-star steps: each hangs neighbours on the smallest one
    known, so the depth shrinks by a constant factor a round. Every round is written, so
    lineage doesn't grow.
    """
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
