"""Partitioned vector index: coarse cells, a table partitioned by cell, search in the nearest cells.

Centroids are fitted on a bounded sample (the ``SAMPLE`` smallest hashes of ids), by rounds
of spherical k-means; every row is assigned to its nearest centroid and written to the
partition of that cell. Cells of many rows are cut into blocks by the hash of the id. A
query goes to its nearest cells; queries meet the blocks of a cell in one shuffle, each
block gives its own best rows by exact cosine, and the best of those are the answer. Only
the partitions of probed cells are read. With as many probes as cells the answer is exact.

Defined results: vectors that are null, of another dimension than most, without length, or
with an element that is null or no number are not indexed, and such queries find nothing;
nor are rows without an id, and queries without one find nothing; rows without a tenant are
found by queries without one; ids may have any type that can be compared; a query with a ``document_id`` finds rows of that document only; repeated rows are
found each; ties go to the smaller id. An empty table gives no hits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of the sample that centroids are fitted on, rounds of the fit, most cells.
SAMPLE, ROUNDS, MAX_CELLS = 20_000, 8, 4096
#: Rows of a block, and queries that a block meets at once.
BLOCK, PAGE = 4096, 16_384


def dimension_of(vectors: DataFrame) -> int:
    """The number of elements that most vectors have; 0 without vectors."""
    most = vectors.filter("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return most["n"] if most else 0


def usable(embedding: Column, dimension: int) -> Column:
    x = F.transform(embedding, lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.coalesce((F.size(embedding) == dimension) & sound, F.lit(False))


def unit_rows(column: pd.Series) -> np.ndarray:
    m = np.vstack(column.to_numpy()).astype(float)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def fit_centroids(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of at most ``sample`` rows; rows of one direction make one centroid."""
    rows = vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("embedding").toPandas()
    if not len(rows):
        return np.zeros((0, 0))
    m = np.unique(unit_rows(rows["embedding"]), axis=0)
    centers = m[np.random.default_rng(0).permutation(len(m))[:cells]]
    for _ in range(ROUNDS):
        own = (m @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, m)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centers)
    return centers


def nearest_cells(rows: DataFrame, centers: np.ndarray, n: int, column: str = "cells") -> DataFrame:
    """``rows`` with the numbers of the ``n`` nearest cells of their ``embedding``, nearest first."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    @F.pandas_udf("array<int>")
    def near(embedding: pd.Series) -> pd.Series:
        close = unit_rows(embedding) @ shared.value.T
        some = np.argpartition(-close, min(n, close.shape[1]) - 1, axis=1)[:, :n]
        order = np.take_along_axis(close, some, axis=1).argsort(axis=1, kind="stable")[:, ::-1]
        return pd.Series(list(np.take_along_axis(some, order, axis=1).astype(np.int32)))

    return rows.withColumn(column, near("embedding"))


@dataclass(frozen=True)
class VectorIndex:
    """A written index: its folder, centroids (at most ``MAX_CELLS``), and the rows of each cell."""

    path: str
    centers: np.ndarray
    sizes: dict[int, int]
    dimension: int

    @staticmethod
    def build(vectors: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
        """Writes ``vectors`` (doc_id, tenant, embedding, optional document_id) to ``path``; by default as many cells as the square root of the rows."""
        dimension = dimension_of(vectors)
        good = vectors.filter(usable(F.col("embedding"), dimension) & F.col("doc_id").isNotNull())
        if "document_id" not in good.columns:
            good = good.withColumn("document_id", F.col("doc_id"))
        good = good.select("doc_id", "tenant", "document_id", "embedding")
        cells = min(MAX_CELLS, cells or max(1, round(good.count() ** 0.5)))
        centers = fit_centroids(good, cells)
        if not len(centers):
            good.withColumn("cell", F.lit(0)).limit(0).write.parquet(path)
            return VectorIndex(path, centers, {}, dimension)
        placed = nearest_cells(good, centers, 1).withColumn("cell", F.get("cells", F.lit(0))).drop("cells")
        # a hot cell is dealt to several writers
        placed.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.partitionBy("cell").parquet(path)
        sizes = {r["cell"]: r["count"] for r in good.sparkSession.read.parquet(path).groupBy("cell").count().collect()}
        return VectorIndex(path, centers, sizes, dimension)

    def rows(self, spark: SparkSession, cells: list[int]) -> DataFrame:
        """What is stored in ``cells``; no other partition is read."""
        return spark.read.parquet(self.path).filter(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
        """Best ``k`` of each query (query_id, tenant, embedding, optional document_id) in its ``probes`` nearest cells: query_id, doc_id, score, rank."""
        spark = queries.sparkSession
        kinds = {f.name: f.dataType.simpleString() for f in (*spark.read.parquet(self.path).schema, queries.schema["query_id"])}
        schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"
        if not self.sizes:
            return spark.createDataFrame([], schema + ", rank int")
        if "document_id" not in queries.columns:
            queries = queries.withColumn("document_id", F.lit(None).cast(kinds["document_id"]))
        asked = queries.filter(usable(F.col("embedding"), self.dimension) & F.col("query_id").isNotNull()).select("query_id", "tenant", "document_id", "embedding")
        sent = nearest_cells(asked, self.centers, probes).withColumn("cell", F.explode("cells")).drop("cells")
        per_cell = {r["cell"]: r["count"] for r in sent.groupBy("cell").count().collect()}
        probed = sorted(c for c in per_cell if c in self.sizes)
        cuts = spark.createDataFrame([(c, -(-self.sizes[c] // BLOCK), -(-per_cell[c] // PAGE)) for c in probed], "cell int, blocks int, pages int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        sent = sent.join(F.broadcast(cuts), "cell").withColumn("page", part("query_id", "pages")).withColumn("block", each("blocks"))
        stored = self.rows(spark, probed).join(F.broadcast(cuts), "cell").withColumn("block", part("doc_id", "blocks")).withColumn("page", each("pages"))
        keys = ["cell", "block", "page"]

        def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            parts = []
            if len(q) and len(v):
                m, e = unit_rows(v["embedding"]), unit_rows(q["embedding"])
                doc, own, of = v["doc_id"].to_numpy(), v["tenant"].to_numpy(dtype=object), v["document_id"].to_numpy(dtype=object)
                # a number for each id in its order, as ids may be texts
                order = np.unique(doc, return_inverse=True)[1]
                ids, tenants, only = q["query_id"].to_numpy(), q["tenant"].to_numpy(dtype=object), q["document_id"].to_numpy(dtype=object)
                for i in range(len(ids)):
                    score = np.round(m @ e[i], 6)
                    allowed = own == tenants[i] if tenants[i] is not None else np.array([x is None for x in own])
                    if only[i] is not None:
                        allowed &= of == only[i]
                    some = np.flatnonzero(allowed)
                    top = some[np.lexsort((order[some], -score[some]))[:k]]
                    parts.append(pd.DataFrame({"query_id": np.repeat(ids[i : i + 1], len(top)), "doc_id": doc[top], "score": score[top]}))
            return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})

        # documents are compared as texts, since pandas turns whole numbers next to nulls into floats
        some = ["tenant", F.col("document_id").cast("string").alias("document_id"), "embedding"]
        found = sent.select("query_id", *some, *keys).groupBy(*keys).cogroup(stored.select("doc_id", *some, *keys).groupBy(*keys)).applyInPandas(best, schema)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n, hits, recall): how many of the exact hits (query_id, doc_id) were found."""
    met = exact.select("query_id", "doc_id").distinct().join(found.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return met.agg(F.count("*").alias("n"), F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("recall"))
