"""Stored keyword index and vector index against exhaustive search and rebuilds."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusengine.operators import stored_index
from corpusengine.operators.index import build_index, keyword_search
from corpusengine.operators.retrieval import vector_search
from corpusengine.operators.stored_index import StoredIndex
from corpusengine.operators.vector_index import VectorIndex, recall

CHUNKS = "tenant string, doc_id long, chunk_index int, text string"


def text(r):
    return " ".join(f"t{min(int(r.expovariate(0.12)), 60)}" for _ in range(r.randrange(0, 60)))


def test_upkeep_equals_a_rebuild_and_search_equals_exhaustive_scores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_index, "BLOCK", 20)
    r = random.Random(8)
    state = {("a" if i % 3 else "b", i): [text(r) for _ in range(r.randrange(1, 4))] for i in range(150)}
    frame = lambda docs: spark.createDataFrame([(t, d, k, x) for (t, d), xs in docs.items() for k, x in enumerate(xs)], CHUNKS)
    index = StoredIndex(spark, str(tmp_path / "index"), buckets=4)
    index.write(frame(state).unionByName(spark.createDataFrame([(None, 1, 0, "x"), ("a", None, 0, "x")], CHUNKS)))
    for turn in range(2):
        gone = r.sample(sorted(state), 12) + [("a", 999_999)]
        new = {k: [text(r)] for k in r.sample(sorted(state), 10)} | {("c", 1000 + turn): [text(r), None]}
        index.write(frame(new), spark.createDataFrame(gone, "tenant string, doc_id long"))
        state = {k: v for k, v in state.items() if k not in gone} | new
        if turn:
            index.compact()
            assert len(index.segments()) == 1
    chunks = frame(state).cache()
    postings, terms, stats = build_index(chunks)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    assert same(postings, index.postings()) and same(terms, index.frequencies())
    assert same(stats.select("tenant", "n", F.round("avgdl", 9).alias("a")), index.stats().select("tenant", "n", F.round("avgdl", 9).alias("a")))
    asked = [(i, r.choice("abcx"), f"t{r.randrange(8)} t{r.randrange(60)} t0", None) for i in range(25)] + [(90, "a", "", None), (91, "a", "t1 t2", sorted(d for t, d in state if t == "a")[3])]
    queries = spark.createDataFrame(asked, "query_id long, tenant string, text string, document_id long")
    want, got = (sorted(map(tuple, x.collect())) for x in (keyword_search(queries, chunks, 3), index.search(queries, 3)))
    assert got == want


def test_blocks_are_skipped_and_only_asked_buckets_are_read(spark, tmp_path):
    rows = [("a", i, 0, "common " * (8 if i < 5 else 1) + "word " * 30) for i in range(400)]
    index = StoredIndex(spark, str(tmp_path / "index"), buckets=8)
    index.write(spark.createDataFrame(rows, CHUNKS))
    weighted = spark.createDataFrame([(1, "a", "common", 1.0, 31.0)], "query_id long, tenant string, term string, idf double, avgdl double")
    scoped = spark.createDataFrame([(1, "a", None)], "query_id long, tenant string, document_id long")
    needed = {r["needed"] for r in index.needed_blocks(weighted, scoped, 5).collect()}
    assert needed == {True, False}
    assert [r["doc_id"] for r in index.search(spark.createDataFrame([(1, "a", "common")], "query_id long, tenant string, text string"), 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_a_failed_write_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    index = StoredIndex(spark, str(tmp_path / "index"), buckets=2)
    index.write(spark.createDataFrame([("a", 1, 0, "one two")], CHUNKS))
    before = sorted(map(tuple, index.postings().collect()))
    with monkeypatch.context() as m:
        m.setattr(StoredIndex, "stats", None)
        m.setattr(stored_index, "gain", lambda *a: F.raise_error(F.lit("stop")).cast("double"))
        with pytest.raises(Exception, match="stop"):
            index.write(spark.createDataFrame([("a", 1, 0, "three")], CHUNKS))
    assert index.segments() == [1] and sorted(map(tuple, index.postings().collect())) == before
    index.write(spark.createDataFrame([("a", 1, 0, "three")], CHUNKS))
    assert [r["term"] for r in index.postings().collect()] == ["three"]


def vectors(spark, ids=str):
    r = np.random.default_rng(5)
    centers = r.normal(size=(12, 16))
    rows = [(ids(i), "ab"[i % 2], [float(x) for x in centers[i % 12] + 0.4 * r.normal(size=16)]) for i in range(600)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 3, [None] * 16]
    kind = "string" if ids is str else "long"
    return spark.createDataFrame(rows + [(ids(9000 + k), "a", v) for k, v in enumerate(odd)] + rows[:1], f"doc_id {kind}, tenant string, embedding array<double>")


@pytest.mark.parametrize("ids", [str, int])
def test_vector_index_equals_exact_search_with_all_cells(spark, tmp_path, capsys, ids):
    table = vectors(spark, ids)
    index = VectorIndex.build(table, str(tmp_path / uuid.uuid4().hex), cells=16)
    queries = table.filter("cast(doc_id as int) % 20 = 0").select(F.col("doc_id").alias("query_id"), "tenant", "embedding").distinct()
    exact = vector_search(queries, table, 5)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    assert rows(index.search(queries, 5, probes=16)) == rows(exact)
    few = index.search(queries, 5, probes=3)
    assert recall(few, exact).first()["recall"] >= 0.9
    assert index.search(queries.limit(0), 5).count() == 0
    assert {r["cell"] for r in index.rows(spark, [1, 2]).select("cell").distinct().collect()} == {1, 2}
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    index.rows(spark, [1]).explain("formatted")
    assert "PartitionFilters: [isnotnull(cell" in capsys.readouterr().out
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_vector_search_of_one_document_and_of_nothing(spark, tmp_path):
    table = vectors(spark, int).withColumn("document_id", F.col("doc_id") % 7)
    queries = table.filter("doc_id < 10").select(F.col("doc_id").alias("query_id"), "tenant", "embedding", F.when(F.col("doc_id") % 2 == 0, F.lit(3)).cast("long").alias("document_id")).distinct()
    index = VectorIndex.build(table, str(tmp_path / "v"), cells=9)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    exact = vector_search(queries, table, 4)
    assert rows(index.search(queries, 4, probes=9)) == rows(exact)
    assert exact.filter("query_id % 2 = 0 and doc_id % 7 <> 3").count() == 0
    # ids of 54 bits stay apart next to nulls, and rows without ids are left out
    big = 9007199254740992
    twins = spark.createDataFrame([(big + k, "a", [1.0, 0.1 * k], None if k == 3 else big + k) for k in range(4)] + [(None, "a", [1.0, 0.0], 1)], "doc_id long, tenant string, embedding array<double>, document_id long")
    asked = spark.createDataFrame([(big + 1, "a", [1.0, 0.0], big + 1), (big + 2, "a", [1.0, 0.0], None), (None, "a", [1.0, 0.0], None)], "query_id long, tenant string, embedding array<double>, document_id long")
    want = sorted([(big + 1, big + 1, 1)] + [(big + 2, big + k, k + 1) for k in range(3)])
    for found in (vector_search(asked, twins, 3), VectorIndex.build(twins, str(tmp_path / "twins"), cells=2).search(asked, 3, probes=2)):
        assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in found.collect()) == want
    empty = VectorIndex.build(table.limit(0), str(tmp_path / "none"))
    assert empty.search(queries, 4).count() == 0 and vector_search(queries, table.limit(0), 4).count() == 0 and vector_search(queries.limit(0), table, 4).count() == 0


def test_recall_of_the_given_vectors(spark):
    """Queries are all rows whose id is divisible by 20, against all rows."""
    from corpusengine.plans.corpus import vector_index_search, vector_topk

    folder = "/root/testdata/sf0.01"
    assert recall(vector_index_search(spark, folder), vector_topk(spark, folder)).first()["recall"] >= 0.9


def test_walks_keep_keys_as_they_are(spark):
    from corpusengine.streaming.sessions import cache_hits

    big = 9007199254740993
    rows = [(big, 1, "2024-01-01 00:00:00"), (big, 2, "2024-01-01 00:10:00"), (big - 1, 3, "2024-01-01 00:20:00"), (None, 4, "2024-01-01 00:00:00"), (None, 5, "2024-01-01 00:05:00"), (big, 6, None)]
    df = spark.createDataFrame(rows, "key long, request_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {r["request_id"]: (r["key"], r["hit"]) for r in cache_hits(df).collect()} == {1: (big, False), 2: (big, True), 3: (big - 1, False), 4: (None, False), 5: (None, True), 6: (big, False)}
