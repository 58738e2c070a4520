"""Stored index: repeated chunks, what a write leaves behind, and numbers from the forward table."""

import os

from pyspark.sql import functions as F

from corpusengine.operators.stored_index import StoredIndex
from corpusengine.session import scratch_dir

CHUNKS = "tenant string, doc_id long, chunk_index int, text string"


def test_repeated_chunks_go_as_often_as_they_came_and_writes_leave_no_scratch(spark, tmp_path):
    folder = scratch_dir(spark).removeprefix("file://")
    index = StoredIndex(spark, str(tmp_path / "index"), buckets=2)
    before = set(os.listdir(folder))
    index.write(spark.createDataFrame([("a", 1, 0, "One two"), ("a", 2, 0, "one é"), ("a", 2, 0, "one é"), ("a", 3, None, "..."), ("b", 9, 0, None)], CHUNKS))
    assert {(r["tenant"], r["term"], r["doc_id"]): r["tf"] for r in index.postings().collect()} == {("a", "one", 1): 1, ("a", "two", 1): 1, ("a", "one", 2): 2, ("a", "é", 2): 2}
    assert {tuple(r) for r in index.sizes().collect()} == {("a", 4, 6)}
    assert {r["tenant"]: r["n"] for r in index.stats().collect()} == {"a": 4, "b": 1}
    index.write(spark.createDataFrame([("a", 4, 0, "new")], CHUNKS), spark.createDataFrame([("a", 2)], "tenant string, doc_id long"))
    assert {(r["term"], r["df"]) for r in index.frequencies().collect()} == {("one", 1), ("two", 1), ("new", 1)}
    assert {tuple(r) for r in index.sizes().collect()} == {("a", 3, 3)}
    assert index.stats().filter("tenant = 'a'").select("n", F.round("avgdl", 6)).first()[:] == (3, 1.0)
    # what is left of the merged rows is the first write's only
    assert len(set(os.listdir(folder)) - before) == 0
