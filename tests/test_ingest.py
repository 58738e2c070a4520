"""Streams into tables, stopped and replayed."""

import pytest
from pyspark.sql import functions as F

from corpusengine.sources import files
from corpusengine.streaming import ingest


def put(folder, name, size):
    (folder / name).write_bytes(b"x" * size)


def test_a_replayed_batch_is_stored_once(spark, tmp_path):
    come, to, state = tmp_path / "come", str(tmp_path / "to"), str(tmp_path / "state")
    come.mkdir()
    for k in range(5):
        put(come, f"a{k}.txt", k + 1)
    put(come, "b.exe", 3)
    stream = lambda: ingest.uploads(spark, f"file://{come}", files_per_batch=4)

    def breaks(batch):
        raise RuntimeError("the disk is full")

    # the first part of batch 0 is stored, then the query dies before the batch is done
    with pytest.raises(Exception, match="the disk is full"):
        ingest.store_batches(stream(), {"accepted": lambda b: files.admit_uploads(b)[0], "rejected": breaks}, to, state).awaitTermination(60)
    assert ingest.stored(spark, to, "accepted").count() > 0
    ingest.ingest_uploads(stream(), to, state).awaitTermination(60)
    for name in ("c.csv", "none", "d.PDF"):
        put(come, name, 1)
    ingest.ingest_uploads(stream(), to, state).awaitTermination(60)
    ingest.ingest_uploads(stream(), to, state).awaitTermination(60)

    every = spark.createDataFrame([(p.name, p.stat().st_size) for p in come.iterdir() if p.suffix != ".crc"], "filename string, size_bytes long")
    good, bad = files.admit_uploads(every)
    name = ["filename", "size_bytes"]
    accepted, rejected = ingest.stored(spark, to, "accepted"), ingest.stored(spark, to, "rejected")
    assert sorted(map(tuple, accepted.select(*name).collect())) == sorted(map(tuple, good.select(*name).collect()))
    assert sorted(map(tuple, rejected.select(*name, "reason").collect())) == sorted(map(tuple, bad.select(*name, "reason").collect()))
    assert accepted.agg(F.count_distinct("batch")).first()[0] == 3


def test_audited_requests_are_stored_once(spark, tmp_path):
    schema = "request_id long, path string"
    source, to, state = str(tmp_path / "requests"), str(tmp_path / "to"), str(tmp_path / "state")
    for k in range(3):
        spark.createDataFrame([(k, "/api/documents/1"), (k + 10, "/health"), (k + 20, None)], schema).coalesce(1).write.mode("append").parquet(source)
        ingest.store_audit(spark.readStream.schema(schema).parquet(source), ["/api/documents"], to, state).awaitTermination(60)
    assert sorted(r["request_id"] for r in ingest.stored(spark, to, "audit").collect()) == [0, 1, 2]
