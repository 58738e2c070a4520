"""Stateful streams give what the batch forms give."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusengine.streaming import sessions

pytest.importorskip("google.protobuf")


def run(spark, tmp_path, df, processor, schema, name):
    source = str(tmp_path / name)
    df.coalesce(1).write.parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).parquet(source)
    query = sessions.stream(stream, df.columns[0], processor, schema).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, i, start + datetime.timedelta(seconds=t)) for k in ("a", "b") for i, t in enumerate((0, 10, 50, 65, 70))]
    df = spark.createDataFrame(rows, "key string, request_id long, ts timestamp")
    limited = run(spark, tmp_path, df, sessions.RateLimiter(2, 60), "key string, request_id long, allowed boolean", "limited")
    assert sorted(map(tuple, limited.collect())) == sorted(map(tuple, sessions.rate_limit(df, 2, 60).collect()))
    cached = run(spark, tmp_path, df, sessions.QueryCache(60), "key string, request_id long, hit boolean", "cached")
    assert sorted(map(tuple, cached.collect())) == sorted(map(tuple, sessions.cache_hits(df, 60).collect()))


def test_memory_stream_evicts_what_the_batch_form_drops(spark, tmp_path):
    rows = [(c, t, "user", "x" * (40 + 900 * (t % 3))) for c in (1, 2) for t in range(14)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    gone = run(spark, tmp_path, df, sessions.SessionMemory(), "conv_id long, turn long, role string", "memory")
    assert {(r["conv_id"], r["turn"]) for r in gone.collect()} == {(r["conv_id"], r["turn"]) for r in sessions.bounded_memory(df).filter("not kept").collect()}


def played(spark, tmp_path, name, batches, schema, build):
    """``batches`` come as one file each, read one file a batch; rows that ``build(stream)`` emits, and the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, state = tmp_path / name, str(tmp_path / f"{name}-state")
    query = lambda: build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", state).trigger(availableNow=True).start()
    for rows in batches:
        # every batch is a run of its own, so each continues from the checkpoint as after a restart
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        query().awaitTermination(120)
    return spark.read.parquet(str(tmp_path / f"{name}-out")), state


def test_session_timers_give_session_windows_and_leave_no_state(spark, tmp_path):
    start, rng = datetime.datetime(2024, 1, 1), random.Random(3)
    at = lambda h: start + datetime.timedelta(hours=h)
    batches = [[(1, at(30)), (1, at(0)), (2, at(5)), (2, at(5)), (3, at(1)), (3, at(25))], [(1, at(15)), (2, at(33)), (4, at(30)), (None, at(31)), (4, None)], [(k, at(40 + rng.randrange(40))) for k in (5, 6, 7) for _ in range(5)]]
    end = [(0, at(1000))]
    schema = "user_id long, ts timestamp"
    got, state = played(spark, tmp_path, "clock", [*batches, end, [(0, at(2000))], [(0, at(2001)), (9, at(3))]], schema, lambda s: sessions.session_stream(s, "user_id", delay="30 hours"))
    every = spark.createDataFrame([r for b in batches for r in b] + end, schema)
    want = sessions.sessions(every.filter("ts is not null"), "user_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    left = spark.read.format("statestore").option("path", state).option("stateVarName", "open").load()
    assert [tuple(r["key"]) for r in left.collect()] == [(0,)]


def test_memory_ends_a_day_after_the_last_message(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    at = lambda h: start + datetime.timedelta(hours=h)
    row = lambda c, t, h: (c, t, "user", "x" * 8, at(h))
    batches = [[row(1, t, t / 100) for t in range(9)] + [row(2, 0, 0)], [row(1, 9, 20), row(1, 10, 21)], [row(1, 11, 46)] + [row(3, t, 46) for t in range(3)], [row(4, 0, 200)], [row(4, 1, 201)]]
    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    build = lambda s: sessions.stream(s.withWatermark("ts", "1 hour").withColumn("us", F.unix_micros("ts")), "conv_id", sessions.SessionMemory(expires=sessions.SESSION_MICROS), "conv_id long, turn long, role string", event_time=True)
    gone, state = played(spark, tmp_path, "ending", batches, schema, build)
    # the eleventh message of conversation 1 pushes out the first; the twelfth comes 25 hours later and finds nothing
    assert [tuple(r) for r in gone.collect()] == [(1, 0, "user")]
    held = spark.read.format("statestore").option("path", state).option("stateVarName", "held").option("flattenCollectionTypes", "true").load()
    assert {tuple(r["key"])[0] for r in held.collect()} == {4}


def stepwise(messages):
    held, log = [], []
    for turn, role, text in messages:
        held.append((turn, role, text))
        size = lambda m: max(1, len(m[2]) // 4) if m[2] else 0
        gone = []
        while len(held) > 1 and (len(held) > 10 or sum(map(size, held)) > 1200):
            gone.append(held.pop(0))
        if gone:
            log.append((turn, "(unsummarized excerpt) " + "; ".join(": ".join(x for x in (r, None if t is None else t[:100]) if x is not None) for _, r, t in gone), len(gone)))
    return log


def test_evictions_by_step_equal_the_loop(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "word " * rng.randrange(1, 40), "x" * rng.randrange(1, 6000)])) for c in range(40) for t in range(rng.randrange(0, 45))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["evicted_at"], r["summary"], r["n_evicted"]) for r in sessions.eviction_log(df).collect()}
    assert got == {(c, *step) for c in range(40) for step in stepwise([r[1:] for r in rows if r[0] == c])}
    assert sum(n for *_, n in got) == sessions.bounded_memory(df).filter("not kept").count() > 100
    assert sessions.eviction_log(df.limit(0)).count() == 0


def test_a_failing_summary_costs_its_step_only(spark):
    df = spark.createDataFrame([(c, t, "user", f"turn {t} of {c}") for c in range(3) for t in range(12)], "conv_id long, turn long, role string, text string")

    def summarize(steps):
        if any("of 1" in line for step in steps for line in step):
            raise RuntimeError("no summary")
        return [f"{len(step)} lines" for step in steps]

    log = {(r["conv_id"], r["evicted_at"]): r for r in sessions.eviction_log(df.coalesce(1), summarize).collect()}
    assert len(log) == 6 and log[0, 10]["summary"] == "1 lines" and log[2, 11]["error"] is None
    assert log[1, 10]["summary"] == "(unsummarized excerpt) user: turn 0 of 1" and "no summary" in log[1, 10]["error"]
