"""Versioned tables: any order of changes equals plain rows, and files that nothing touched stay."""

import random

import pytest
from pyspark.sql import functions as F

from corpusengine.sources.maintenance import reuploads
from corpusengine.sources.versions import VersionedTable, purge

SCHEMA = "tenant string, doc_id long, chunk_index int, text string"
KEYS = ["tenant", "doc_id"]
BY = "pmod(xxhash64(tenant, doc_id), 5)"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_any_order_of_changes_equals_plain_rows(spark, tmp_path):
    rng, held, kept = random.Random(3), [], []
    table = VersionedTable(spark, f"file://{tmp_path}/t", BY)
    for step in range(6):
        keys = [(rng.choice(["a", "b", "c:/%"]), rng.randint(1, 12)) for _ in range(rng.randint(1, 6))]
        new = [(*k, i, f"{step} {i}") for k in keys for i in range(rng.randint(1, 3))]
        gone = {k[:2] for k in (new if step % 3 < 2 else keys)}
        held = [r for r in held if r[:2] not in gone]
        if step % 3 < 2:
            held += new
            table.upsert(spark.createDataFrame(new, SCHEMA), KEYS)
        else:
            table.delete(spark.createDataFrame(keys, "tenant string, doc_id long"), KEYS)
        kept.append(list(held))
        assert rows(table.read()) == sorted(held, key=repr)
    # older versions are still there, and stay while they are kept
    assert table.vacuum(keep=3) > 0
    for version in (4, 5, 6):
        assert rows(table.read(version)) == sorted(kept[version - 1], key=repr)
    assert [c["number"] for c in table.commits()] == [4, 5, 6] and table.vacuum(keep=3) == 0


def test_only_touched_partitions_get_new_files_and_a_replay_none(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", BY)
    table.upsert(spark.createDataFrame([("a", k, 0, "x") for k in range(40)], SCHEMA), KEYS, batch="one")
    before = table.partitions()
    change = spark.createDataFrame([("a", 7, 0, "y"), (None, 1, 0, "no tenant"), ("a", None, 0, "no document")], SCHEMA)
    assert table.upsert(change, KEYS, batch="two") == 2
    after = table.partitions()
    assert len(before) == 5 and sum(before[p] != after[p] for p in before) == 1
    assert table.upsert(change, KEYS, batch="two") == 2 and table.partitions() == after and len(table.commits()) == 2
    assert table.read().filter("text = 'y'").count() == 1 and table.read().count() == 40


def test_a_failed_write_leaves_the_last_version(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", BY)
    table.upsert(spark.createDataFrame([("a", k, 0, "x") for k in range(9)], SCHEMA), KEYS)
    want, named = rows(table.read()), table.partitions()

    class Dies(VersionedTable):
        def _commit(self, *args):
            raise RuntimeError("the driver is gone")

    with pytest.raises(RuntimeError):
        Dies(spark, table.path, BY).upsert(spark.createDataFrame([("a", 1, 0, "z")], SCHEMA), KEYS)
    assert rows(table.read()) == want and table.partitions() == named
    # what it left is not read and goes
    assert table.vacuum() == 1 and rows(table.read()) == want


def test_retention_drops_whole_partitions(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "to_date(ts)")
    events = spark.range(10).select("id", F.expr("timestamp'2026-01-01 12:00:00' + make_dt_interval(id)").alias("ts")).union(spark.sql("select 99L, cast(null as timestamp)"))
    table.replace_partitions(events)
    before = table.partitions()
    assert "2026-01-01" in before and "none" in before
    table.retain("part >= '2026-01-08' and part <> 'none'")
    assert sorted(r["id"] for r in table.read().collect()) == [7, 8, 9]
    assert table.partitions().items() <= before.items()
    table.replace_partitions(events.filter("id = 9").withColumn("id", F.col("id") * 100))
    assert sorted(r["id"] for r in table.read().collect()) == [7, 8, 900]
    table.retain("false")
    assert table.read().columns == ["id", "ts"] and table.read().count() == 0


def test_a_reupload_is_purged_from_every_table(spark, tmp_path):
    registry = spark.createDataFrame([("a", 1, "f", 1), ("a", 2, "f", 2), ("b", 3, "f", 1)], "tenant string, doc_id long, filename string, created_at int")
    chunks = spark.createDataFrame([("a", 1, 0, "old"), ("a", 2, 0, "new"), ("b", 3, 0, "other"), ("b", 1, 0, "same id")], SCHEMA)
    tables = [VersionedTable(spark, f"file://{tmp_path}/{n}", BY) for n in ("registry", "chunks", "vectors")]
    for table, df in zip(tables, (registry, chunks, chunks.withColumn("embedding", F.array(F.lit(0.5)))), strict=True):
        table.upsert(df, KEYS)
    _, older = reuploads(registry)
    # the second table's write fails; the purge of the same batch goes on
    tables[0].delete(older, KEYS, batch="p")
    assert purge(tables, older, KEYS, batch="p") == [2, 2, 2] and purge(tables, older, KEYS, batch="p") == [2, 2, 2]
    assert [rows(t.read().select(*KEYS)) for t in tables] == [[("a", 2), ("b", 3)], [("a", 2), ("b", 1), ("b", 3)], [("a", 2), ("b", 1), ("b", 3)]]


def test_empty_rows_and_other_columns(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", BY)
    with pytest.raises(ValueError, match="no such version"):
        table.read()
    table.upsert(spark.createDataFrame([], SCHEMA), KEYS)
    assert table.read().count() == 0 and table.read().columns == ["tenant", "doc_id", "chunk_index", "text"]
    table.upsert(spark.createDataFrame([("a", 1, "kept", 5.0)], "tenant string, doc_id int, text string, extra double"), KEYS)
    assert rows(table.read()) == [("a", 1, None, "kept")]
    table.delete(spark.createDataFrame([("z", 9)], "tenant string, doc_id long"), KEYS)
    assert rows(table.read()) == [("a", 1, None, "kept")]
    table.delete(spark.createDataFrame([("a", 1)], "tenant string, doc_id int"), KEYS)
    assert table.read().count() == 0
