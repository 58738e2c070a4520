"""p_rewrite_gates where letters outside ASCII stand beside its words."""

import duckdb

from corpusengine.operators.rewrite import dropped_personal
from corpusengine.plans import runlog
from pyspark.sql import functions as F

TURNS = ["pour la ouré", "plain", "éone éi SQL²", "SQĹ poſtgres", "FİVE", "ten MY", " ab ", "İ cannot say", "redis", "mysql and redis", "éredis"]


def test_gates_equal_their_sql(spark, tmp_path):
    rows = [(c, 2 * k, "user", x) for c, turns in enumerate((TURNS, TURNS[::-1], [None, "sql", "my", None])) for k, x in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(runlog.REWRITE).fetchall()
    assert sorted(map(repr, map(tuple, runlog.rewrite_gates(spark, str(tmp_path)).collect()))) == sorted(map(repr, want))


def test_the_gate_itself_takes_every_letter_as_part_of_a_word(spark):
    df = spark.createDataFrame([("pour la ouré", "pour la"), ("our ré", "la")], "old string, new string")
    assert [r[0] for r in df.select(dropped_personal(F.col("old"), F.col("new"))).collect()] == [False, True]
