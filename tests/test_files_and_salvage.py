"""Sources and sinks on files, JSON salvage, numbers, hashes, embedding in batches, fallback routes."""

import datetime
import json
import random

from pyspark.sql import functions as F

from corpusengine.functions import text as T
from corpusengine.operators import context, retrieval, routing
from corpusengine.sources import files, maintenance
from corpusengine.streaming import sessions


def values(spark, column, rows):
    """``column`` over the one-column table ``t`` of ``rows``, in order."""
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    return [r["r"] for r in df.select("i", column.alias("r")).orderBy("i").collect()]


def first_balanced(text):
    """What the salvage looks for, character by character."""
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for k in range(max(start, 0), len(text)):
        c = text[k]
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
            continue
        if c == '"':
            quoted = True
        depth += (c == "{") - (c == "}")
        if depth == 0 and c == "}":
            return text[start : k + 1]
    return None


def test_salvage_takes_the_first_balanced_object(spark):
    raw = ['x {"a":{"b":1}} y {"c":2}', '{"a":1} junk', '{"a":"}"} z', 'p {"a":"\\"}{"} q', "{ broken", '{"a":1', "[1] {}", '```\n{"k":[1,{"z":2}]}\n```', '{"a":1}{"b":2}', "{'a':1} {\"b\":2}"]
    got = values(spark, T.object_of(F.col("t")), raw)
    assert got == ['{"a":{"b":1}}', '{"a":1}', '{"a":"}"}', '{"a":"\\"}{"}', None, None, "{}", '{"k":[1,{"z":2}]}', '{"a":1}', None]
    stages = values(spark, T.parse_stage(F.col("t")), raw)
    assert stages[:2] == ["embedded", "embedded"] and stages[4] == "failed" and stages[7] == "fenced"
    r = random.Random(1)
    fuzz = ["".join(r.choice('{}"\\ab:1, ') for _ in range(r.randint(0, 40))) for _ in range(400)]
    assert values(spark, T.balanced_object(F.col("t")), fuzz) == [first_balanced(x) for x in fuzz]


def test_number_tokens_equal_the_c_format(spark):
    r = random.Random(2)
    raw = ["1,234.50", "−3%", "0", "-0.0", "1e400", "abc", "12345678901234", "0.00001234", "0.0001", "99999999995", "9999999999", "1e-7"] + [repr(r.choice((1, -1)) * r.random() * 10 ** r.randint(-8, 14)) for _ in range(400)]
    got = values(spark, T.number_token(F.col("t")), raw)
    for text, token in zip(raw[12:], got[12:], strict=True):
        assert token == f"{float(text):.10g}"
    assert got[:4] == ["1234.5", "-3", "0", "0"] and got[4] is got[5] is None and got[6:12] == ["1.23456789e+13", "1.234e-05", "0.0001", "1e+11", "9999999999", "1e-07"]


def test_change_hash_follows_values_only(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "2", "a": "1"}, {"a": "2", "b": "1"})], "x map<string,string>, y map<string,string>, z map<string,string>")
    got = df.select(*[T.change_hash(F.col(c)).alias(c) for c in "xyz"]).first()
    assert got["x"] == got["y"] != got["z"] and len(got["x"]) == 12


def test_csv_with_quoted_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h1,h2\n"two\nlines","a ""q"" b"\n\n,x\nlast,\n')
    (tmp_path / "b.csv").write_text("only\r\n1")
    (tmp_path / "c.csv").write_text("")
    got = {r["path"][-5:]: r["content"] for r in files.csv_as_text(spark, f"{tmp_path}/*.csv").collect()}
    assert got["a.csv"] == 'HEADERS: h1 | h2\ntwo\nlines | a "q" b\n | x\nlast | \n' and got["b.csv"] == "HEADERS: only\n1\n" and len(got) == 2


def test_whole_texts_and_routing_tests(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\ntwo é")
    assert files.read_texts(spark, str(tmp_path / "t.txt")).first()["content"] == "one\ntwo é"
    tests = {"tests": [{"id": "PLAN_WEB_1", "question": "q", "expected_planner_decision": {"source": "web", "tool": None}, "must_not_select": ["documents"]}, {"id": "OTHER_1", "question": "q", "expected_planner_decision": {"source": "web", "tool": "x"}, "must_not_select": []}]}
    (tmp_path / "r.json").write_text(json.dumps(tests))
    got = files.routing_tests(spark, str(tmp_path / "r.json")).collect()
    assert [(r["id"], r["expected_source"], r["category"]) for r in got] == [("PLAN_WEB_1", "web", "web")]
    listing = spark.createDataFrame([("u", i, i) for i in range(7)] + [("v", 9, 9)], "tenant string, doc_id int, created_at int")
    assert [r["doc_id"] for r in files.latest_pages(listing, "u", 2, 3).collect()] == [4, 3, 2]


def test_reports_and_summaries_are_appended(spark, tmp_path):
    df = spark.createDataFrame([("u", "s", "x", ["t"])], "tenant string, session string, summary string, topics array<string>")
    for _ in range(2):
        maintenance.append_summaries(df, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 2
    rows, report = df.select("tenant", "summary"), df.select("summary")
    for run in ("1", "2"):
        maintenance.write_reports(rows, report, f"{tmp_path}/r", run)
    assert spark.read.csv(f"{tmp_path}/r/samples", header=True).count() == 2 and spark.read.json(f"{tmp_path}/r/report").count() == 2


def test_embedding_goes_in_batches(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id int, text string").coalesce(1)
    log = str(tmp_path / "calls")

    def embed_fn(texts):
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        return [[float(len(t))] for t in texts]

    assert maintenance.embed(chunks, embed_fn).filter("embedding is null or error is not null").count() == 0
    assert max(map(int, open(log).read().split())) == 20


def test_fallback_and_active_documents(spark):
    q = [("when was it, 5 minus 3", False), ("zzz", True), ("zzz", False), ("who was he", True), ("who was he", False), ("what is GPT-Neo", False), ("what is recursion", False), ("total files of it", True)]
    df = spark.createDataFrame(q, "question string, active boolean")
    assert [r["source"] for r in routing.route(df, active="active").collect()] == ["calculator", "documents", "documents", "documents", "direct", "direct", "direct", "database"]


def test_context_of_tools_only(spark):
    e = spark.createDataFrame([(1, 1, "a" * 400, False)], "query_id int, place int, text string, protected boolean")
    tools = spark.createDataFrame([(1, 1, "[T] x"), (2, 1, "[T] y"), (3, 1, None)], "query_id int, place int, line string")
    got = {r["query_id"]: r for r in context.pack_context(e, 2000, tools=tools).collect()}
    assert got[1]["context"].endswith("\n\n[T] x") and got[2]["context"] == "[T] y" and got[2]["included"] == [] and 3 not in got


def test_hybrid_search_of_another_tenant_finds_nothing(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, question string")
    ranked = spark.createDataFrame([(1, 10, 0.5, 1)], "query_id long, doc_id long, score double, rank int")
    got = retrieval.hybrid_search(asked, ranked, ranked.limit(0), spark.createDataFrame([(10, "t")], "doc_id long, text string")).collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in got] == [(1, 10, 1)]


def test_audit_and_statistics(spark):
    ts = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    requests = spark.createDataFrame([(1, ts(0), "/auth/x"), (2, ts(1), "/other"), (3, ts(2), "/auth/y")], "request_id int, ts timestamp, path string")
    responses = spark.createDataFrame([(1, ts(0.25), 200)], "request_id int, ts timestamp, status int")
    got = {r["request_id"]: (r["status"], r["ms"]) for r in sessions.audit_records(requests, responses, ["/auth"]).collect()}
    assert got == {1: (200, 250.0), 3: (None, None)}
    stores = spark.createDataFrame([("q:1", True), ("q:2", False), ("r:1", True), (None, False)], "key string, hit boolean")
    assert {(r["prefix"], r["n"], r["hits"], r["misses"]) for r in sessions.cache_statistics(stores).collect()} == {("q", 2, 1, 1), ("r", 1, 1, 0), (None, 1, 0, 1)}
    assert sessions.clear_prefix(stores, "q").count() == 2
