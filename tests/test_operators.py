"""Small cases of the engine's own operators."""

import datetime
import random
import uuid


from pyspark.sql import functions as F

from corpusengine.functions import text as T
from corpusengine.functions.registry import register
from corpusengine.functions.similarity import porter, sequence_ratio
from corpusengine.operators import chunking, context, evaluate, index, retrieval, rewrite, routing, validate
from corpusengine.sources import files, maintenance, tables
from corpusengine.streaming import sessions


def one(spark, column, **values):
    fields = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], fields or "x string").select(column.alias("r")).first()["r"]


def test_text_functions(spark):
    assert one(spark, T.decimal_points(F.col("t")), t="53,51 and 1, 2") == "53.51 and 1, 2"
    assert one(spark, T.join_hyphenated_lines(F.col("t")), t="hyphen-\nated") == "hyphenated"
    assert one(spark, T.label_positional_row(F.col("t"), "Base", ["a", "b"]), t="Base\n1.5\n2.5\nend") == "Base: a=1.5, b=2.5\nend"
    assert one(spark, T.sanitise_html(F.col("t")), t=" <b>x</b><SCRIPT>y</SCRIPT> ") == "x"
    assert one(spark, T.entity_name(F.col("t")), t="Model-X (Ours) w/o Sem -") == "Model-X"
    assert one(spark, T.field_token(F.col("t")), t="s → s") == "s->s"
    assert one(spark, T.valid_email(F.col("t")), t="A@b.org") and not one(spark, T.valid_email(F.col("t")), t="a@b")
    assert one(spark, T.point_id(F.col("d"), F.col("c")), d="doc", c="7") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "doc_7"))
    assert "start=1, end=2, condition=hot" in one(spark, T.annotate_ranges(F.col("t")), t="rises from 1 to 2 when hot.")
    assert [one(spark, T.estimate_tokens(F.col("t")), t=t) for t in (None, "", "ab", "x" * 403)] == [0, 0, 1, 100]


def test_json_salvage(spark):
    cases = {'{"a":1}': "direct", '```json\n{"a":1}\n```': "fenced", 'so: {"a":1} ok': "embedded", "no": "failed", "": "failed"}
    for raw, stage in cases.items():
        assert one(spark, T.parse_stage(F.col("t")), t=raw) == stage
    assert one(spark, T.metadata_record(F.col("t")), t='{"title":" "}') is None
    kept, dropped = T.named_sources(F.col("t"), ["web", "documents"])
    assert one(spark, kept, t='{"sources": ["Web", "moon"]}') == ["web"]
    assert one(spark, dropped, t='{"sources": ["Web", "moon"]}') == ["moon"]


def test_porter_and_registry(spark):
    assert [porter(w) for w in ("caresses", "ponies", "relational", "hopping", "sky", "generalizations")] == ["caress", "poni", "relat", "hop", "sky", "gener"]
    registry = register(spark)
    assert registry.execute("porter_stem", word="running")["result"] == "run"
    assert "error" in registry.execute("nothing") and "error" in registry.execute("porter_stem")
    assert spark.sql("select c.tokens from (select 'a b c' t) d, lateral chunks(t) c").first()["tokens"] == 1


def test_structured_chunks(spark):
    t = spark.createDataFrame([(1, 0, None, "cap", ["m", "a", "a"], [["x", "1", "2"], ["y", "3", "4"]])], "doc_id int, seq int, heading string, caption string, columns array<string>, rows array<array<string>>")
    assert [r["text"] for r in chunking.table_rows(t).orderBy("row").collect()] == ["Table: cap\nRow [x]: a=1, a (2)=2", "Table: cap\nRow [y]: a=3, a (2)=4"]
    f = spark.createDataFrame([(1, 0, "H", "c", "d"), (1, 1, "H", "c", "")], "doc_id int, seq int, heading string, caption string, description string")
    assert [r["text"] for r in chunking.figure_chunks(f).collect()] == ["[Section: H]\nFigure: c\nd"]
    a = spark.createDataFrame([(1, 1, 0, False, None), (1, 1, 1, True, "p"), (1, 2, 0, False, None)], "doc_id int, page int, stage int, ok boolean, text string")
    assert [tuple(r) for r in chunking.recover_pages(a).orderBy("page").collect()] == [(1, 1, "p", 1, False), (1, 2, None, None, True)]


def test_keyword_floor_and_scope(spark):
    rows = [("u", d, 0, t) for d, t in enumerate(["alpha beta", "gamma", "delta alpha", "x"])] + [("v", 9, 0, "alpha")]
    chunks = spark.createDataFrame(rows, "tenant string, doc_id long, chunk_index int, text string")
    q = spark.createDataFrame([(1, "u", "alpha"), (2, "u", "nothing"), (3, "w", "alpha")], "query_id long, tenant string, text string")
    got = [(r["query_id"], r["doc_id"]) for r in index.keyword_search(q, chunks, 3).orderBy("query_id", "rank").collect()]
    assert sorted(d for i, d in got if i == 1) == [0, 1, 2] and not [d for i, d in got if i in (2, 3)]


def test_fusion(spark):
    v = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id long, doc_id long, score double, rank int")
    k = spark.createDataFrame([(1, 10, -3.0, 1), (1, 12, 1.0, 2)], "query_id long, doc_id long, score double, rank int")
    got = retrieval.fuse(v, k, ["query_id", "doc_id"]).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["combined_score"], 6), r["search_type"]) for r in got] == [(10, round(2 / 61, 6), "vector"), (11, round(1 / 62, 6), "vector"), (12, round(1 / 62, 6), "keyword")]
    assert got[0]["keyword_score"] == 0


def test_table_row_filter(spark):
    rows = [(1, "score of Alpha", "Row [Alpha]: a=1", 1), (1, "score of Alpha", "Row [Beta]: a=2", 2), (1, "score of Alpha", "prose", 3), (1, "score of Alpha", "Row [Alpha]: b=2", 4), (2, "compare them", "Row [Beta]: a=2", 1)]
    hits = spark.createDataFrame(rows, "query_id int, question string, text string, rank int")
    assert sorted((r["query_id"], r["rank"]) for r in retrieval.filter_table_rows(hits).collect()) == [(1, 1), (1, 3), (2, 1)]


def test_context_packing_skips_and_goes_on(spark):
    rows = [(1, 1, "a" * 400, False), (1, 2, "b" * 4000, False), (1, 3, "c" * 40, False), (1, 4, "d" * 4000, True)]
    e = spark.createDataFrame(rows, "query_id int, place int, text string, protected boolean")
    got = context.pack_context(e, 550 + 150).first()
    assert got["included"] == [1, 3, 4] and got["dropped"] == [2]


def test_history_window_equals_loop(spark):
    r = random.Random(3)
    rows = [(c, t, "user", "x" * r.choice((0, 40, 900, 4000))) for c in range(30) for t in range(r.randint(1, 14))]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {(x["conv_id"], x["turn"]) for x in sessions.bounded_memory(df).filter("kept").collect()}
    size = lambda t: max(1, len(t) // 4) if t else 0
    for c in range(30):
        held = []
        for _, t, _, text in (x for x in rows if x[0] == c):
            held.append((t, size(text)))
            while len(held) > 1 and (len(held) > 10 or sum(s for _, s in held) > 1200):
                held.pop(0)
        assert {t for k, t in got if k == c} == {t for t, _ in held}


def test_cache_and_rate_limit(spark):
    ts = [0, 10, 50, 65, 70]
    df = spark.createDataFrame([("k", i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t)) for i, t in enumerate(ts)], "key string, request_id int, ts timestamp")
    assert [r["hit"] for r in sessions.cache_hits(df, 60).orderBy("request_id").collect()] == [False, True, True, False, True]
    assert [r["allowed"] for r in sessions.rate_limit(df, 2, 60).orderBy("request_id").collect()] == [True, True, False, True, True]


def test_routing_and_rewrite(spark):
    q = spark.createDataFrame([("what is the weather in Paris today",), ("summarise my uploaded paper",), ("12 * 7",), ("what is recursion",), ("zzz",)], "question string")
    assert [r["source"] for r in routing.route(q).collect()] == ["weather", "documents", "calculator", "direct", "documents"]
    p = spark.createDataFrame([(1, 1, 4, "list my two SQL files", "list my two SQL files please"), (2, 1, 4, "list my files", "list files"), (3, 1, 4, "which of the two", "which of them"), (4, 1, 4, "our database", "our mysql database"), (5, 1, 4, "q", "")], "id int, conv_id int, at int, original string, rewritten string")
    got = {r["id"]: r["reject_reason"] for r in rewrite.gate(p).collect()}
    assert got == {1: None, 2: "dropped_personal", 3: "dropped_quantifier", 4: "invented_technology", 5: "unusable"}


def test_validation(spark):
    ctx = "Row [Alpha]: wer=5.1, rate=7\nBeta has 9 layers."
    ok = validate.numbers_grounded(F.col("a"), F.col("c"), F.col("q"))
    assert one(spark, ok, a="It is 5.1", c=ctx, q="wer of Alpha") and not one(spark, ok, a="It is 9", c=ctx, q="wer of Alpha")
    assert one(spark, validate.grounding_score(F.col("a"), F.col("c")), a="Alpha 7 Gamma 8", c=ctx) == 0.5
    assert one(spark, evaluate.abstains(F.col("a")), a="The paper does not mention it.") and not one(spark, evaluate.abstains(F.col("a")), a="It is 5.")
    miss = evaluate.attribution_mismatches(F.col("a"), F.col("c"), F.col("q"))
    assert one(spark, miss, a="Alpha has 9", c="Alpha has 5\nBeta has 9", q="What does Alpha have") == ["9"]
    assert one(spark, miss, a="none", c="x", q="What does Alpha have") is None


def test_maintenance(spark):
    old = spark.createDataFrame([("u", 1, 0, "a"), ("u", 1, 1, "b"), ("v", 1, 0, "c")], "tenant string, doc_id int, chunk_index int, text string")
    new = spark.createDataFrame([("u", 1, 0, "z")], old.schema)
    once = maintenance.replace_documents(old, new)
    assert sorted(r["text"] for r in once.collect()) == ["c", "z"]
    assert sorted(r["text"] for r in maintenance.replace_documents(once, new).collect()) == ["c", "z"]
    whole, left = maintenance.pair_embeddings(old.filter("tenant = 'u'"), spark.createDataFrame([(1, 0, [1.0]), (2, 0, [1.0])], "doc_id int, chunk_index int, embedding array<double>"))
    assert whole.count() == 1 and left.count() == 2

    def embed_fn(texts):
        if texts[0] == "b":
            raise ValueError("no")
        return [[float(len(texts[0]))]]

    got = {r["text"]: (r["embedding"], r["error"]) for r in maintenance.embed(old, embed_fn).collect()}
    assert got["a"] == ([1.0], None) and got["b"][0] is None and "no" in got["b"][1]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,age\nAlice,30\n"B, C",1\n')
    assert files.csv_as_text(spark, str(tmp_path / "a.csv")).first()["content"] == "HEADERS: name | age\nAlice | 30\nB, C | 1\n"
    up = spark.createDataFrame([("a.TXT", 1), (None, 1), ("b.exe", 1), ("c.pdf", 1 << 30)], "filename string, size_bytes long")
    ok, bad = files.admit_uploads(up)
    assert [r["filename"] for r in ok.collect()] == ["a.TXT"] and sorted(r["reason"] for r in bad.collect()) == ["bad_type", "null_name", "too_large"]
    (tmp_path / "g.json").write_text('{"items": [{"id": "1", "type": "answer", "question": "x"}, {"id": "2", "type": "answer", "question": "REPLACE"}, {"id": "3"}]}')
    good, open_ = files.golden_items(spark, str(tmp_path / "g.json"))
    assert [r["id"] for r in good.collect()] == ["1"] and [r["id"] for r in open_.collect()] == ["2"]


def test_tables_are_safe(spark):
    t = tables.Tables({"users": spark.createDataFrame([("u", "h")], "name string, password_hash string"), "secret": None})
    assert t.find("users", columns=["name", "password_hash"]).columns == ["name"]
    try:
        t.find("secret")
        raise AssertionError
    except ValueError:
        pass


def test_sequence_ratio(spark):
    assert abs(one(spark, sequence_ratio(F.col("a"), F.col("b")), a="abcd", b="bcde") - 0.75) < 1e-9


def test_entry_registers_queries():
    from corpusengine.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 40


def test_vector_search_answers_any_number_of_queries(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, ("a", "b")[i % 2], [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "doc_id long, tenant string, embedding array<double>")
    queries = vectors.withColumnRenamed("doc_id", "query_id")
    whole = {tuple(x) for x in retrieval.vector_search(queries, vectors, 3).collect()}
    monkeypatch.setattr(retrieval, "MAX_QUERY_BLOCK_MB", 25 * 32 / 1_000_000)
    assert [len(b) for b in retrieval._query_blocks(queries.select("query_id", "tenant", retrieval.unit(F.col("embedding")).alias("e")))] == [25, 25, 10]
    assert {tuple(x) for x in retrieval.vector_search(queries, vectors, 3).collect()} == whole and len(whole) == 180
    assert retrieval.vector_search(queries.limit(0), vectors, 3).count() == 0


def test_prior_turns_equal_comparing_all_and_meet_few(spark):
    from corpusengine.functions import text as T
    from corpusengine.operators import rewrite

    rng = random.Random(11)
    # words of a Zipf-like spread; a third of the rewrites repeat most of an earlier turn
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    say = lambda k: " ".join(rng.sample(words, k))
    turns = [(c, t, rng.choice([None, "", "the of"]) if rng.random() < 0.05 else say(rng.randrange(3, 18))) for c in range(3) for t in range(150)] + [(0, 7, "aaa bbb"), (0, 7, "bbb aaa"), (None, 1, "aaa bbb")]
    pairs = []
    for k in range(240):
        c, at = rng.randrange(3), rng.randrange(150)
        said = [x for a, t, x in turns if a == c and t < at and x]
        new = " ".join(rng.choice(said).split()[1:] + ["more"]) if said and k % 3 == 0 else say(6)
        pairs.append((k, c, at, say(6) if k % 4 else new, new))
    pairs += [(300, 0, 20, "ccc", "aaa bbb"), (301, 0, 20, None, None), (302, None, 20, "ccc", "aaa bbb"), (303, 0, 20, "aaa bbb", "aaa bbb"), (304, 0, 20, "ccc", "of the")]
    p = spark.createDataFrame(pairs, "id long, conv_id long, at long, original string, rewritten string")
    h = spark.createDataFrame(turns, "conv_id long, seq long, content string")
    got = {tuple(r) for r in rewrite.prior_matches(p, h).collect()}
    own = T.overlap_ratio(T.content_words(F.col("rewritten")), T.content_words(F.col("original")))
    like = T.overlap_ratio(T.content_words(F.col("rewritten")), T.content_words(F.col("content")))
    every = p.join(h, "conv_id").filter("seq < at")
    want = {tuple(r) for r in every.filter((like >= 0.35) & (like > own + 0.10)).groupBy("id").agg(F.min(F.struct("seq", "content"))["content"].alias("prior")).collect()}
    assert got == want and len(got) > 40 and (300, "aaa bbb") in got and not {301, 302, 303, 304} & {i for i, _ in got}
    # candidates don't know of turns' places, so they stand against all turns of the conversation
    assert rewrite.prior_candidates(rewrite.asked_words(p), rewrite.told_words(h)).count() < 0.2 * p.join(h, "conv_id").count()
    assert rewrite.prior_matches(p, h.limit(0)).count() == rewrite.prior_matches(p.limit(0), h).count() == 0


def test_a_failing_row_costs_that_row_only(spark):
    from corpusengine.operators.hooks import call_rows

    rows = spark.createDataFrame([(2**53 + 1, "a", "x"), (None, "b", "x"), (3, "bad", "x"), (4, None, "x")], "id long, text string, error string").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def judge(texts):
        calls.add(1)
        if "bad" in texts:
            raise ValueError("no verdict")
        return [None if t is None else float(len(t)) for t in texts]

    got = call_rows(rows, judge, ["text"], "score", "double", tries=3).collect()
    assert [(r["id"], r["text"], r["score"]) for r in got] == [(2**53 + 1, "a", 1.0), (None, "b", 1.0), (3, "bad", None), (4, None, None)]
    assert [r["error"] for r in got] == [None, None, "ValueError('no verdict')", None] and calls.value == 1 + 1 + 1 + 3 + 1
    assert call_rows(rows, lambda t: t[:1], ["text"], "said").filter("error is null").count() == 4
    assert call_rows(rows, lambda t: [object()] * len(t), ["text"], "said").filter("error is not null and said is null").count() == 4
    assert call_rows(rows.limit(0), judge, ["text"], "score", "double").count() == 0


def test_numbers_stand_in_the_field_that_was_asked_for(spark):
    rows = "Row [Moshi (Ours)]: S→S=84.1, S→T=70.2, Lat.=1.5\nRow [Baseline]: s->s=60.0, s->t=84.1\nThe wer of both was 5.5. Nothing else was measured."
    cases = [
        ("It is 84.1", rows, "S → S of Moshi?", "documents", True),
        ("It is 70.2", rows, "s->s of Moshi?", "documents", False),
        ("It is 70.2", rows, "s-t of Moshi?", "documents", True),
        ("It is 84.1", rows, "s->t of Moshi?", "documents", False),
        ("It is 84.1", rows, "s->t of Baseline?", "documents", True),
        ("It is 1.5 and 84.1", rows, "the latency?", "documents", False),
        ("It is 1.5", rows, "the latency?", "documents", True),
        ("It is 1.5", rows, "how much?", "documents", True),
        ("It is 99", rows, "how much?", "Calculator", True),
        ("It is 99", rows, "how much?", None, False),
        ("None.", rows, "the latency?", None, True),
        (None, None, None, None, True),
        ("It is 3", "It was 3 in all.", None, None, True),
        ("It is 5.5", "Moshi has a wer of 5.5.", "the wer of Moshi?", None, True),
        ("It is 5.5", "Moshi has a bleu of 5.5.", "the wer of Moshi?", None, False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, c string, q string, s string, want boolean")
    ok = validate.numbers_grounded(F.col("a"), F.col("c"), F.col("q"), strict=True, source=F.col("s"), fields=validate.FIELDS, asked_only=True)
    wrong = df.withColumn("got", ok).filter("not (got <=> want)").collect()
    assert wrong == []


def test_messages_newest_first_with_the_total(spark):
    m = spark.createDataFrame([(k, 0, k % 7, "Hello" if k % 2 else None) for k in range(40)], "conv_id long, turn int, ts long, text string")
    got = retrieval.search_messages(m, "hell", count=3).collect()
    assert [(r["conv_id"], r["ts"], r["total"]) for r in got] == [(13, 6, 20), (27, 6, 20), (5, 5, 20)]
    assert retrieval.search_messages(m, "nothing").collect() == []
