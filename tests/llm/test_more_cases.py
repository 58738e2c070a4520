"""Long texts, clashing columns, graphs of calls, recall on given tables, verdicts looked up by place."""

import hashlib
import json
import random
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from corpusengine.llm import byte_bpe, exact_dedup, jaccard_join, mixing, quality_rules, range_coder, rows, suffix_dedup, token_files, tool_calls, url_filter

SCHEMA = "conv_id string, turn long, call_id string, name string, arguments map<string,string>, after array<string>"


def words(r, n, size=400):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def test_levels_of_calls_with_several_predecessors(spark):
    r = random.Random(2)
    for n, cycle in ((60, False), (40, True)):
        after = {i: [str(j) for j in r.sample(range(max(i, 1)), min(i, r.choice((0, 1, 1, 2, 3))))] for i in range(n)}
        after[7] = ["6", "nobody"]
        if cycle:
            after[10] = ["20"]
            after[20] = ["15"]
            after[15] = ["10", "3"]
        calls = spark.createDataFrame([("c", i, str(i), "t", {}, after[i]) for i in range(n)], SCHEMA)
        got = {int(x["call_id"]): x["level"] for x in tool_calls.levels(calls).collect()}

        def level(i, path=()):
            below = [int(j) for j in after[i] if j.isdigit()]
            if i in path:
                return None
            found = [level(j, (*path, i)) for j in below]
            return None if None in found else max((x + 1 for x in found), default=0)

        assert got == {i: level(i) for i in range(n)}


def test_diamonds_one_after_the_other(spark):
    rows_, n = [("c", 0, "0", "t", {}, [])], 0
    for k in range(12):
        rows_ += [("c", 0, f"{n + 1}", "t", {}, [f"{n}"]), ("c", 0, f"{n + 2}", "t", {}, [f"{n}"]), ("c", 0, f"{n + 3}", "t", {}, [f"{n + 1}", f"{n + 2}"])]
        n += 3
    got = {x["call_id"]: x["level"] for x in tool_calls.levels(spark.createDataFrame(rows_, SCHEMA)).collect()}
    assert got[str(n)] == 24 and got["1"] == 1


def test_canonical_json_and_nested_schemas(spark):
    schemas = {"find": {"query": ({"text": ("string", True), "limit": ("integer", False)}, True), "tags": (["string"], False), "n": ("number", False)}}
    cases = {
        "a": ({"query": '{"limit": 3 ,"text":"x"}', "tags": '["b", "a"]', "n": "1.50"}, ""),
        "b": ({"query": '{"text":7,"more":{"z":1,"a":2}}'}, "query.text is no string; unexpected query.more"),
        "c": ({"query": '{"text":"x"} y', "n": "007"}, "n is no number; query is no object"),
        "d": ({"query": '{"limit":1.5}', "tags": '["a", 1]'}, "missing query.text; query.limit is no integer; tags[] is no string"),
        "e": ({"query": '{"text":"a\\"b\\u00e9"}', "tags": '"no"', "n": '"a"b"'}, "n is no number; tags is no array"),
        "f": ({"query": '{"text":"x"}', "n": "1] , [2"}, "n is no number"),
    }
    calls = spark.createDataFrame([("c", i, k, "find", a, []) for i, (k, (a, _)) in enumerate(cases.items())], SCHEMA)
    got = {x["call_id"]: x for x in tool_calls.link_calls(calls, spark.createDataFrame([], "conv_id string, turn long, call_id string, content string"), schemas).collect()}
    for k, (_, errors) in cases.items():
        assert got[k]["errors"] == errors, k
        parsed = json.loads(got[k]["json"])
        assert json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == got[k]["json"]
    assert json.loads(got["a"]["json"])["arguments"] == {"n": 1.5, "query": {"limit": 3, "text": "x"}, "tags": ["b", "a"]}
    assert tool_calls.unidentified(calls.withColumn("call_id", F.lit(None).cast("string"))).count() == 6


def test_suffix_rules(spark):
    hosts = {"x.com.cn": "x.com.cn", "a.shop.co.in": "shop.co.in", "192.168.10.7": "192.168.10.7", "user@x.org:80": "x.org", "a.b.ck": "a.b.ck", "q.a.b.ck": "a.b.ck", "www.ck": "www.ck", "a.www.ck": "www.ck", "me.github.io": "me.github.io", "b.me.github.io": "me.github.io", "com": "com", "": "", "a.com.": "a.com"}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {x["host"]: x["d"] for x in df.select("host", url_filter.registered(F.col("host"))[0].alias("d")).collect()} == hosts


def test_pages_without_ids_and_repeated_pages(spark):
    rows_ = [(None, "http://user@x.org/a"), (None, None), (3, "http://x.org/b"), (3, "http://x.org/b"), (4, "http://192.168.10.7/c"), (5, "")]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in rows_], "page_id long, url string, domain string, host string")
    labels = spark.createDataFrame([(3, 0, 1), (4, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = url_filter.judge_pages(pages, labels).collect()
    assert len(got) == 6 and sum(x["page_id"] is None for x in got) == 2
    assert {(x["host"], x["domain"]) for x in got} == {("user@x.org", "x.org"), ("", ""), ("x.org", "x.org"), ("192.168.10.7", "192.168.10.7")}
    assert {x["n_labelled"] for x in got if x["host"] == "x.org"} == {2} and {x["n_labelled"] for x in got if x["host"] == ""} == {0}


def test_calls_with_clashing_columns_and_long_texts(spark):
    turns = [("c", 0, "user", "x" * 3_000_000, "k"), ("c", 1, "assistant", None, "k"), ("c", 2, "system", "s", "k"), (None, 0, "user", "lost", "k"), ("c", 4, "user", "  ", "k")]
    df = spark.createDataFrame(turns, "conv_id string, turn long, role string, text string, level string")
    got = {x["call_id"]: x for x in tool_calls.link_calls(*tool_calls.calls_of_turns(df), tool_calls.REPLY).collect()}
    assert set(got) == {"c0", "c4"} and got["c0"]["status"] == "linked" and json.loads(got["c0"]["json"])["result"] == "" and got["c4"]["status"] == "invalid"


def test_embedding_agrees_as_often_as_sets_are_similar():
    r = np.random.default_rng(4)
    agree, want = [], []
    for n in (6, 40, 400):
        for _ in range(60):
            a = r.integers(-(2**62), 2**62, n)
            b = np.concatenate((a[: n * 9 // 10], r.integers(-(2**62), 2**62, n - n * 9 // 10)))
            x, y = jaccard_join.embed([a, b], 30)
            agree.append((x == y).mean())
            want.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(agree) - np.mean(want)) < 0.03


def test_jaccard_finds_what_brute_force_finds(spark):
    """Large and small groups of near copies among texts that share a passage, with small leaves and blocks."""
    r = random.Random(6)
    passage, base = words(r, 60, 5000), words(r, 120, 5000).split(" ")
    texts = [f"{words(r, 40, 5000)} {passage} {words(r, 40, 5000)}" for _ in range(60)]
    for _ in range(150):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"x{r.randrange(5000)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["n_links"] for x in jaccard_join.jaccard_join(docs, leaf=8, block=16, block_tokens=1500).collect()}
    sets = [frozenset(zip(*(t.split(" ")[k:] for k in range(5)), strict=False)) for t in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    links = {i: sum(1 for s in first if s != sets[i] and 5 * len(s & sets[i]) >= 4 * len(s | sets[i])) for i in range(len(sets))}
    assert sum(got[i] for i in links) >= 0.99 * sum(links.values()) and all(got[i] <= links[i] for i in links)


def test_very_long_texts(spark):
    """Texts of several megabytes, and one that repeats itself, over the part that suffix dedup searches at once."""
    r = random.Random(8)
    long = " ".join(words(r, 50) for _ in range(20_000))
    again = words(r, 12) * 40_000
    assert len(long) > suffix_dedup.PART and len(again) > suffix_dedup.PART / 2
    docs = spark.createDataFrame([(0, words(r, 80)), (1, long), (2, long[1_000_000:4_300_000] + " end"), (3, again), (4, again[:3000]), (5, "x" * 400), (6, "x" * 70)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in suffix_dedup.suffix_dedup(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[3]["n_removed"] == 0 and got[5]["n_removed"] == 0
    assert got[2]["n_removed"] in range(3_300_000, 3_300_004) and got[2]["n_spans"] == 1
    assert got[4]["n_removed"] == 3000 and got[6]["n_removed"] == 70
    # 4 holds the same few shingles as 3
    assert jaccard_join.jaccard_join(docs).filter("kept").count() == 6
    stats = {x["doc_id"]: x for x in quality_rules.judge_documents(docs.withColumn("source", F.lit("s"))).collect()}
    # its first and last word are cut off differently
    assert stats[1]["n_words"] == 1_000_000 and stats[3]["n_repeat_words"] == stats[3]["n_words"] - 2
    codec = byte_bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for x in byte_bpe.encode_and_decode(docs.filter("doc_id in (1, 3)").withColumn("ids", F.lit("clash")), codec).select("doc_id", F.col("decoded_sha256").alias("h")).collect():
        assert x["h"] == hashlib.sha256((long if x["doc_id"] == 1 else again).encode()).hexdigest()


def test_repeats_within_a_document_are_all_removed(spark):
    """A passage that stands several times in a document, once in an earlier one."""
    r = random.Random(3)
    passage = words(r, 30)
    texts = [words(r, 20) + " " + passage, " ".join(f"{passage} {words(r, 7)}" for _ in range(5)), passage * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    for x in suffix_dedup.suffix_dedup(docs).collect():
        t, gone = texts[x["doc_id"]], set()
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < x["doc_id"]:
                gone.update(range(k, k + 50))
        assert x["n_removed"] == len(gone)


def test_verdicts_are_applied_by_place(spark, tmp_path, monkeypatch):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("_file"), F.col("id").cast("string").alias("text")).repartition(7)
    df.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    verdict = lambda marked, at: marked.select(*at, (F.col("doc_id") % 3).cast("int").alias("copies"))
    want = sorted(i for i in range(5000) for _ in range(i % 3))
    for most, passes in ((1 << 25, 16), (1 << 13, 16), (1 << 13, 1)):
        monkeypatch.setattr(rows, "MOST", most)
        monkeypatch.setattr(rows, "MOST_PASSES", passes)
        out = rows.decide(docs, verdict)
        assert out.columns == docs.columns and sorted(x["doc_id"] for x in out.collect()) == want
    # what doesn't come from files is written first; null ids and repeated rows are rows like others
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string")
    assert rows.decide(odd, lambda m, at: m.select(*at, F.when(F.col("text").isNull(), 0).otherwise(1).alias("copies"))).count() == 2


def test_bit_planes_find_all_that_repeats(spark):
    r = np.random.default_rng(5)
    ids = r.integers(0, 3000, 4000)
    df = spark.createDataFrame([(int(i), f"text {i}") for i in ids], "doc_id long, text string").repartition(5)
    got = exact_dedup.exact_dedup(df).groupBy("text_sha256").agg(F.first("group_size").alias("n"), F.count("*").alias("m"), F.count_if("kept").alias("k"), F.min("possibly_repeated").alias("p")).collect()
    assert all(x["n"] == x["m"] and x["k"] == 1 and (x["p"] or x["m"] == 1) for x in got)
    assert sum(x["p"] for x in got if x["m"] == 1) < 0.3 * len(got)


def test_posteriors_are_the_optimum_of_the_weighted_likelihood(spark):
    """Of the calibration: no step lessens the penalised loss, a sample stands for all its domain, and columns equal numpy."""
    r = np.random.default_rng(9)
    domain = r.choice(3, 3000, p=(0.7, 0.2, 0.1))
    scored = [(i, i, int(r.integers(1, 500)), *map(float, r.gamma(1 + 2 * (domain[i] == np.arange(3)), 2.0))) for i in range(3000)]
    df = spark.createDataFrame(scored, "row long, doc_id long, n_tokens long, s_good double, s_low double, s_toxic double")
    held = spark.createDataFrame([(i, int(domain[i])) for i in range(0, 3000, 2)], "doc_id long, domain int")
    priors = list(np.log([0.7, 0.2, 0.1]))
    x = np.array([mixing.traits(dict(zip(df.columns, s, strict=True))) for s in scored])
    w = mixing.calibrate(x[::2], domain[::2], np.ones(1500), priors)

    def loss(w):
        odds = np.c_[np.zeros(1500), x[::2] @ w.T]
        ridge = np.r_[0.01, np.full(4, mixing.RIDGE)]
        base = np.zeros_like(w)
        base[:, 0] = [priors[1] - priors[0], priors[2] - priors[0]]
        return (np.log(np.exp(odds).sum(axis=1)) - odds[np.arange(1500), domain[::2]]).sum() + (ridge * (w - base) ** 2).sum() / 2

    assert all(loss(w + 0.01 * d.reshape(w.shape)) > loss(w) for d in np.vstack([np.eye(10), -np.eye(10)]))
    odds = np.c_[np.zeros(3000), x @ w.T]
    want = np.exp(odds) / np.exp(odds).sum(axis=1, keepdims=True)
    got = mixing.posteriors(df, held, priors).toPandas().sort_values("row")
    assert np.allclose(got[["p_good", "p_low", "p_toxic"]], want)
    some = mixing.posteriors(df, held, priors, max_labelled=100).toPandas().sort_values("row")
    assert abs(some[["p_good", "p_low", "p_toxic"]].to_numpy() - want).mean() < 0.05


def test_copies_count_once_in_training(spark):
    r = random.Random(11)
    rows_ = [(i, words(r, 60)) for i in range(300)]
    copy = "oddword " + words(r, 80)
    rows_ += [(300 + i, f"{copy} tail{i}") for i in range(200)]
    labels = [(i, 1, int(i >= 300 or i % 10 == 0)) for i in range(500)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    labelled = mixing.labelled_domains(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    weights = mixing.train(docs, labelled)[1]
    assert weights.join(spark.range(1).select(mixing.bucket(F.lit("oddword")).alias("b")), "b").count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Which documents stay after the first three stages, and the ids of those that come out, against plain Python."""
    import corpus_pipeline
    import tiktoken

    r = random.Random(21)
    texts = [words(r, 90) for _ in range(60)] + [words(r, 10) for _ in range(5)] + ["spin the wheel " * 60]
    texts += [t + "  " for t in texts[:6]] + [t.replace(" ", "\n", 1) for t in texts[3:9]]
    for t in texts[10:18]:
        w = t.split(" ")
        w[r.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    rows_ = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = [i for i, t in enumerate(texts) if len(t.split()) >= 50 and not t.startswith("spin")]
    bare = lambda i: re.sub(r"\s", "", texts[i])
    kept = [i for i in kept if i == min((k for k in kept if bare(k) == bare(i)), key=lambda k: (-len(texts[k]), k))]
    sets = {i: frozenset(zip(*(texts[i].split()[k:] for k in range(5)), strict=False)) for i in kept}
    root = {i: i for i in kept}
    for _ in kept:
        for a in kept:
            for b in kept:
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    root[a] = min(root[a], root[b])
    kept = [i for i in kept if root[i] == i]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
    assert sorted(x["doc_id"] for x in docs.collect()) == kept
    ranks = byte_bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    same = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in out} <= set(kept) and len({x["doc_id"] for x in out}) > 0.9 * len(kept)
    for x in out:
        assert np.frombuffer(x["ids"], "<u4").tolist() == same.encode_ordinary(texts[x["doc_id"]])
        assert x["decoded_sha256"] == hashlib.sha256(texts[x["doc_id"]].encode()).hexdigest()


def test_range_coder_of_uneven_blocks():
    r = np.random.default_rng(5)
    made = [r.integers(0, 300, n) for n in (1, 15, 16, 17, 143, 144, 145, 4000)] + [np.arange(8192)[::-1] * 8, np.full(8192, 65535), np.minimum(r.zipf(1.2, 8192), 65535)]
    blocks = [b.astype(np.uint16) for b in made]
    coded = range_coder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode_blocks(coded, [len(b) for b in blocks]), strict=True))
    assert all(range_coder.encode_blocks([b]) == [c] for b, c in zip(blocks, coded, strict=True))
    # an id that came since the frequencies were refreshed is no new one
    few = [np.array([9000, 17, 40000, 9000, 40000, 17, 17, 9000, 40000, 40000, 17, 9000], np.uint16)]
    assert len(range_coder.encode_blocks(few)[0]) < 2 + 6 + 2 * 6


def test_sections_of_a_block_go_in_step(monkeypatch):
    steps, predict = [], range_coder.Model.predict
    monkeypatch.setattr(range_coder.Model, "predict", lambda self, *a: steps.append(1) or predict(self, *a))
    block = np.minimum(np.random.default_rng(3).zipf(1.2, 8192), 65535).astype(np.uint16)
    coded = range_coder.encode_blocks([block, block[:100]])
    assert len(steps) <= 8192 // 16
    assert all((a == b).all() for a, b in zip([block, block[:100]], range_coder.decode_blocks(coded, [8192, 100]), strict=True))
    assert len(steps) <= 2 * 8192 // 16


def test_range_coder_of_repeated_and_rare_ids():
    r = np.random.default_rng(9)
    blocks = [np.where(np.arange(n) == at, 7, 0) for n, at in ((8192, 0), (8192, 8191), (8192, 4000), (5000, 17), (300, 299), (2, 1))]
    blocks += [np.tile([0, 65535], 4096), np.tile(np.arange(100), 81), np.sort(r.integers(0, 65536, 8192)), r.integers(0, 2, 4097), np.repeat(r.integers(0, 49152, 64), 128), np.arange(8192)]
    blocks = [b.astype(np.uint16) for b in blocks]
    coded = range_coder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode_blocks(coded, [len(b) for b in blocks]), strict=True))
    assert all(range_coder.encode_blocks([b]) == [c] for b, c in zip(blocks, coded, strict=True))
    assert max(map(len, coded[:6])) < 100 and len(coded[6]) < 200


def test_words_met_before_are_not_merged_again(monkeypatch):
    from tokenizers import Tokenizer

    content = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    r = random.Random(8)
    texts = [words(r, 50) + " sixteen" + "x" * 9 + " sixteen" + "x" * 10 + " sixteen" + "x" * 9 + "y can't 12 é, " + "qzj" * 5 for _ in range(20)]
    want = [np.array(e.ids, "<u2").tobytes() for e in Tokenizer.from_str(content).encode_batch(texts, add_special_tokens=False)]
    encoder, merged = token_files.WordEncoder(content), []
    rest = encoder.merged
    monkeypatch.setattr(encoder, "merged", lambda text, starts, stops: merged.append(int((stops - starts).sum())) or rest(text, starts, stops), raising=False)
    assert encoder.encode(texts) == want == encoder.encode(texts)
    assert len(merged) == 2 and merged[1] < merged[0] / 3  # words too long for the table only
    # words that share a place in the table are told apart
    monkeypatch.setattr(token_files, "WORD_BITS", 2)
    crowded = token_files.WordEncoder(content)
    assert [crowded.encode(texts), crowded.encode(texts[:3])] == [want, want[:3]]


def test_token_ids_by_ranks_equal_the_library():
    from tokenizers import Tokenizer

    r = random.Random(4)
    encoder = token_files.WordEncoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    letters = "abcdeinghtors'svelm 012.,!?<|>#$-_ß×÷éÈÿÞþñ µª\t\n\r\x0b\x1c\x85\xa0İσΣ日🙂é"
    texts = ["".join(r.choice(part) for _ in range(r.randint(0, 30))) for part in (letters, letters[:30], "abcdefghijklmnopqrstuvwxyzéß ", "'stmdrevl a!1É\t") for _ in range(2000)]
    texts += ["", " ", "'", "'s", "a'", "'re've'll", "!'s", "''s's", "ÿ ß ÿß", "<|startoftext|>", "a<|endoftext|>b <|ENDOFTEXT|>", "x" * 5000]
    want = [np.array(e.ids, "<u2").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x for k in range(0, len(texts), 256) for x in encoder.encode(texts[k : k + 256])] == want
    assert 0.3 < sum(map(encoder.is_plain, texts)) / len(texts) < 1 and not encoder.is_plain("<|startoftext|>")


def test_token_ids_of_long_texts_go_in_parts():
    encoder = token_files.WordEncoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    r = random.Random(6)
    texts = [words(r, n) for n in (300_000, 5, 0, 150_000, 150_000, 3)]
    assert sum(map(len, texts)) > 2 * token_files.TOGETHER
    assert encoder.encode(texts) == encoder.encode_chunks(texts)


def test_token_ids_of_a_tokenizer_that_keeps_blanks():
    from tokenizers import Tokenizer

    content = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    texts = ["two words", "a  b\n\nc", "", " the end "]
    want = [np.array(e.ids, "<u2").tobytes() for e in Tokenizer.from_str(content).encode_batch(texts, add_special_tokens=False)]
    assert token_files.WordEncoder(content).encode(texts) == want


def test_merges_that_ranks_dont_give_are_left_to_the_library():
    spec = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert token_files.plain_ranks(spec)
    merges, vocab = spec["model"]["merges"], spec["model"]["vocab"]
    # a token whose own merge joins another pair than its merges by rank end in
    k = next(i for i, (a, b) in enumerate(merges) if len(a) > 1 and not b.endswith("</w>") and a[:-1] in vocab and a[-1] + b in vocab and (a + b).isascii() and (a + b).isalpha())
    merges[k] = [merges[k][0][:-1], merges[k][0][-1] + merges[k][1]]
    assert token_files.plain_ranks(spec) is None
    assert token_files.plain_ranks(spec | {"model": spec["model"] | {"dropout": 0.1}}) is None


def test_mixing_finds_the_words_of_a_text_once(spark):
    docs = spark.createDataFrame([(1, "some words, Some"), (2, None)], "doc_id long, text string")
    weights = spark.createDataFrame([(1, 0.5, 0.0, 0.0)], "b int, w0 double, w1 double, w2 double")
    sample = spark.createDataFrame([(1, 0)], "doc_id long, domain int")
    for made in (mixing.evidence(docs, weights), mixing.sampled_words(docs, sample)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
