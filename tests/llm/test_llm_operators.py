"""Each operator against a brute-force version on awkward small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusengine.llm import byte_bpe, exact_dedup, jaccard_join, license_scan, mixing, quality_rules, range_coder, suffix_dedup, token_files, tool_calls, url_filter

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, words string, cover string"


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = [prose(r, r.choice((1, 4, 60, 200))) for _ in range(40)]
    near = []
    for b in base[:12]:
        w = b.split(" ")
        if len(w) > 20:
            w[r.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    long = prose(r, 9000)
    passage = prose(r, 60)
    odd = [None, "", "   ", "\n\t", "Released under the MIT License.\nX", "mit license MIT  LICENSE apache license", "GNU General Public License", "a" * 300, "ééé naïve \x00 ß 日本語 🙂 é", " lead", "trail ", "two  spaces", "x\n x\n x\ny\ny", f"{prose(r, 30)} {passage} {prose(r, 30)}", f"{passage} {prose(r, 5)}", long, long + " end"]
    return base + near + odd + base[:5] + [base[0].replace(" ", "\n"), base[1] + "  "]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", ["a", "b", None][i % 3], None, "k", "r", "w", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def repeated(spark):
    """Null ids and rows that repeat as a whole."""
    t = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(None, t), (None, None), (3, t), (3, t), (2, t + " x"), (2, None)]
    return spark.createDataFrame([(i, x, None, None, None, None, None, None, None) for i, x in rows], SCHEMA)


def test_quality(docs, texts, nothing, repeated):
    got = {r["doc_id"]: r for r in quality_rules.judge_documents(docs).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        cover = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)} if len(w) < 1000 else None
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert got[i]["n_words"] == len(w) and got[i]["word_chars"] == sum(map(len, w)) and got[i]["n_dup_lines"] == len(lines) - len(set(lines))
        assert cover is None or got[i]["n_repeat_words"] == len(cover)
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * got[i]["n_repeat_words"] > 50 * len(w)) and got[i]["kept"] <= (not got[i]["base_failed"])
    assert quality_rules.judge_documents(nothing).count() == 0 and quality_rules.judge_documents(repeated).count() == 6


def test_quality_rejects_only_bad_hosts(spark):
    good = [(i, prose(random.Random(i), 80), "good") for i in range(60)]
    bad = [(100 + i, "spam! " * 200 if i % 20 else prose(random.Random(i), 80), "bad") for i in range(60)]
    got = quality_rules.judge_documents(spark.createDataFrame(good + bad, "doc_id long, text string, source string"))
    assert {r["source"] for r in got.filter("host_rejected").collect()} == {"bad"} and got.filter("kept and source = 'good'").count() == 60


def test_license(docs, texts, nothing, repeated):
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at = {k: [p for p in range(len(w)) if w[p : p + len(s)] == s] for k, s in phrases.items()}
        every = sorted(itertools.chain(*at.values()))
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"]) == (len(w), len(every), every[0] if every else None, every[-1] if every else None)
        assert got[i]["base_labels"] == ",".join(sorted(k for k, v in at.items() if v)) and set(filter(None, got[i]["base_labels"].split(","))) <= set(got[i]["labels"].split(","))
    assert license_scan.scan_licenses(nothing).count() == 0 and license_scan.scan_licenses(repeated).count() == 6


def test_exact_dedup(docs, texts, nothing, repeated):
    for max_bits in (1 << 28, 64):  # a tiny filter is all false positives and still exact
        got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, max_bits=max_bits).collect()}
        norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
        for i in range(len(texts)):
            group = [k for k in range(len(texts)) if norm[k] == norm[i]]
            best = min(group, key=lambda k: (-len(texts[k] or ""), k))
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (best, len(group), best == i, hashlib.sha256(norm[i].encode()).hexdigest())
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert exact_dedup.exact_dedup(repeated).filter("kept").count() == 3


def test_jaccard(docs, texts, nothing, repeated):
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_join(docs, leaf=4, block=3).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])))
    n, root = len(sets), list(range(len(sets)))
    cls = [next(k for k in range(n) if sets[k] == sets[i]) if sets[i] else i for i in range(n)]
    links = [set() for _ in range(n)]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
            if cls[a] != cls[b]:
                links[cls[a]].add(cls[b])
                links[cls[b]].add(cls[a])
    for i in range(n):
        assert (got[i]["class_id"], got[i]["group_id"], got[i]["n_links"], got[i]["kept"]) == (cls[i], find(i), len(links[cls[i]]), find(i) == i)
    assert jaccard_join.jaccard_join(nothing).count() == 0
    assert jaccard_join.jaccard_join(repeated).filter("kept").count() == 3


def test_jaccard_runs_reach_the_recall():
    runs = jaccard_join.number_of_runs(0.8, 3, 0.9995)
    assert (1 - 0.8**3) ** runs <= 0.0005 < (1 - 0.8**3) ** (runs - 1)


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/x?q", "https://www.example.com/en/", "http://x.net/es/1", "http://net/fr/", "http://b.org#f", "no url", None, "http://com", "http://notexample.com/en/", "ftp://u:1/a?b#c", "a\nb://c.com/\n"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(4, 0, 1), (4, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filter.judge_pages(pages, labels).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == ["example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, None, "com/", None, "com/"]
    assert (got[0]["host"], got[0]["path"], got[9]["host"], got[9]["path"], got[5]["host"]) == ("a.example.com", "/en/x", "u:1", "/a", "")
    assert url_filter.judge_pages(pages.limit(0), labels).count() == 0 and url_filter.judge_pages(pages, labels.limit(0)).count() == len(urls)


def test_url_reputation_follows_the_labels(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'fine'}.site.org/{i}") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = url_filter.judge_pages(pages, labels).groupBy("host").agg(F.first("verdict").alias("v"), F.first("bad_low").alias("l"), F.first("bad_rate").alias("r")).collect()
    assert {r["host"]: r["v"] for r in got} == {"bad.site.org": "block", "fine.site.org": "allow"} and all(r["l"] < r["r"] for r in got)


def test_range_coder_round_trip():
    r = np.random.default_rng(2)
    blocks = [np.minimum(r.zipf(1.3, n), 65535).astype(np.uint16) for n in (0, 1, 2, 1023, 1024, 1025, 3000)] + [np.zeros(2500, np.uint16), r.integers(0, 65536, 2100).astype(np.uint16)]
    coded = range_coder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode_blocks(coded, [len(b) for b in blocks]), strict=True))
    assert len(coded[7]) < 20 and range_coder.encode_blocks(blocks[3:4]) == coded[3:4]  # blocks don't depend on each other


def test_token_files(spark, docs, texts, nothing, repeated):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids_of = docs.select("doc_id")
    for per_file in (8192, 20):
        files = token_files.write_files(token_files.token_ids(docs, path, 2), ids_of, per_file)
        got = {r["doc_id"]: r for r in token_files.documents_of(files).collect()}
        start = 0
        for i, t in enumerate(texts):
            ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
            assert (got[i]["start"], got[i]["n_tokens"], bytes(got[i]["ids"])) == (start, len(ids) // 4, ids)
            start += len(ids) // 4
    assert files.filter("not whole").count() > 0
    assert token_files.documents_of(token_files.write_files(token_files.token_ids(nothing, path, 2), nothing.select("doc_id"))).count() == 0
    assert token_files.documents_of(token_files.write_files(token_files.token_ids(repeated, path, 2), repeated.select("doc_id"))).count() == 6
    row = files.first()
    damaged = spark.createDataFrame([row.asDict() | {"crc32": row["crc32"] ^ 1}], files.schema)
    with pytest.raises(Exception, match="damaged"):
        token_files.read_files(damaged).collect()


def test_suffix_dedup(docs, texts, nothing, repeated):
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    raw, first = [(t or "").encode() for t in texts], {}
    for i, b in enumerate(raw):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.suffix_dedup(nothing).count() == 0
    again = suffix_dedup.suffix_dedup(repeated).collect()
    assert len(again) == 6 and all(r["n_removed"] == 0 for r in again if r["doc_id"] is None or r["doc_id"] == 2) and all(r["n_removed"] == r["n_bytes"] for r in again if r["doc_id"] == 3)


def test_loser_tree_merges_with_prefixes():
    r = random.Random(1)
    keys = [bytes(r.choice(b"ab") for _ in range(suffix_dedup.KEY)) for _ in range(60)] + [b"a" * suffix_dedup.KEY] * 3
    runs = [sorted(keys[k::3]) for k in range(3)] + [[]]
    coded = [suffix_dedup.front_code(np.frombuffer(b"".join(x), np.uint8).reshape(-1, suffix_dedup.KEY)) if x else (b"", b"") for x in runs]
    assert [suffix_dedup.front_decode(*c) for c in coded] == runs
    order, prefix = suffix_dedup.merge_runs(runs, [s for s, _ in coded])
    merged = [runs[a][b] for a, b in order]
    assert merged == sorted(keys)
    for a, b, n in zip(merged, merged[1:], prefix[1:], strict=False):
        assert n == next((k for k in range(len(a)) if a[k] != b[k]), len(a))


def test_byte_bpe_equals_tiktoken(spark, docs, texts, nothing):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(open(path, "rb").read())
    same = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.ByteBpe(spark, path, public_tokenizers.PATTERN)
    out = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, codec), codec)
    for r in out.select("doc_id", "ids", "decoded", "n_tokens").collect():
        t = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == same.encode_ordinary(t) and bytes(r["decoded"]) == t.encode() and r["n_tokens"] == len(r["ids"]) // 4
    assert byte_bpe.encode_documents(nothing, codec).count() == 0
    encoder, r = byte_bpe.encoder_of(open(path, "rb").read(), public_tokenizers.PATTERN), random.Random(3)
    fuzz = ["".join(r.choice("ab CD 12é  \n\t'sß日🙂\x1c\x85\xa0.,!▁") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(fuzz)] == [same.encode_ordinary(t) for t in fuzz]


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        kind = (0, 0, 0, 1, 2)[i % 5]
        t = prose(r, 60) + (" nasty vile" if kind == 2 else "") + (" $$$ ### !!!" * 8 if kind == 1 else "")
        rows.append((i, t))
        if i % 3:
            labels.append((i, int(kind != 1), int(kind == 2)))
    rows += [(None, None), (1000, ""), (1, "repeated row")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1, 1), (2000, None, None)], "doc_id long, quality int, toxic int")


def test_mixing(labelled):
    docs, labels = labelled
    rated, fit = mixing.mix_with_fit(docs, labels)
    got = rated.toPandas()
    assert len(got) == 603 and (got.rate >= 0).all() and (abs(got[["p_good", "p_low", "p_toxic"]].sum(axis=1) - 1) < 1e-9).all()
    held_out = got[(got.doc_id < 600) & (got.doc_id % 3 == 0)]
    best = held_out[["p_good", "p_low", "p_toxic"]].to_numpy().argmax(axis=1)
    assert (best == np.array([(0, 0, 0, 1, 2)[int(i) % 5] for i in held_out.doc_id])).mean() > 0.9
    # the same fit in numpy, by plain projected-gradient steps on every document's rate that go on until they settle
    n, p = got.n_tokens.to_numpy(float), got[["p_good", "p_low", "p_toxic"]].to_numpy()
    goal, rate = np.array([0.90, 0.08, 0.02]), np.ones(len(got))
    gram = (p * n[:, None]).T @ p / n.sum()
    safe = 1 / (np.linalg.eigvalsh(gram)[-1] + fit.pull)
    for _ in range(20_000):
        rate = np.maximum(0, rate - safe * (p @ ((rate * n) @ p / n.sum() - goal) + fit.pull * (rate - 1)))
    assert fit.converged and np.allclose(rate, got.rate, atol=2e-2)
    made = (got.rate.to_numpy() * n) @ p / n.sum()
    assert np.allclose(made, [fit.achieved[d] for d in mixing.DOMAINS])
    # the optimum: many plain projected-gradient steps (nonnegative rates can't meet every target here)
    best_rate = np.ones(len(got))
    for _ in range(4000):
        best_rate = np.maximum(0, best_rate - safe * p @ ((best_rate * n) @ p / n.sum() - goal))
    error = lambda x: float(((((x * n) @ p) / n.sum() - goal) ** 2).sum())
    assert error(got.rate.to_numpy()) < error(np.ones(len(got))) / 3 and error(got.rate.to_numpy()) <= error(best_rate) + 1e-3


def test_mixing_priors_count_all_labelled_documents(labelled):
    docs, labels = labelled
    absent = labels.unionByName(labels.sparkSession.createDataFrame([(i, 0, 1) for i in range(5000, 5400)], labels.schema))
    whole, capped, more = (mixing.train(docs, mixing.labelled_domains(docs, x), max_labelled=m) for x, m in ((labels, 20_000), (labels, 80), (absent, 20_000)))
    # 400 labelled ids, one of them (a good one) in two rows
    n = [sum((0, 0, 0, 1, 2)[i % 5] == k for i in range(600) if i % 3) + (k == 0) for k in range(3)]
    assert np.allclose(np.exp(whole[0]), [(x + 1) / (sum(n) + 3) for x in n])
    assert whole[0] == capped[0] == more[0]
    assert whole[1].exceptAll(more[1]).count() == 0
    assert mixing.sample_of(mixing.labelled_domains(docs, labels), 80).count() == 240
    # a word's weight is about the same from a sample of equal class sizes: it is mixed by the sizes of all labels
    b = docs.sparkSession.range(1).select(mixing.bucket(F.lit("nasty")).alias("b"))
    a, c = (x[1].join(b, "b").first()["w2"] for x in (whole, capped))
    assert abs(a - np.log(sum(n) / n[2])) < 0.1 and abs(a - c) < 0.1


def test_fit_rates_reaches_the_optimum_of_small_domains(spark):
    goal = np.array([0.90, 0.08, 0.02])
    frame = lambda n, p: spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "n_tokens double, p_good double, p_low double, p_toxic double")
    for shares in ((0.93, 0.01, 0.06), (0.98, 0.015, 0.005), (0.9, 0.05, 0.05)):
        # pure memberships: the only optimum is target by share
        rated, fit = mixing.fit_rates(frame(1000 * np.array(shares), np.eye(3)))
        got = rated.toPandas()
        made = (got.rate * got.n_tokens).to_numpy() @ got[["p_good", "p_low", "p_toxic"]].to_numpy() / got.n_tokens.sum()
        assert fit.reached and fit.converged and np.abs(made - goal).max() < 1e-3
        assert np.allclose(got.rate, goal / shares, rtol=2e-2)


def test_rates_stay_near_one_where_targets_are_out_of_reach(spark):
    goal, r = np.array([0.90, 0.08, 0.02]), np.random.default_rng(3)
    n, p = r.integers(1, 300, 300), (r.dirichlet([50, 5, 5], 300) + 0.1) / 1.3
    rated, fit = mixing.fit_rates(spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "n_tokens double, p_good double, p_low double, p_toxic double"))
    rate = rated.toPandas().rate.to_numpy()
    assert fit.converged and not fit.reached
    likely = p[:, 0] > 0.5
    assert n[likely & (rate < 0.5)].sum() <= mixing.MAY_LOSE * n[likely].sum() and rate.max() < 3
    best = np.ones(300)
    for _ in range(5000):
        best = np.maximum(0, best - 0.5 * (p @ ((best * n) @ p / n.sum() - goal) + fit.pull * (best - 1)))
    assert np.allclose(best, rate, atol=1e-2)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_mixing_of_the_given_tables(spark, size):
    """Good documents stay and toxic ones are thinned, with few labels and with many."""
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    rated, fit = mixing.mix_with_fit(docs, labels)
    got = corpus_pipeline.with_copies(rated).join(mixing.labelled_domains(docs, labels), "doc_id").toPandas()
    kept = got.assign(kept=got.copies > 0).groupby("domain").kept.mean()
    assert fit.converged and got.p_toxic.nunique() > len(got) / 4 and got.rate.max() < 3
    assert kept[0] >= 0.9 and kept[2] < 0.5
    tokens = (got.copies * got.n_tokens).groupby(got.domain).sum()
    assert abs(tokens / tokens.sum() - [0.90, 0.08, 0.02]).max() < 0.07


def test_mixing_without_rows_or_labels(labelled):
    docs, labels = labelled
    assert mixing.mix(docs.limit(0), labels).count() == 0
    assert mixing.mix(docs, labels.limit(0)).filter("abs(3 * p_good - 1) > 1e-9").count() == 0


def test_tool_calls(spark):
    schemas = {"add": {"a": ("integer", True), "b": ("number", False)}}
    calls = spark.createDataFrame([("c", 0, "1", "add", {"a": "1"}, None), ("c", 2, "2", "add", {"a": "x", "z": "1"}, "1"), ("c", 4, "3", "add", {"b": "2.5", "a": "7"}, "2"), ("c", 6, "4", "nope", {}, "9"), ("c", 7, "5", "add", None, "6"), ("c", 8, "6", "add", {"a": "1"}, "5"), ("c", 9, "1", "add", {"a": "2"}, None), (None, 1, "1", "add", {"a": "2"}, None), ("d", 0, "1", "add", {"a": "1"}, None)], "conv_id string, turn long, call_id string, name string, arguments map<string,string>, after string")
    results = spark.createDataFrame([("c", 3, "1", 'two "q"\n'), ("c", 1, "1", "one"), ("c", 5, "3", None), ("c", 5, "77", "lost")], "conv_id string, turn long, call_id string, content string")
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.link_calls(calls, results, schemas).collect()}
    assert len(got) == 7
    assert [got["c", k]["level"] for k in "123456"] == [0, 1, 2, 0, None, None]
    assert [got["c", k]["status"] for k in "123456"] == ["linked", "invalid", "linked", "invalid", "cyclic", "cyclic"] and got["d", "1"]["status"] == "pending"
    assert got["c", "2"]["errors"] == "a is no integer; unexpected z" and got["c", "4"]["errors"] == "unknown tool" and got["c", "5"]["errors"] == "no arguments"
    assert got["c", "1"]["n_results"] == 2 and got["c", "1"]["json"] == '{"after":null,"arguments":{"a":1},"id":"1","name":"add","result":"one"}'
    assert got["c", "3"]["json"].startswith('{"after":"2","arguments":{"a":7,"b":2.5}')
    assert tool_calls.orphans(calls, results).count() == 1
    assert tool_calls.link_calls(calls.limit(0), results, schemas).count() == 0 and tool_calls.link_calls(calls, results.limit(0), schemas).filter("n_results > 0").count() == 0


def test_long_chains_take_few_joins(spark):
    calls = spark.range(1000).select(F.lit("c").alias("conv_id"), F.col("id").cast("string").alias("call_id"), (F.col("id") - 1).cast("string").alias("after"))
    got = tool_calls.levels(calls).select("call_id", "level").collect()
    assert all(int(r["call_id"]) == r["level"] for r in got)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram jaccard join", "mixing to target weights", "byte-level bpe"]
    r = random.Random(4)
    clean = [prose(r, 120) for _ in range(40)]
    w = clean[1].split(" ")
    w[60] = "other"
    rows = [(i, t) for i, t in enumerate(clean)] + [(40, "short"), (41, "again and again " * 40), (42, clean[0] + " "), (43, clean[0]), (44, " ".join(w)), (45, None), (46, clean[2]), (46, clean[2])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the longer copy stays of equal texts, the smallest id of near copies
    assert sorted(x["doc_id"] for x in out) == sorted([42] + list(range(1, 40)))
    assert all(x["decoded_sha256"] and len(x["ids"]) == 4 * x["n_tokens"] for x in out)


def test_pipeline_mixing_meets_the_targets(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    kinds = [0] * 3000 + [1] * 520 + [2] * 480
    docs = spark.createDataFrame([(i, prose(r, 40) + "".join(f" {('fine', 'dull', 'vile')[k]}{j}" for j in range(12))) for i, k in enumerate(kinds)], "doc_id long, text string")
    spark.createDataFrame([(i, int(k != 1), int(k == 2)) for i, k in enumerate(kinds)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = [x["doc_id"] for x in corpus_pipeline.mixing(spark, docs, str(tmp_path)).collect()]
    tokens = np.zeros(3)
    for i in out:
        tokens[kinds[i]] += 1  # all texts have 52 words
    assert len(out) == len(set(out)) and sum(kinds[i] == 0 for i in out) > 2950
    assert np.abs(tokens / tokens.sum() - [0.90, 0.08, 0.02]).max() < 0.012
    assert sorted(out) == sorted(x["doc_id"] for x in corpus_pipeline.mixing(spark, docs.repartition(7), str(tmp_path)).collect())


def test_thinning_meets_the_targets_of_a_scarce_domain(spark):
    import corpus_pipeline

    kind = F.when(F.col("id") % 100 < 93, 0).when(F.col("id") % 100 < 94, 1).otherwise(2)
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("text_key"), F.lit(50).alias("n_tokens"), *[F.when(kind == k, 1.0).otherwise(0.0).alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)])
    out = corpus_pipeline.thinned(mixing.fit_rates(rows)[0]).filter("kept").agg(*[F.avg(f"p_{d}") for d in mixing.DOMAINS]).first()
    assert np.abs(np.array(out) - [0.90, 0.08, 0.02]).max() < 0.012


def test_crc_of_ids_is_over_32_bit_integers():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")
