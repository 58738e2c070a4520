"""The automaton against edit distances, contexts, what is learned, and held-out accuracy."""

import random

import pytest
from pyspark.sql import functions as F

from corpusengine.llm import toxicity
from corpusengine.llm.queries import op13_toxicity
from corpusengine.llm.toxicity import Automaton, Term, contexts, score_documents, train


def edits(a: str, b: str) -> int:
    """Edits with swaps of neighbours, each place edited once."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distance():
    r = random.Random(2)
    terms = [Term("idiot", False, 1.0), Term("pathetic", False, 1.0), Term("disgusting", False, 1.0), Term("scum", False, 1.0), Term("lowei", True, 1.0), Term("ab", True, 1.0), Term("lostrand", True, 1.0)]
    made = Automaton(terms)
    words = {"", "idoit", "id1ot", "idiots", "diot", "iidiot", "scam", "scum", "disgstin", "dsigutsing", "disgusting" * 3, "loweiß", "lwoeixx", "abc", "a", "b", "x" * 200}
    for t in terms:
        for _ in range(300):
            w = list(t.text + "".join(r.choice("abxé") for _ in range(r.randrange(4)) if t.stem))
            for _ in range(r.randrange(4)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randrange(2)] = r.choice(("", "q", "i", "ß"))
            words.add("".join(w))
    words = sorted(words)
    got = made.matches(words)
    for w in words:
        whole = [(edits(w, t.text), k) for k, t in enumerate(terms) if not t.stem and edits(w, t.text) <= t.edits]
        begun = [(e, k) for k, t in enumerate(terms) if t.stem and (e := min(edits(w[:n], t.text) for n in range(len(w) + 1))) <= t.edits]
        want = min([e for e, _ in whole + begun], default=None)
        assert (w in got) == (want is not None), w
        if want is not None:
            assert got[w][1] == want and (want, got[w][0]) in whole + begun, w


@pytest.mark.parametrize(
    ("text", "want"),
    [("you idiot", "plain"), ('she heard "idiot" twice', "quoted"), ('"so" an idiot "then"', "plain"), ("er rief „idiot“ dort", "quoted"), ("the word idiot is rude", "reported"), ('"open\nidiot"', "plain"), ("« idiot »", "quoted"), ("»idiot«", "quoted")],
)
def test_contexts(text, want):
    at = text.index("idiot")
    assert contexts(text, at, at + 5, [at])[0] == want


def made_up(spark, n=600, seed=4):
    r = random.Random(seed)
    calm = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("nt", "rl", "sk", "mm")]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(calm) for _ in range(r.randint(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words[r.randrange(len(words))] = r.choice(("zwerpol", "vloxarin", "quimza" + r.choice(calm)))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), calm


def test_learned_lexicon_and_scores(spark):
    docs, labels, calm = made_up(spark)
    model = train(docs, labels)
    assert {(t.text, t.stem) for t in model.automaton.terms} == {("zwerpol", False), ("vloxarin", False), ("quimza", True)}
    base = " ".join(calm[:30])
    cases = {1: base, 2: base + " zwerpol", 3: base + " zwerpl " + base, 4: base + ' "zwerpol" ' + base, 5: None, 6: "", 7: base + " vlxoarin", 8: base + " quimzaxyz", 9: base + ' "zwerpl" ' + base, 10: (base + " ") * 8000 + "zwerpol"}
    rows = [(i, t, 1.0) for i, t in cases.items()] + [(None, "zwerpol", 1.0)] * 2
    got = [(r["doc_id"], r["score"]) for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string, score double"), model).collect()]
    score = dict(got)
    assert len(got) == len(rows) and score[1] == score[5] == score[6] < 0.1
    assert min(score[k] for k in (2, 3, 7, 8, 10, None)) > 0.5
    assert score[4] < score[2] and score[9] < score[3]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    for labels in (none, none.limit(0), spark.createDataFrame([(1, 0)], "doc_id long, toxic int"), spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, toxic int")):
        model = train(docs, labels)
        assert not model.automaton.terms and all(0 <= r["score"] <= 1 for r in score_documents(docs, model).collect())
        assert score_documents(docs.limit(0), model).count() == 0


def test_clean_variants_are_exceptions(spark):
    docs, labels, _ = made_up(spark)
    more = spark.createDataFrame([(10_000 + i, "a wording with zwerpul in it") for i in range(8)], "doc_id long, text string")
    model = train(docs.unionByName(more), labels.unionByName(more.select("doc_id", F.lit(0).alias("toxic"))))
    assert model.exceptions == {"zwerpul"}


def test_held_out_accuracy(spark):
    """On the given tables, over held-out labels: toxic documents with a term are found and clean ones left alone."""
    folder = "/root/testdata/sf0.01"
    got = op13_toxicity(spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet").filter("toxic is not null"), "doc_id").toPandas()
    hit, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert len(hit) >= 5 and (clean.predicted == 0).mean() > 0.97 and (hit.predicted == 1).mean() >= 0.5
    order = got.score.rank()
    auc = (order[got.toxic == 1].sum() - len(hit) * (len(hit) + 1) / 2) / (len(hit) * len(clean))
    assert auc > 0.7
