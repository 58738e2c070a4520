"""Toxicity scores from a learned lexicon, misspellings included, and the context of each hit.

Learning: words, and beginnings of words, that stand in toxic documents far more often than
in others (log-likelihood ratio) become a lexicon of terms and stems. A trie of it,
intersected with a Levenshtein automaton of one edit (two for long terms; neighbours
swapped count as one edit), is determinised to one table of states, which all distinct
words of a batch walk through together. Variants that clean labelled documents use
themselves are exceptions.

Each hit gets a weight by its term's purity and a context by its window: quoted, where
quotation marks open before it and close after it within ``WINDOW`` characters of its line;
reported, where another word of the window is a reporting word; else plain. A hit with
other hits in its window counts again as part of a cluster. Sums by kind of hit and context go
through a logistic model that is fitted on the labelled documents, around prior weights that
say what a kind means as long as no document has shown it: misspelled hits a little less than
exact ones, quoted hits much less than plain ones.

The lexicon and the model are learned on at most ``max_labelled`` documents a label (the
smallest hashes of the ids), copies once. Only ``learn_from`` rows are used.

Defined results: a null text counts as empty and has the score of a text without hits;
labels with null id or null mark are not used, of several labels of one id the worst
counts; without toxic labels there are no terms, and the score is the prior; null ids are
not held out and not learned from; repeated rows are scored each; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusengine.llm.mixing import least_triple
from corpusengine.session import materialize, small_batches

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Shortest stem and longest one in characters, least documents of a term, most terms.
STEMS, LEAST_DOCS, MAX_TERMS = (3, 12), 4, 256
#: Least odds of a term, and its least log-likelihood ratio beyond what the best of as many chance terms reaches.
LEAST_ODDS, LEAST_RATIO = 8.0, 12.0
#: Lengths from which a term may be misspelled by one edit and by two; stems need three letters more.
ONE_EDIT, TWO_EDITS = 5, 9
#: Purity from which a term may be misspelled.
SURE = 0.99
WINDOW, CLUSTER = 160, 12
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’"}
REPORTING = frozenset("said says wrote writes quoted quote called word term dit écrit appelé mot sagte schrieb genannt wort dijo escribió llamó palabra".split())
#: Kinds of hits by context, and the log odds of a text with one plain hit of each, and what other contexts take away, before any document has shown it.
KINDS = ("exact", "misspelled", "stem", "misspelled_stem")
CONTEXTS = ("plain", "quoted", "reported")
PRIOR = {"exact": 3.0, "misspelled": 2.0, "stem": 2.5, "misspelled_stem": -0.5}
DISCOUNT = {"plain": 0.0, "quoted": 4.5, "reported": 3.5}
FEATURES = (*[f"{k}_{c}" for k in KINDS for c in CONTEXTS], "cluster")
#: Variance of a weight around its prior.
SPREAD = 4.0


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    purity: float

    @property
    def edits(self) -> int:
        n = (len(self.text) - 3 * self.stem) * (self.purity >= SURE)
        return 2 if n >= TWO_EDITS else 1 if n >= ONE_EDIT else 0


@dataclass
class Automaton:
    """The determinised table: ``step[state, class of the character]``; state 0 is dead, 1 the start."""

    terms: list[Term]
    classes: dict[str, int] = field(default_factory=dict)
    step: np.ndarray | None = None
    #: Best (term, edits) of a state for words that end there, and for words that go on; -1 where none is.
    whole: np.ndarray | None = None
    begun: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.classes = {c: k for k, c in enumerate(sorted({c for t in self.terms for c in t.text}), 1)}
        self.letters = np.array([ord(c) for c in self.classes], dtype=np.uint32)
        children: list[dict[int, int]] = [{}]
        most, of_node = [0], [-1]
        for k, t in enumerate(self.terms):
            at = 0
            for c in t.text:
                nxt = children[at].setdefault(self.classes[c], len(children))
                if nxt == len(children):
                    children.append({})
                    most.append(0)
                    of_node.append(-1)
                at = nxt
                most[at] = max(most[at], t.edits)
            most[0] = max(most[0], t.edits)
            of_node[at] = k if of_node[at] < 0 or self.terms[of_node[at]].stem else of_node[at]
        self._children, self._most, self._of_node = children, most, of_node
        self._build()

    def _close(self, found: dict[tuple[int, int], int]) -> frozenset:
        """``found`` ((node, awaited class or 0) -> edits) and what deletions reach, without what no term allows."""
        todo = list(found.items())
        while todo:
            (node, want), e = todo.pop()
            if want or found[node, want] < e:
                continue
            for child in self._children[node].values():
                if e + 1 <= self._most[child] and found.get((child, 0), 9) > e + 1:
                    found[child, 0] = e + 1
                    todo.append(((child, 0), e + 1))
        return frozenset((n, w, e) for (n, w), e in found.items() if e <= self._most[n])

    def _next(self, state: frozenset, c: int) -> frozenset:
        found: dict[tuple[int, int], int] = {}

        def reach(node: int, want: int, e: int) -> None:
            if e <= self._most[node] and found.get((node, want), 9) > e:
                found[node, want] = e

        for node, want, e in state:
            if want:
                if want == c:
                    reach(node, 0, e)
                continue
            for a, child in self._children[node].items():
                reach(child, 0, e if a == c else e + 1)
                if a != c and c in self._children[child]:
                    reach(self._children[child][c], a, e + 1)
            reach(node, 0, e + 1)
        return self._close(found)

    def _best(self, state: frozenset, stems: bool) -> tuple[int, int]:
        hits = [(e, -self.terms[k].purity, k) for n, w, e in state if not w and (k := self._of_node[n]) >= 0 and e <= self.terms[k].edits and self.terms[k].stem == stems]
        return (min(hits)[2], min(hits)[0]) if hits else (-1, 0)

    def _build(self) -> None:
        start = self._close({(0, 0): 0})
        states: dict[frozenset, int] = {frozenset(): 0, start: 1}
        order, rows = [frozenset(), start], [[0] * (len(self.classes) + 1)]
        k = 1
        while k < len(order):
            row = []
            for c in range(len(self.classes) + 1):
                nxt = self._next(order[k], c)
                if nxt not in states:
                    states[nxt] = len(order)
                    order.append(nxt)
                row.append(states[nxt])
            rows.append(row)
            k += 1
        self.step = np.array(rows, dtype=np.int32)
        self.whole, self.begun = (np.array([self._best(s, stems) for s in order], dtype=np.int32) for stems in (False, True))

    def matches(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """Of ``words``, those that a term matches, with the term and its edits; a whole term goes before a stem, fewer edits first."""
        if not self.terms or not words:
            return {}
        longest = max(len(t.text) + t.edits for t in self.terms) + 1
        # no character beyond the longest term and its edits decides anything but whether the word goes on
        sizes = np.array([len(w) for w in words])
        out: dict[str, tuple[int, int]] = {}
        chars = np.array([w[:longest] for w in words]).view(np.uint32).reshape(len(words), -1)
        at = np.searchsorted(self.letters, chars)
        at[at == len(self.letters)] = 0
        kinds = np.where(self.letters[at] == chars, at + 1, 0)
        state, live = np.ones(len(words), dtype=np.int32), np.arange(len(words))
        best = np.full((len(words), 2), -1, dtype=np.int32)
        for k in range(chars.shape[1] + 1):
            # a stem counts where its word has as many characters as were read, or more
            hit = self.begun[state]
            better = (hit[:, 0] >= 0) & ((best[live, 0] < 0) | (hit[:, 1] < best[live, 1]))
            best[live[better]] = hit[better]
            done = sizes[live] == k
            for j in np.flatnonzero(done & (self.whole[state, 0] >= 0)):
                out[words[live[j]]] = (int(self.whole[state[j], 0]), int(self.whole[state[j], 1]))
            go = ~done if k < chars.shape[1] else np.zeros(len(live), dtype=bool)
            live, state = live[go], state[go]
            if not len(live):
                break
            state = self.step[state, kinds[live, k]]
            live, state = live[state > 0], state[state > 0]
        for j in np.flatnonzero(best[:, 0] >= 0):
            found = (int(best[j, 0]), int(best[j, 1]))
            if words[j] not in out or out[words[j]][1] > found[1]:
                out[words[j]] = found
        return out


@dataclass
class Model:
    automaton: Automaton
    exceptions: frozenset[str]
    bias: float
    weights: np.ndarray


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def contexts(text: str, start: int, end: int, hits: list[int]) -> tuple[str, bool]:
    """The context of a hit at ``start`` to ``end``, and whether other ``hits`` (word starts) cluster around it."""
    low, high = max(text.rfind("\n", 0, start) + 1, start - WINDOW), text.find("\n", end)
    high = min(len(text) if high < 0 else high, end + WINDOW)
    left, right = text[low:start], text[end:high]
    near = any(h != start and abs(h - start) <= CLUSTER * 8 for h in hits)
    for opening, closings in QUOTES.items():
        at = left.rfind(opening)
        if at < 0 or not any(c in right for c in closings):
            continue
        # marks that open and close alike must be odd in number on the left; the others must not be closed again
        if left.count(opening) % 2 if opening in closings else not any(c in left[at + 1 :] for c in closings):
            return "quoted", near
    if not REPORTING.isdisjoint(re.findall(WORD, left)[-CLUSTER // 2 :]):
        return "reported", near
    return "plain", near


def features_of(texts: list[str], automaton: Automaton, exceptions: frozenset[str]) -> tuple[np.ndarray, list[list[str]]]:
    """A row of ``FEATURES`` for each text, and the misspelled words that were found in it."""
    texts = [t.lower() for t in texts]
    words = [re.findall(WORD, t) for t in texts]
    every = set().union(*words) if words else set()
    found = {w: m for w, m in automaton.matches(list(every)).items() if not (m[1] and w in exceptions)}
    out, variants = np.zeros((len(texts), len(FEATURES))), [[] for _ in texts]
    for k, t in enumerate(texts):
        if found.keys().isdisjoint(words[k]):
            continue
        at = [(m.start(), m.end(), m[0]) for m in re.finditer(WORD, t) if m[0] in found]
        starts = [a for a, _, _ in at]
        for i, (a, b, w) in enumerate(at):
            term, edits = found[w]
            kind = ("misspelled_stem" if edits else "stem") if automaton.terms[term].stem else "misspelled" if edits else "exact"
            context, near = contexts(t, a, b, starts[max(0, i - 1) : i + 2])
            out[k, FEATURES.index(f"{kind}_{context}")] += automaton.terms[term].purity
            out[k, -1] += near and context == "plain"
            if edits:
                variants[k].append(w)
    # the first hit says most, further ones less and less
    return np.log2(1 + out), variants


def toxic_labels(docs: DataFrame, labels: DataFrame, learn_from: Column | None, max_labelled: int, text: str, doc_id: str) -> tuple[DataFrame, float]:
    """(text, toxic) of the learning sample, copies once, and the log of how much rarer clean documents are in it than among all."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if learn_from is not None:
        known = known.filter(learn_from)
    known = materialize(docs.select(F.col(doc_id).alias("doc_id")).distinct().join(known, "doc_id"))
    order = F.xxhash64("doc_id")
    sample = known.filter("toxic = 1").orderBy(order, "doc_id").limit(max_labelled).unionByName(known.filter("toxic <> 1").orderBy(order, "doc_id").limit(max_labelled))
    sizes = {bool(r["t"]): r["count"] for r in known.groupBy((F.col("toxic") == 1).alias("t")).count().collect()}
    scale = np.log(max(sizes.get(False, 0), 1) / max(min(sizes.get(False, 0), max_labelled), 1)) - np.log(max(sizes.get(True, 0), 1) / max(min(sizes.get(True, 0), max_labelled), 1))
    met = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    # near copies share their least word triple, mostly
    met = met.withColumn("ws", words_of(F.col("text")))
    one = met.groupBy("toxic", least_triple(F.col("ws")).alias("copy")).agg(F.min_by("text", "doc_id").alias("text"))
    return materialize(one.select("text", "toxic")), float(scale)


def learn_terms(sample: DataFrame) -> list[Term]:
    """Terms and stems of the lexicon, from (text, toxic)."""
    words = F.array_distinct(words_of(F.col("text")))
    low, high = STEMS
    cut = lambda w: F.transform(F.sequence(F.lit(low), F.least(F.length(w), F.lit(high))), lambda k: F.substr(w, F.lit(1), k))
    long = F.filter("ws", lambda w: F.length(w) >= low)
    # a beginning is written with a star, so that it differs from the word
    begun = F.transform(F.array_distinct(F.flatten(F.transform(long, cut))), lambda p: F.concat(p, F.lit("*")))
    terms = sample.select("toxic", words.alias("ws")).select("toxic", F.explode(F.concat("ws", begun)).alias("term"))
    counts = terms.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") != 1).alias("n0")).filter(F.col("n1") >= LEAST_DOCS)
    sizes = {bool(r["t"]): r["count"] for r in sample.groupBy((F.col("toxic") == 1).alias("t")).count().collect()}
    m1, m0 = sizes.get(True, 0), sizes.get(False, 0)
    if not m1:
        return []
    counts = materialize(counts)
    least = LEAST_RATIO + 2 * np.log(max(counts.count(), 1))
    n1, n0, share = F.col("n1"), F.col("n0"), m1 / (m1 + m0)
    # a term that stands in toxic documents only has a ratio of 2 log(1 / share) a document, and no other has more
    rows = counts.filter((-2 * n1 * float(np.log(max(share, 1e-9))) >= float(least)) & ((n1 + 0.5) / (m1 + 1) >= LEAST_ODDS * (n0 + 0.5) / (m0 + 1)))
    seen = {r["term"]: (r["n1"], r["n0"]) for r in rows.orderBy(F.desc(n1 - n0 * share), "term").limit(MAX_TERMS * 64).collect()}
    return choose(seen, m1, m0, float(least))


def choose(seen: dict[str, tuple[int, int]], m1: int, m0: int, least: float) -> list[Term]:
    """Terms out of candidates (beginnings end in a star) with their toxic and clean documents, the most telling first.

    Of a term and its beginnings the most telling one is taken, the word before its
    beginnings and the longer before the shorter; what it covers is taken off the others.
    """
    share = m1 / (m1 + m0)

    def ratio(n1: int, n0: int) -> float:
        both = n1 + n0
        return 2 * sum(n * np.log(n / (both * s)) for n, s in ((n1, share), (n0, 1 - share)) if n > 0 and s > 0)

    def telling(n1: int, n0: int) -> float:
        fits = n1 >= LEAST_DOCS and (n1 + 0.5) / (m1 + 1) >= LEAST_ODDS * (n0 + 0.5) / (m0 + 1)
        return float(ratio(n1, n0)) if fits else 0.0

    left, out = dict(seen), []
    score = {t: telling(*n) for t, n in left.items()}
    while score and len(out) < MAX_TERMS:
        best = max(score, key=lambda t: (round(score[t], 6), not t.endswith("*"), len(t), t))
        if score[best] < least:
            break
        n1, n0 = left.pop(best)
        score.pop(best)
        stem, text = best.endswith("*"), best.rstrip("*")
        out.append(Term(text, stem, (n1 / m1) / (n1 / m1 + ((n0 + 0.5) / m0 if m0 else 0.0))))
        for t in list(left):
            if stem and t.startswith(text):
                left.pop(t)
                score.pop(t)
            elif t.endswith("*") and text.startswith(t[:-1]):
                left[t] = (max(left[t][0] - n1, 0), max(left[t][1] - n0, 0))
                score[t] = telling(*left[t])
    return out


def fit(x: np.ndarray, y: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """Bias and weights, by Newton steps around the prior weights; ``scale`` lifts the odds of clean documents to those of all."""
    said = np.array([PRIOR[k] - DISCOUNT[c] for k in KINDS for c in CONTEXTS])
    z = np.hstack([np.ones((len(x), 1)), x])
    precision = np.concatenate([[0.05], np.full(len(FEATURES), 1 / SPREAD)])
    w = np.concatenate([[-2.0], said + 2.0, [0.5]])
    for _ in range(4):
        # a prior weight lifts a text from the odds without hits to those that the prior states
        center = np.concatenate([[-2.0], said - w[0], [0.5]])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (p - y) + precision * (w - center)
            hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(precision)
            step = np.linalg.solve(hessian, gradient)
            w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-6:
                break
    # more of a hit never speaks for a clean document
    return float(w[0] - scale), np.maximum(w[1:], 0.0)


def train(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, max_labelled: int = 10_000, text: str = "text", doc_id: str = "doc_id") -> Model:
    """Lexicon, exceptions and weights from at most ``max_labelled`` labelled documents a label."""
    sample, scale = toxic_labels(docs, labels, learn_from, max_labelled, text, doc_id)
    automaton = Automaton(learn_terms(sample))
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, variants = features_of([t or "" for t in batch.column(0).to_pylist()], shared.value, frozenset())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), type=pa.list_(pa.float64())), pa.array(variants, type=pa.list_(pa.string()))], names=["toxic", "x", "variants"])

    found = materialize(sample.select("text", "toxic").mapInArrow(run, "toxic int, x array<double>, variants array<string>"))
    clean = found.filter("toxic <> 1").select(F.explode(F.array_distinct("variants")).alias("w")).groupBy("w").count()
    dirty = found.filter("toxic = 1").select(F.explode(F.array_distinct("variants")).alias("w")).groupBy("w").agg(F.count("*").alias("toxic"))
    # a variant is an exception where clean documents hold it as often as toxic ones
    exceptions = frozenset(r["w"] for r in clean.join(dirty, "w", "left").filter(F.col("count") >= F.coalesce("toxic", F.lit(0))).select("w").collect())
    rows = sample.select("text", "toxic").mapInArrow(lambda batches: _again(batches, shared, exceptions), "toxic int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    bias, weights = fit(x, (rows["toxic"].to_numpy() == 1).astype(float), scale)
    return Model(automaton, exceptions, bias, weights)


def _again(batches: Iterator[pa.RecordBatch], shared, exceptions: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, _ = features_of([t or "" for t in batch.column(0).to_pylist()], shared.value, exceptions)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), type=pa.list_(pa.float64()))], names=["toxic", "x"])


def score_documents(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, n_hits by kind) of every document, over whole texts."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(texts), 128):
                x, _ = features_of(texts[at : at + 128], model.automaton, model.exceptions)
                score = 1 / (1 + np.exp(-np.clip(model.bias + x @ model.weights, -500, 500)))
                quoted = [x[:, [i for i, f in enumerate(FEATURES) if f.endswith(c)]].sum(axis=1) for c in CONTEXTS]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 128], pa.array(score), *map(pa.array, quoted)], names=["doc_id", "score", *CONTEXTS])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, plain double, quoted double, reported double")
