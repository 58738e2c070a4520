"""Mixing sources to target weights with soft domain membership.

A naive Bayes classifier, trained on one half of the labelled documents, sums up what the
words of a document say for each domain. The other half tells what such sums are worth: a
multinomial logistic model of the sums and the length, fitted on it, gives each document its
posteriors, so sums that saturate on long texts, and the absence of telling words, count as
they turn out.

Least squares with projected gradients then fits a nonnegative rate for each document so
that the expected token total of each domain meets its target, with a pull of all rates
towards 1. The gradient of a document's rate is its posteriors times the errors of the
domains, so the sum of all steps so far is one number a domain, and projection gives the
rate back: max(0, 1 - p y). A step is one aggregate. The pull is weakened by powers of ten
until targets are met, but not to where good tokens lose half their rate: where the posteriors
can't tell domains apart well enough for the targets, rates stay near 1, and ``Fit`` says
what was reached.

Word weights may be trained on a bounded sample of the labels (``max_labelled`` a domain, the
smallest hashes of the ids), in which copies, known by their least word triple, count once,
and so may the logistic model; priors, features, totals and rates cover all documents.

Defined results: a null text counts as empty (no tokens, the posterior is the prior);
labels with null id, quality and toxic both null, or of no document are not used; of
several labels of one id the worst counts; repeated rows are documents of their own; extra
columns are not read. Without labels every domain is equally likely. Without tokens all
rates are 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusengine.session import materialize

DOMAINS = ("good", "low", "toxic")
#: Share of all tokens that each domain shall have.
TARGETS = {"good": 0.90, "low": 0.08, "toxic": 0.02}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
N_BUCKETS = 1 << 18
#: Least log-likelihood ratio of a word that tells domains apart: about what the best of as many chance words as there are buckets reaches.
MIN_RATIO = 24.0
#: Ridge of the logistic model's slopes.
RIDGE = 1.0
#: Pulls that are tried, the strongest first; the share of good tokens that may lose half their rate; steps of the grid that posteriors are gathered on for the fit.
PULLS, MAY_LOSE, GRID = tuple(10.0**-k for k in range(1, 5)), 0.05, 512
#: Share of its target by which a domain may miss it and still counts as met.
CLOSE = 0.05


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def features(text: Column, words: Column | None = None) -> Column:
    """Distinct words of a text, and four traits of its shape as words that no text has.

    ``words`` is a column of ``words_of(text)``: where this is used in a lambda or in an
    ``explode``, words that are an expression are found anew at each use.
    """
    body = F.coalesce(text, F.lit(""))
    words = words_of(text) if words is None else words
    share = lambda part, whole: F.floor(20 * part / F.greatest(whole, F.lit(1)))
    size = F.length(body)
    distinct = F.array_distinct(words)
    traits = {
        # what is neither in a word nor the blank after it
        "signs": share(size - F.length(F.array_join(words, " ")), size),
        "capitals": share(F.size(F.split(body, "[A-Z]")) - 1, size),
        "distinct": share(F.size(distinct), F.size(words)),
        "length": F.floor(F.log2(F.size(words) + 1.0)),
    }
    return F.concat(distinct, F.array(*[F.concat(F.lit(f"<{k} "), v.cast("string"), F.lit(">")) for k, v in traits.items()]))


def least_triple(w: Column) -> Column:
    """The least hash of three words in a row of the array column ``w``; copies of a text, also with some words changed, mostly share it."""
    triples = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) > 2, F.array_min(triples)).otherwise(F.xxhash64(w))


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(N_BUCKETS)).cast("int")


def labelled_domains(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, domain, n) of every labelled id of ``docs``; n counts its rows there."""
    known = labels.filter("doc_id is not null and (quality is not null or toxic is not null)")
    worst = known.groupBy("doc_id").agg(F.max(F.when(F.coalesce("toxic", F.lit(0)) == 1, 2).when(F.coalesce("quality", F.lit(1)) == 0, 1).otherwise(0)).alias("domain"))
    return docs.select(F.col(doc_id).alias("doc_id")).join(worst, "doc_id").groupBy("doc_id", "domain").agg(F.count("*").alias("n"))


def sample_of(labelled: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """At most ``max_labelled`` ids a domain, chosen by hash of the id."""
    parts = [labelled.filter(F.col("domain") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled) for k in range(len(DOMAINS))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sizes_of(labelled: DataFrame) -> list[int]:
    sizes = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    return [sizes.get(k, 0) for k in range(len(DOMAINS))]


def sampled_words(docs: DataFrame, sample: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(domain, doc_id, copy, b) of the documents of ``sample`` (doc_id, domain): the least word triple, and the buckets of the words."""
    seen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample.select("doc_id", "domain")), "doc_id")
    seen = seen.withColumn("words", words_of(F.col("text")))
    return seen.select("domain", "doc_id", least_triple(F.col("words")).alias("copy"), F.transform(features(F.col("text"), F.col("words")), bucket).alias("b"))


def train(docs: DataFrame, labelled: DataFrame, text: str = "text", doc_id: str = "doc_id", max_labelled: int = 20_000) -> tuple[list[float], DataFrame]:
    """Log priors of all labelled documents, and the weights of the word buckets that tell domains apart.

    Words are counted in a sample (``sample_of``), which is broadcast, once a document and
    group of copies; where domains are mixed, a domain's counts are weighted back to its share
    of all labelled documents. The weights have at most ``N_BUCKETS`` rows.
    """
    labelled = materialize(labelled)
    sample = materialize(sample_of(labelled, max_labelled))
    sizes = sizes_of(labelled)
    priors = [math.log((x + 1) / (sum(sizes) + len(sizes))) for x in sizes]
    seen = materialize(sampled_words(docs, sample, text, doc_id))
    one = materialize(seen.groupBy("domain", "copy").agg(F.min(F.struct("doc_id", "b")).alias("d")).select("domain", "d.b"))
    found = {r["domain"]: r["count"] for r in one.groupBy("domain").count().collect()}
    n = [found.get(k, 0) for k in range(len(DOMAINS))]
    words = one.select("domain", F.explode_outer("b").alias("b"))
    counts = words.groupBy("b").agg(*[F.count_if(F.col("domain") == k).alias(f"c{k}") for k in range(len(DOMAINS))])

    def mixed(domains: list[int]) -> tuple[Column, int]:
        """Count of a word in ``domains``, mixed by their sizes at the scale of the sample, and that sample's size."""
        m, every = sum(n[j] for j in domains), sum(sizes[j] for j in domains)
        scale = {j: sizes[j] * m / (n[j] * every) if n[j] else 0.0 for j in domains}
        count = sum((F.col(f"c{j}") * scale[j] for j in domains), F.lit(0.0))
        return count + 0.5, m

    every, n_every = mixed(list(range(len(DOMAINS))))
    weights = []
    for k in range(len(DOMAINS)):
        own, (rest, n_rest) = F.col(f"c{k}") + 0.5, mixed([j for j in range(len(DOMAINS)) if j != k])
        odds = F.log(own / (n[k] + 1.0)) - F.log(rest / (n_rest + 1.0))
        # words within the noise of their counts weigh nothing, and only words that speak for a domain count
        others = sum((F.col(f"c{j}") for j in range(len(DOMAINS)) if j != k), F.lit(0))
        both, size = F.col(f"c{k}") + others, sum(n)
        part = lambda c, m: F.when(c > 0, c * F.log(c * float(size) / (both * float(max(m, 1))))).otherwise(0.0)
        sure = (odds > 0) & (2 * (part(F.col(f"c{k}"), n[k]) + part(others, size - n[k])) > MIN_RATIO)
        weights.append(F.when(sure, F.log(own / (n[k] + 1.0)) - F.log(every / (n_every + 1.0))).otherwise(0.0).alias(f"w{k}"))
    table = counts.select("b", *weights).filter(" or ".join(f"w{k} <> 0" for k in range(len(DOMAINS))))
    return priors, materialize(table)


def evidence(docs: DataFrame, weights: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, text_key, carried columns, n_tokens, s_<domain>...) of every document; whole texts, one thin row shuffled each."""
    keys = ["row", "doc_id", "text_key", *carry, "n_tokens"]
    body = F.col(text)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("text_key"), *carry, body.alias("body"), words_of(body).alias("words"))
    words = F.col("words")
    rows = rows.select(*keys[:-1], F.size(words).cast("long").alias("n_tokens"), features(F.col("body"), words).alias("w"))
    rows = rows.select(*keys, F.explode_outer("w").alias("w"))
    met = rows.withColumn("b", bucket(F.col("w"))).drop("w").join(F.broadcast(weights), "b", "left")
    return met.groupBy(*keys).agg(*[F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"s_{d}") for k, d in enumerate(DOMAINS)])


def traits(row: dict | None = None) -> list:
    """What the logistic model sees of a scored document: as columns, or as the numbers of ``row``."""
    if row is None:
        return [F.lit(1.0), *[F.log1p(f"s_{d}") for d in DOMAINS], F.log1p("n_tokens")]
    return [1.0, *[math.log1p(row[f"s_{d}"]) for d in DOMAINS], math.log1p(row["n_tokens"])]


def calibrate(x: np.ndarray, domain: np.ndarray, weight: np.ndarray, priors: list[float]) -> np.ndarray:
    """Slopes of the log odds against the first domain, by Newton steps; without documents the priors."""
    size, width = len(DOMAINS) - 1, x.shape[1]
    base = np.zeros((size, width))
    base[:, 0] = np.array(priors[1:]) - priors[0]
    if not len(x):
        return base
    w, ridge = base.copy(), np.tile(np.r_[0.01, np.full(width - 1, RIDGE)], size)
    for _ in range(50):
        odds = np.c_[np.zeros(len(x)), x @ w.T]
        p = np.exp(odds - odds.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True))[:, 1:]
        miss = (p - (domain[:, None] == np.arange(1, size + 1))) * weight[:, None]
        slope = (miss.T @ x).ravel() + ridge * (w - base).ravel()
        bend = np.diag(ridge)
        for i in range(size):
            for j in range(size):
                v = weight * p[:, i] * ((i == j) - p[:, j])
                bend[i * width : (i + 1) * width, j * width : (j + 1) * width] += (x * v[:, None]).T @ x
        step = np.linalg.solve(bend, slope)
        w = w - (step * min(1.0, 3 / max(np.abs(step).max(), 1e-12))).reshape(w.shape)
        if np.abs(step).max() < 1e-8:
            break
    return w


def posteriors(scored: DataFrame, held_out: DataFrame, priors: list[float], max_labelled: int = 20_000) -> DataFrame:
    """``scored`` with p_<domain>, by a logistic model of at most ``max_labelled`` documents a domain of ``held_out`` (doc_id, domain).

    A domain's documents weigh as much as there are of them in ``held_out``, sampled or not.
    """
    sample = scored.join(F.broadcast(sample_of(held_out.select("doc_id", "domain"), max_labelled)), "doc_id")
    rows = sample.select("domain", "n_tokens", *[f"s_{d}" for d in DOMAINS]).collect()
    domain = np.array([r["domain"] for r in rows], dtype=int)
    sizes = {r["domain"]: r["count"] for r in held_out.groupBy("domain").count().collect()}
    found = np.bincount(domain, minlength=len(DOMAINS))
    weight = np.array([sizes[k] / found[k] for k in domain])
    x = np.array([traits(r.asDict()) for r in rows]).reshape(len(rows), len(DOMAINS) + 2)
    slopes = calibrate(x, domain, weight, priors)
    odds = [F.lit(0.0), *[sum((c * float(v) for c, v in zip(traits(), row, strict=True)), F.lit(0.0)) for row in slopes]]
    met = scored.withColumn("o", F.array(*odds)).withColumn("e", F.transform("o", lambda v: F.exp(v - F.array_max("o"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    return met.select(*[c for c in scored.columns if not c.startswith("s_")], *[(F.get("e", F.lit(k)) / total).alias(f"p_{d}") for k, d in enumerate(DOMAINS)])


@dataclass(frozen=True)
class Fit:
    """What the rates reach: shares of the domains, the pull, steps, whether the conditions of the optimum hold, and whether every target is met."""

    achieved: dict[str, float]
    pull: float
    steps: int
    converged: bool
    reached: bool


def fit_rates(members: DataFrame, targets: dict[str, float] | None = None, budget: float = 1.0, tolerance: float = 1e-5, max_steps: int = 200) -> tuple[DataFrame, Fit]:
    """``members`` (n_tokens, p_<domain>...) with ``rate`` >= 0, and how the fit went.

    Minimises sum_k (sum_d rate_d n_d p_dk / N - budget * target_k)^2 + pull * sum_d n_d / N * (rate_d - 1)^2
    by projected gradients in the metric that weighs a document by its tokens, scaled by the
    domains' curvature, with momentum that restarts when it leads uphill. ``PULLS`` are tried
    from the strongest on, each from where the last one ended, until every target is met
    within a fifth of ``CLOSE``, or until documents of the first target's domain would suffer:
    at most ``MAY_LOSE`` of the tokens that are most likely its own may have a rate below a half.
    """
    targets = TARGETS if targets is None else targets
    names = list(targets)
    size = len(names)
    p, n = [F.col(f"p_{d}") for d in names], F.col("n_tokens")
    goal = np.array([targets[d] for d in names]) * budget
    # documents of about one posterior step together: their totals are exact, and there are not more of them than places of the grid
    places = [F.round(x * GRID).cast("int").alias(f"g{i}") for i, x in enumerate(p)]
    each = members.filter(n > 0).select(n.alias("n_tokens"), *p, *places).groupBy(*[f"g{i}" for i in range(size)])
    each = materialize(each.agg(F.sum("n_tokens").alias("n_tokens"), *[(F.sum(n * x) / F.sum(n)).alias(f"p_{d}") for x, d in zip(p, names, strict=True)]).drop(*[f"g{i}" for i in range(size)]))
    # read in every step; what is lost of it is read again from its files
    each = each.coalesce(1).cache()
    total, *rows = each.agg(F.sum(n), *[F.sum(n * p[i] * p[j]) for i in range(size) for j in range(size)]).first()
    if not total:
        return members.withColumn("rate", F.lit(1.0)), Fit({d: 0.0 for d in names}, 0.0, 0, True, False)
    # the curvature with all rates above 0; where some are 0 it is less, so steps scaled by it are safe
    curve = np.array(rows, dtype=float).reshape(size, size) / total

    def rate_at(y: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), 1.0 - sum(x * float(v) for x, v in zip(p, y, strict=True)))

    def look(y: np.ndarray, of: DataFrame) -> tuple[np.ndarray, float]:
        """Domain totals, and of the tokens most likely of the first domain the share whose rate is below a half."""
        now, rate = of.withColumn("rate", rate_at(y)), F.col("rate")
        got = now.agg(*[F.sum(rate * n * x) for x in p], F.sum(F.when((p[0] > 0.5) & (rate < 0.5), n).otherwise(0)), F.sum(F.when(p[0] > 0.5, n).otherwise(0))).first()
        return np.array(got[:size], dtype=float) / total, float(got[size]) / max(float(got[size + 1]), 1e-12)

    best, y, steps = None, np.zeros(size), 0
    for pull in PULLS:
        at, before, momentum, converged = y.copy(), y.copy(), 1.0, False
        for _ in range(max_steps):
            steps += 1
            made, lost = look(at, each)
            slope = made - goal - pull * at
            if np.abs(slope).max() <= tolerance:
                y, converged = at, True
                break
            new = at + np.linalg.solve(curve + pull * np.eye(size), slope)
            if slope @ (new - before) < 0:
                momentum = 1.0
            after = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
            at, before, momentum = new + (momentum - 1) / after * (new - before), new, after
        else:
            y = before
        if lost > MAY_LOSE and best is not None:
            break
        best = (y.copy(), pull, converged)
        if lost > MAY_LOSE or (np.abs(made - goal) <= CLOSE / 5 * goal).all():
            break
    each.unpersist()
    y, pull, converged = best
    made, _ = look(y, members)
    share = made / budget
    reached = bool((np.abs(share - goal / budget) <= CLOSE * goal / budget).all())
    return members.withColumn("rate", rate_at(y)), Fit(dict(zip(names, map(float, share), strict=True)), pull, steps, converged, reached)


def mix_with_fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, text: str = "text", doc_id: str = "doc_id", max_labelled: int = 20_000, carry: tuple[str, ...] = ()) -> tuple[DataFrame, Fit]:
    """One row per document (doc_id, text_key, carried columns (not null), n_tokens, p_<domain>..., rate), and what the rates reach."""
    labelled = materialize(labelled_domains(docs, labels, doc_id))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    sizes = sizes_of(labelled)
    priors = [math.log((x + 1) / (sum(sizes) + len(sizes))) for x in sizes]
    _, weights = train(docs, labelled.filter(half == 0), text, doc_id, max_labelled)
    scored = materialize(evidence(docs, weights, text, doc_id, carry))
    members = materialize(posteriors(scored, labelled.filter(half == 1), priors, max_labelled))
    rated, fit = fit_rates(members, targets)
    return rated.drop("row"), fit


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, text: str = "text", doc_id: str = "doc_id", max_labelled: int = 20_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``mix_with_fit``."""
    return mix_with_fit(docs, labels, targets, text, doc_id, max_labelled, carry)[0]
