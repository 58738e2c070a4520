"""URL filters: explicit rules first, then the reputation of the host.

Reputation is empirical Bayes. Labelled pages of a host are good or bad; their rate is
shrunk towards the registered domain's, the domain's towards the public suffix's and that
towards the rate of all, each through a beta-binomial prior whose strength is fitted by
moments at that level. A host is blocked when the lower posterior bound of its bad rate
reaches the limit.

Suffixes come from rules (``SUFFIX_RULES``; any other list will do). Hot hosts and domains
are joined by broadcast, the others by shuffle (``graphs.join_groups``).

Defined results: a null url or one without ``://`` has empty host and path and is judged
by the rate of the empty host; pages and labels with null ids never meet; several labels
of one id count once, bad if any says so; labels with both outcomes null say nothing;
repeated pages are judged each; a null page id stays null; userinfo and port count for the
host, as the contract has it, but not for its domain; extra columns are not read. Empty tables give an empty result or, for labels, allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusengine.llm.graphs import join_groups
from corpusengine.session import materialize

#: (rule, verdict); a rule is host and path prefix.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Labels under a country's two letters that make a suffix of two labels with it (co.uk, com.br, ...).
SECOND_LEVEL = ("ac", "co", "com", "ed", "edu", "go", "gob", "gouv", "gov", "gv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Suffix rules beyond that: a name, ``*.name`` for every label below it, ``!name`` for what is a domain all the same.
SUFFIX_RULES = ("*.bd", "*.ck", "*.er", "*.fk", "*.kh", "*.mm", "*.np", "*.pg", "!www.ck", "!city.kawasaki.jp", "*.kawasaki.jp", "github.io", "gitlab.io", "blogspot.com", "web.app")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MAX_RULES = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def site(host: Column) -> Column:
    """A host without userinfo, port and closing points."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(:\d*)?$|\.+(:\d*)?$", "")


def registered(host: Column, rules: tuple[str, ...] = SUFFIX_RULES) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host.

    The suffix is that of the longest rule that fits, ``!`` rules before all others; without
    one it is the last label, or the last two under a country's two letters. An address is a
    domain of its own, with the suffix ``ip``.
    """
    name = site(host)
    labels = F.split(name, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k if isinstance(k, Column) else F.lit(k)), ".")
    size = F.when((F.length(last(1)) == 2) & F.get(labels, n - 2).isin(*SECOND_LEVEL), 2).otherwise(1)
    longest = lambda r: (r.startswith("!"), r.count("."))
    for r in sorted(rules, key=longest):
        bare = r.lstrip("!*.")
        k = bare.count(".") + (0 if r.startswith("!") else 2 if r.startswith("*") else 1)
        size = F.when((name == bare) | name.endswith("." + bare), k).otherwise(size)
    address = name.rlike(r"^(\d+(\.\d+){3}|\[.*\]?)$")
    return F.when(address, name).otherwise(last(size + 1)), F.when(address, F.lit("ip")).otherwise(last(size))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits. ``rules`` is a bounded list."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _strength(rows: DataFrame, n: str, bad: str, parent: Column) -> float:
    """Strength of the beta prior with mean ``parent`` that explains the spread of the rates (moments)."""
    p, k = F.col(bad) / F.col(n), F.col(n)
    r = rows.filter(k > 0).agg(F.sum(k).alias("n"), F.sum(k * (p - parent) ** 2).alias("v"), F.sum(parent * (1 - parent)).alias("noise"), F.sum(k * parent * (1 - parent)).alias("full")).first()
    if not r["n"]:
        return 2.0
    between = max((r["v"] - r["noise"]) / r["n"], 1e-6)
    return min(max(r["full"] / r["n"] / between - 1, 2.0), 1e4)


def host_reputation(hosts: DataFrame, outcomes: DataFrame, z: float = 1.2816, limit: float = 0.5) -> DataFrame:
    """``hosts`` (host) judged by ``outcomes`` (host, n, bad: one row per labelled host).

    Returns host, domain, suffix, n_labelled, n_bad, bad_rate, bad_low, bad_high, reputation.
    """
    domain, suffix = registered(F.col("host"))
    base = materialize(hosts.join(outcomes, "host", "left").select("host", domain.alias("domain"), suffix.alias("suffix"), F.coalesce("n", F.lit(0)).alias("n_labelled"), F.coalesce("bad", F.lit(0)).alias("n_bad")))
    totals = base.agg(F.sum("n_labelled").alias("n"), F.sum("n_bad").alias("bad")).first()
    overall = ((totals["bad"] or 0) + 0.5) / ((totals["n"] or 0) + 1)

    suffixes = base.groupBy("suffix").agg(F.sum("n_labelled").alias("n_s"), F.sum("n_bad").alias("b_s"))
    s = _strength(suffixes, "n_s", "b_s", F.lit(overall))
    suffixes = suffixes.withColumn("p_s", (F.col("b_s") + s * overall) / (F.col("n_s") + s)).select("suffix", "p_s")

    domains = base.groupBy("domain", "suffix").agg(F.sum("n_labelled").alias("n_d"), F.sum("n_bad").alias("b_d"), F.count("*").alias("n_hosts")).join(suffixes, "suffix")
    domains = materialize(domains)
    d = _strength(domains, "n_d", "b_d", F.col("p_s"))
    domains = domains.withColumn("p_d", (F.col("b_d") + d * F.col("p_s")) / (F.col("n_d") + d)).select("domain", "p_d", "n_hosts")

    judged = materialize(join_groups(base, domains, "domain", "n_hosts", base.count()))
    h = _strength(judged, "n_labelled", "n_bad", F.col("p_d"))
    a, b = F.col("n_bad") + h * F.col("p_d"), F.col("n_labelled") - F.col("n_bad") + h * (1 - F.col("p_d"))
    rate = a / (a + b)
    sd = F.sqrt(rate * (1 - rate) / (a + b + 1))
    low, high = F.greatest(rate - z * sd, F.lit(0.0)), F.least(rate + z * sd, F.lit(1.0))
    return judged.select("host", "domain", "suffix", "n_labelled", "n_bad", rate.alias("bad_rate"), low.alias("bad_low"), high.alias("bad_high"), F.when(low >= limit, "block").otherwise("allow").alias("reputation"))


def judge_pages(pages: DataFrame, labels: DataFrame, rules=RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``pages`` ids and urls with host, path, rule, reputation figures and verdict.

    ``labels`` (doc_id, quality, toxic) are outcomes of the pages with those ids. One host
    may hold a third of all pages: outcomes are summed before the shuffle, and only the
    table with one row per host is joined back, to the pages' thin columns.
    """
    host, path = host_and_path(F.col(url))
    thin = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    outcome = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(F.when((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1), 1).otherwise(0)).alias("bad"))
    outcomes = thin.join(outcome, F.col("page_id") == F.col("doc_id")).groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    sizes = materialize(thin.groupBy("host").agg(F.count("*").alias("n_pages")))
    hosts = host_reputation(sizes.select("host"), outcomes).join(sizes, "host")
    met = join_groups(thin, materialize(hosts), "host", "n_pages", sizes.agg(F.sum("n_pages")).first()[0] or 0)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return met.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "reputation", F.lit("allow")).alias("verdict"), "domain", "suffix", "n_labelled", "n_bad", "bad_rate", "bad_low", "bad_high", "reputation")
