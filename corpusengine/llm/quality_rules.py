"""Quality rules of documents, judged together with the host they come from.

Every rule is an expression over one document. Per host the failures of each rule are
counted, the rates are shrunk with an empirical beta prior over all hosts, and a host whose
shrunken rate is surely above the limit is rejected with all its documents.

Defined results: a null text counts as empty; a null host is a host of its own; repeated
rows are judged each on its own; extra columns pass through ``judge_documents`` unless
their name is one of the columns it adds, which then replace them. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusengine.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rules that count against a host: name -> share of its documents that may surely fail.
HOST_LIMITS = {"short": 0.6, "repetitive": 0.4, "symbols": 0.4, "dup_lines": 0.4, "odd_words": 0.6}
#: Normal quantile of the posterior bound.
Z = 2.5758
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(words: Column) -> list[tuple[str, Column]]:
    """Steps to the number of words that lie in a 3-word window found at least twice.

    A window is one long: its hash above its place. Once sorted, equal windows are
    neighbours, so only longs with a near neighbour can be repeated; for those the words
    themselves are compared, with two neighbours on either side. A chance equality of hashes
    (39 bits, 32 in texts of 2^24 words or more) so never adds a window; it could hide one only
    where at least two other windows of the same hash stand between two equal ones. The union of the places' spans is a walk over
    sorted starts. n log n in the length of one text, on primitive arrays.
    """
    spaces = F.when(F.size(words) < 1 << 24, F.lit(1 << 24)).otherwise(F.lit(1 << 31)).cast("long")
    m, packed, near, at = F.col("_m"), F.col("_packed"), F.col("_near"), F.col("_at")
    third = lambda i: F.get(words, i + 2)
    pack = lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1), third(i)), F.expr("9223372036854775807 div _m")) * m + i
    close = lambda x, k: (x - F.get(packed, k - 1) < m) | (F.get(packed, k + 1) - x < m)

    def same(x: Column, y: Column) -> Column:
        i, j = (x % m).cast("int"), (y % m).cast("int")
        return (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (third(i) == third(j))

    def twice(x: Column, k: Column) -> Column:
        equal = [F.coalesce(same(x, F.get(near, k + d)), F.lit(False)) for d in (-1, 1, -2, 2)]
        return F.when(equal[0] | equal[1] | equal[2] | equal[3], (x % m).cast("int"))

    span = lambda d, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - d, F.lit(3)))
    return [
        ("_m", spaces),
        ("_packed", F.sort_array(F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), pack))),
        ("_near", F.filter(packed, close)),
        ("_at", F.sort_array(F.array_compact(F.transform(near, twice)))),
        ("n_repeat_words", F.aggregate(F.transform(at, span), F.lit(0).cast("long"), lambda a, x: a + x)),
    ]


def document_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules need (n_lines too)."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    df = docs.drop(*STATS, "n_lines").withColumns(
        {
            "_words": F.regexp_extract_all(body, F.lit(WORD), F.lit(0)),
            "_lines": lines,
            "word_chars": F.length(_without(body, BLANKS)).cast("long"),
            "n_symbols": (F.length(body) - F.length(_without(body, SYMBOLS))).cast("long"),
        }
    )
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    for name, column in repeated_words(F.col("_words")):
        df = df.withColumn(name, column)
    return df.drop("_words", "_lines", "_m", "_packed", "_near", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_failures() -> dict[str, Column]:
    """Each host rule as an expression over the counts."""
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "odd_words": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n),
    }


def host_verdicts(stats: DataFrame, host: str, limits: dict[str, float] | None = None, z: float = Z) -> DataFrame:
    """One row per host: documents, shrunken rate and lower bound of each rule, rejected.

    The prior of a rule is a beta distribution fitted by moments to the hosts' rates, each
    weighted with its documents; it is a handful of numbers, whatever the number of hosts.
    """
    limits = HOST_LIMITS if limits is None else limits
    rules = rule_failures()
    per_host = materialize(stats.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), *[F.count_if(rules[r]).alias(f"f_{r}") for r in limits]))
    n = F.col("n_docs")
    moments = per_host.agg(F.sum("n_docs").alias("n"), F.count("*").alias("hosts"), *[F.sum(f"f_{r}").alias(f"f_{r}") for r in limits], *[F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / n).alias(f"q_{r}") for r in limits]).first()
    total, hosts = moments["n"] or 0, moments["hosts"] or 0
    out, rejected = per_host, F.lit(False)
    for r, limit in limits.items():
        mean = (moments[f"f_{r}"] + 0.5) / (total + 1) if total else 0.5
        # variance of the rates between hosts, less what drawing n_docs documents adds
        spread = max((moments[f"q_{r}"] or 0) / total - mean * mean, 0.0) if total else 0.0
        noise = mean * (1 - mean) * hosts / total if total else 0.0
        between = max(spread - noise, 1e-6)
        strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1e4)
        a, b = F.col(f"f_{r}") + mean * strength, n - F.col(f"f_{r}") + (1 - mean) * strength
        rate = a / (a + b)
        low = rate - z * F.sqrt(rate * (1 - rate) / (a + b + 1))
        out = out.withColumns({f"rate_{r}": rate, f"low_{r}": low})
        rejected = rejected | (low > limit)
    return out.withColumn("host_rejected", rejected)


def _with_verdicts(stats: DataFrame, verdicts: DataFrame, host: str) -> DataFrame:
    """Only the table of rejected hosts is joined, and Catalyst broadcasts it when its files are small."""
    bad = materialize(verdicts.filter("host_rejected").select(F.col("host").alias("_bad_host"), F.lit(True).alias("_bad")))
    out = stats.join(bad, F.col(host).eqNullSafe(F.col("_bad_host")), "left").withColumn("host_rejected", F.coalesce("_bad", F.lit(False)))
    return out.drop("_bad", "_bad_host").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def judge_documents(docs: DataFrame, text: str = "text", host: str = "source", limits: dict[str, float] | None = None) -> DataFrame:
    """The documents' other columns with counts, ``base_failed``, ``host_rejected`` and ``kept``.

    The text is read once; the counts are written as a thin table, which the host figures
    and the verdicts read. (A filter on counts that are not written yet would be pushed
    below their projections and evaluate the words once a window.)
    """
    stats = materialize(document_stats(docs.drop("base_failed", "host_rejected", "kept"), text).drop(text))
    return _with_verdicts(stats, host_verdicts(stats, host, limits), host)
