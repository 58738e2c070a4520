"""Quality gates for rewritten questions: the first that fails blanks the rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusengine.functions import text as T
from corpusengine.functions.similarity import sequence_ratio
from corpusengine.session import materialize

# Technology names that a rewrite must not add.
TECH = r"\b(sql|postgresql|postgres|mysql|mongodb|nosql|redis|graphql|sqlite|oracle|mariadb|cassandra|dynamodb|firebase|supabase)\b"


#: Hash buckets in which words are counted to order them by rarity; a bound of what goes to the driver.
RARITY = 4096


#: An edge of a word of ASCII letters, digits and _, as SQL engines take \b; Java's \b counts every letter as part of a word.
ASCII_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _lower(text: Column) -> Column:
    """Character by character, so that a capital I with a dot becomes one letter, as in SQL."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def unusable(new: Column) -> Column:
    t = F.regexp_replace(F.coalesce(new, F.lit("")), r"^\p{Zs}+|\p{Zs}+\z", "")
    return (F.length(t) < 3) | _lower(t).rlike("^(rules:|system:|i cannot|i can't)")


def dropped_personal(old: Column, new: Column, edge: str = r"\b") -> Column:
    pattern = T.PERSONAL.replace(r"\b", edge)
    return old.rlike(pattern) & ~new.rlike(pattern)


def _missing(old: Column, new: Column, pattern: str, lower: bool) -> Column:
    found = lambda t: F.regexp_extract_all(_lower(t) if lower else t, F.lit(pattern), F.lit(1))
    return F.size(F.array_except(found(old), found(new))) > 0


def dropped_quantifier(old: Column, new: Column, edge: str = r"\b") -> Column:
    return _missing(old, new, T.QUANTIFIER.replace(r"\b", edge), True)


def dropped_acronym(old: Column, new: Column) -> Column:
    return _missing(old, new, T.ACRONYM, False)


def invented_technology(old: Column, new: Column) -> Column:
    return _missing(new, old, TECH, True)


def first_technology(old: Column, new: Column, edge: str = r"\b") -> Column:
    """Technology is named where none was; narrower than ``invented_technology``, which asks of each name. A long s counts as s, as it does in SQL."""
    pattern = "(?i)" + TECH.replace("s", "[sſ]").replace(r"\b", edge)
    return new.rlike(pattern) & ~old.rlike(pattern)


def diverged(old: Column, new: Column, least: float = 0.4) -> Column:
    return sequence_ratio(F.lower(old), F.lower(new)) < least


def prior_candidates(asked: DataFrame, told: DataFrame, ratio: float = 0.35) -> DataFrame:
    """(conv_id, new_key, turn_key) of ``asked_words`` and ``told_words`` that may be as alike as ``least``, by a prefix join.

    Words are put in an order by the number of turns that hold them, rare ones first, counted
    in RARITY buckets of their hash, so that the order needs no join. Sets of n and m words
    that share ``least`` of their union share a word among the first n - ceil(least n) + 1 of
    the one and m - ceil(ratio m) + 1 of the other, differ in length by that factor at most,
    and have enough words left from the first shared one on. A rewrite's ``least`` lies above
    its likeness to its own question, so most need few of their words. Words and sets go by
    their hashes: equal ones may make a candidate more, never one less.
    """
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(RARITY)).cast("int")
    found = dict(told.select(F.explode("turn_words").alias("w")).groupBy(bucket("w").alias("b")).count().collect())
    rarity = F.split(F.lit(",".join(str(found.get(b, 0)) for b in range(RARITY))), ",").cast("array<bigint>")

    def prefixes(sets: DataFrame, name: str, least: Column) -> DataFrame:
        n = F.size(f"{name}_words")
        order = F.array_sort(F.transform(f"{name}_words", lambda w: F.struct(F.get(rarity, bucket(w)).alias("df"), w.alias("w"))))
        first = F.slice(order, 1, (n - F.ceil(least * n - 1e-9) + 1).cast("int"))
        kept = [c for c in ("conv_id", f"{name}_key", "least") if c in sets.columns]
        return sets.select(*kept, n.alias(f"{name}_n"), F.posexplode(F.transform(first, lambda x: F.xxhash64(x["w"]))).alias(f"{name}_at", "word"))

    met = prefixes(asked, "new", F.col("least")).join(prefixes(told, "turn", F.lit(ratio)), ["conv_id", "word"])
    n, m, least = F.col("new_n"), F.col("turn_n"), F.col("least")
    left = 1 + F.least(n - 1 - F.col("new_at"), m - 1 - F.col("turn_at"))
    fits = (m >= least * n - 1e-9) & (n >= least * m - 1e-9) & (left >= least / (1 + least) * (n + m) - 1e-9)
    return met.filter(fits).select("conv_id", "new_key", "turn_key").distinct()


def asked_words(pairs: DataFrame, ratio: float = 0.35, margin: float = 0.10) -> DataFrame:
    """(id, conv_id, at, new_words, new_key, own, least): words of each rewrite, and how alike a turn must be; without those that no turn can reach."""
    own = T.overlap_ratio(F.col("new_words"), T.content_words(F.col("original")))
    asked = pairs.filter("conv_id is not null").select("id", "conv_id", "at", "original", F.array_sort(T.content_words(F.col("rewritten"))).alias("new_words"))
    asked = asked.filter(F.size("new_words") > 0).withColumn("own", own).withColumn("least", F.greatest(F.lit(ratio), F.col("own") + margin))
    return asked.filter("least <= 1").withColumn("new_key", F.xxhash64("new_words")).drop("original")


def told_words(history: DataFrame) -> DataFrame:
    """(conv_id, turn_words, turn_key, seq): the different word sets of each conversation and where each comes first."""
    told = history.filter("conv_id is not null").select("conv_id", "seq", F.array_sort(T.content_words(F.col("content"))).alias("turn_words"))
    return told.filter(F.size("turn_words") > 0).groupBy("conv_id", "turn_words").agg(F.min("seq").alias("seq")).withColumn("turn_key", F.xxhash64("turn_words"))


def prior_matches(pairs: DataFrame, history: DataFrame, ratio: float = 0.35, margin: float = 0.10) -> DataFrame:
    """(id, prior): the first earlier turn that a rewrite resembles more than its own question.

    A set-similarity join within conversations: only pairs of word sets that
    ``prior_candidates`` finds are compared. Of turns of one ``seq`` the smallest text counts;
    pairs of one id are one. Nulls match nothing, texts without content words neither.
    """
    asked, told = materialize(asked_words(pairs, ratio, margin)), materialize(told_words(history))
    met = materialize(prior_candidates(asked, told, ratio)).join(asked, ["conv_id", "new_key"]).join(told, ["conv_id", "turn_key"]).filter(F.col("seq") < F.col("at"))
    like = T.overlap_ratio(F.col("new_words"), F.col("turn_words"))
    found = materialize(met.filter((like >= ratio) & (like > F.col("own") + margin)).select("id", "conv_id", "seq", "turn_words"))
    first = found.groupBy("id").agg(F.min("seq").alias("seq"))
    texts = found.join(first, ["id", "seq"]).join(history.select("conv_id", "seq", "content"), ["conv_id", "seq"])
    # all words alike, said so that the join does not take it for a key and split every text of the history
    return texts.filter(T.overlap_ratio(T.content_words(F.col("content")), F.col("turn_words")) >= 1).groupBy("id").agg(F.min("content").alias("prior"))


def gate(pairs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``pairs`` (id, conv_id, at, original, rewritten) with reject_reason and the question to use."""
    old, new = F.col("original"), F.col("rewritten")
    prior = F.lit(False)
    if history is not None:
        pairs = pairs.join(prior_matches(pairs, history), "id", "left")
        prior = F.col("prior").isNotNull()
    cheap = [(unusable(new), "unusable"), (dropped_personal(old, new), "dropped_personal"), (dropped_quantifier(old, new), "dropped_quantifier"), (dropped_acronym(old, new), "dropped_acronym"), (invented_technology(old, new), "invented_technology")]
    df = pairs.withColumn("reject_reason", T.first_true(cheap))
    # the similarity runs only where no cheap gate has decided
    open_ = df.filter("reject_reason is null").withColumn("reject_reason", T.first_true([(diverged(old, new), "diverged"), (prior, "prior_turn")]))
    df = df.filter("reject_reason is not null").unionByName(open_)
    return df.withColumn("question", F.when(F.col("reject_reason").isNull(), new).otherwise(old))
