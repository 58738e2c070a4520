"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles. Every set is embedded as a list of sampled tokens: the
hashes are dealt into bins, the least of a bin is its token, and an empty bin borrows the
token of another one. Two sets of Jaccard similarity s agree on a bin with probability s.

A run starts at a root that holds all sets and splits recursively. A node samples, by the
hash of its path, one bin, and in a quarter of the nodes a second one (1/0.8 in the mean);
a set goes to the child named by its own token of the bin, so only sets that share the
sampled token stay together. Nodes of up to ``leaf`` sets are not split: their sets are
compared by brute force, exactly. Runs are repeated until a pair at the threshold is missed
with probability 1 - ``recall`` at most, even if every node on its way had to split
``depth`` times. A pair that meets in several leaves counts in the first.

Nodes that are large after ``depth`` splits (groups of near copies share every token) are
compared block by block. A block has a bounded number of sets and of tokens, so no task
holds a whole group, and no pair is written: a comparison returns, for each set, its number
of links and the smallest set it is connected with.

Texts are read twice, and the second time only tokens of sets that are compared leave their
task: the sets are looked up by the place of their row (``rows.look_up``).

Defined results: words are runs without ASCII blanks; a text of one to ``words`` - 1 words
is one shingle; a null text, or one without words, links to nothing and is a class and group of its
own; documents with equal shingle sets are one class and each counts once for others'
links; null ids sort last; repeated rows are documents of one class; extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusengine.llm.graphs import components, join_groups
from corpusengine.llm.rows import in_blocks, located, look_up, place_columns
from corpusengine.session import materialize, scratch_scope, small_batches

WORD = r"[^\x20\x09-\x0D]+"
#: Most cells of a 0/1 matrix of sets by tokens that a comparison holds at once.
CELLS = 1 << 24
#: Bins that the nodes of one level choose from, and the share of nodes that choose two.
BINS_PER_LEVEL, SECOND = 8, 0.25
#: Low bits of a leaf's name; above them stands its place in the order of leaves.
NAME_BITS = 54
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: Column, words: int = 5) -> list[tuple[str, Column]]:
    """Steps to ``tokens``: the sorted 64-bit hashes of a text's shingles."""
    w = F.col("_words")
    hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, words)]))
    return [
        ("_words", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))),
        ("tokens", F.sort_array(F.array_distinct(F.when(F.size(w) >= words, hashes).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))))),
    ]


def with_tokens(docs: DataFrame, words: int) -> DataFrame:
    for name, column in shingles(F.col("text"), words):
        docs = docs.withColumn(name, column)
    return docs.drop("_words")


def number_of_runs(threshold: float, depth: int, recall: float) -> int:
    """Runs that reach ``recall`` if a node never chose a second bin; that some do only adds to it."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of ``x``, one to one (the finaliser of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def embed(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of ``bins`` sampled tokens for each set (int64 hashes, not empty)."""
    k, sizes = len(sets), np.array([len(s) for s in sets])
    out = np.full(k * bins, EMPTY)
    with np.errstate(over="ignore"):
        h = _mix(np.concatenate(sets).astype(np.int64).view(np.uint64))
        at = np.repeat(np.arange(k) * bins, sizes) + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, at, h)
        out = out.reshape(k, bins)
        own = out != EMPTY
        # empty bins look at others, in an order that is theirs alone, until one has a token
        for step in range(1, 64 * bins):
            todo = out == EMPTY
            if not todo.any():
                break
            other = (_mix(np.arange(bins, dtype=np.uint64) * np.uint64(65_537) + np.uint64(step)) % np.uint64(bins)).astype(np.int64)
            out = np.where(todo & own[:, other], out[:, other], out)
    return out.view(np.int64)


def sampled_tokens(sets: DataFrame, bins: int) -> DataFrame:
    """``sets`` with ``n_tokens`` and ``sampled`` (an empty array for an empty set) in place of ``tokens``."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sets.schema if f.name != "tokens") + ", n_tokens int, sampled array<long>"

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            sizes = df["tokens"].map(len).to_numpy(dtype=np.int32)
            full = np.flatnonzero(sizes)
            column = [np.zeros(0, np.int64)] * len(df)
            for i in range(0, len(full), 256):
                part = full[i : i + 256]
                for j, row in zip(part, embed([df["tokens"].iloc[j] for j in part], bins), strict=True):
                    column[j] = row
            yield df.drop(columns="tokens").assign(n_tokens=sizes, sampled=pd.Series(column, index=df.index, dtype=object))

    return sets.mapInPandas(sample, schema)


def children(level: int, runs: int) -> list[tuple[Column, Column, int]]:
    """(condition, bin, branch) of the splits of a node ``path`` of run ``run``; a level has bins of its own."""
    if level == 1:
        firsts = runs
        second = F.col("run") % round(1 / SECOND) == 0
        return [(F.lit(True), F.col("run"), 0), (second, F.lit(firsts) + F.floor(F.col("run") * SECOND).cast("int"), 1)]
    base = first_bin(level, runs)
    one = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(BINS_PER_LEVEL)).cast("int")
    other = F.pmod(one + 1 + F.pmod(F.xxhash64("path", F.lit(2)), F.lit(BINS_PER_LEVEL - 1)), F.lit(BINS_PER_LEVEL)).cast("int")
    second = F.pmod(F.xxhash64("path", F.lit(3)), F.lit(round(1 / SECOND))) == 0
    return [(F.lit(True), base + one, 0), (second, base + other, 1)]


def first_bin(level: int, runs: int) -> int:
    """The first bin of ``level``; for a level below the last one, the number of bins."""
    return runs + -(-runs // round(1 / SECOND)) + (level - 2) * BINS_PER_LEVEL


def leaves(classes: DataFrame, runs: int, depth: int, leaf: int) -> DataFrame:
    """(v, run, main, leaf, size, weight): the nodes of two sets or more in which the splitting ends.

    A leaf's name has its place among the leaves of a set in the upper bits; ``main`` tells
    that no second bin was taken on its path; ``weight`` is its number of tokens.
    """
    sets = classes.filter("n_tokens > 0").select("v", "n_tokens", "sampled")
    rows = sets.select("v", "n_tokens", "sampled", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).withColumns({"path": F.lit(0).cast("long"), "branch": F.lit(0)})
    done = None
    for level in range(1, depth + 1):
        kids = [(F.when(when, F.xxhash64("path", F.lit(level), "run", at, F.get("sampled", at))).alias(f"kid{bit}"), bit) for when, at, bit in children(level, runs)]
        rows = rows.select("v", "n_tokens", "run", "branch", *[kid for kid, _ in kids])
        rows = materialize(rows) if level > 1 else rows
        first, second = (rows.filter(f"kid{bit} is not null").select("v", "n_tokens", "run", F.col(f"kid{bit}").alias("path"), (F.col("branch") * 2 + bit).alias("branch")) for _, bit in kids)
        rows = first.unionByName(second)
        counts = materialize(rows.groupBy(F.col("path").alias("to")).agg(F.count("*").alias("size"), F.sum("n_tokens").alias("weight")).filter("size > 1"))
        met = materialize(rows.join(counts, F.col("path") == F.col("to")).drop("to"))
        ended = met if level == depth else met.filter(F.col("size") <= leaf)
        order = F.shiftleft((F.shiftleft("run", level) + F.col("branch")).cast("long"), NAME_BITS + depth - level)
        ended = ended.select("v", "run", (F.col("branch") == 0).alias("main"), (order + F.col("path").bitwiseAND((1 << NAME_BITS) - 1)).alias("leaf"), "size", "weight")
        done = ended if done is None else done.unionByName(ended)
        if level < depth:
            rows = met.filter(F.col("size") > leaf).select("v", "n_tokens", "run", "path", "branch").join(sets.select("v", "sampled"), "v")
    return materialize(done)


def comparisons(ended: DataFrame, runs: int, block: int, block_tokens: int) -> DataFrame:
    """(task, side, cross, leaf, v, leaves): what is compared with what.

    A leaf all of whose sets met in the main leaf of an earlier run is left out. A leaf of
    more than ``block`` sets or ``block_tokens`` tokens is cut into blocks, and a task
    compares two blocks, or one in itself.
    """
    main = F.map_from_entries(F.collect_list(F.when(F.col("main"), F.struct("run", "leaf"))))
    of_set = materialize(ended.groupBy("v").agg(main.alias("m"), F.sort_array(F.collect_list("leaf")).alias("leaves")).select("v", "leaves", *[F.coalesce(F.element_at("m", F.lit(k)), F.lit(-1).cast("long")).alias(f"m{k}") for k in range(runs)]))
    met = materialize(ended.drop("main").join(of_set, "v"))
    spread = met.groupBy("leaf", "run").agg(*[g(f"m{k}").alias(f"{n}{k}") for k in range(runs) for n, g in (("lo", F.min), ("hi", F.max))])
    again = F.lit(False)
    for k in range(runs):
        again = again | ((F.col("run") > k) & (F.col(f"lo{k}") == F.col(f"hi{k}")) & (F.col(f"lo{k}") != -1))
    covered = materialize(spread.filter(again).select("leaf"))
    left = met.select("v", "leaf", "size", "weight", "leaves").join(covered, "leaf", "left_anti")
    n = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("weight") / block_tokens)).cast("int")
    left = left.withColumn("n", n).withColumn("c", F.pmod(F.xxhash64("v"), F.col("n")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    task = F.xxhash64("leaf", F.least("c", "other"), F.greatest("c", "other"))
    return left.select(task.alias("task"), (F.col("c") > F.col("other")).cast("int").alias("side"), (F.col("c") != F.col("other")).alias("cross"), "leaf", "v", "leaves")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the tokens that two sets share."""
    k = len(sets)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[at] > 1
    column = np.cumsum(counts > 1) - 1
    owner, column = owner[shared], column[at[shared]]
    total, width = np.zeros((k, k), dtype=np.int64), max(1, CELLS // max(k, 1))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        m = np.zeros((k, int(column[b - 1]) - low + 1), dtype=np.float32)
        m[owner[a:b], column[a:b] - low] = 1
        total += np.rint(m @ m.T).astype(np.int64)
    return total


def compare(threshold: Fraction):
    """Verification of one task: links per set that no earlier leaf has seen, and the smallest connected set."""
    p, q = threshold.numerator, threshold.denominator

    def verify(df: pd.DataFrame) -> pd.DataFrame:
        df = df.drop_duplicates("v")
        v, side = df["v"].to_numpy(), df["side"].to_numpy()
        sets = [np.asarray(t) for t in df["tokens"]]
        size = np.array([len(t) for t in sets], dtype=np.int64)
        both = _overlaps(sets)
        near = (p + q) * both >= p * (size[:, None] + size[None, :])
        np.fill_diagonal(near, False)
        if df["cross"].iloc[0]:
            near &= side[:, None] != side[None, :]
        now = int(df["leaf"].iloc[0]) >> NAME_BITS
        fresh = near & (_overlaps([(x := np.asarray(t))[x >> NAME_BITS < now] for t in df["leaves"]]) == 0)
        root = v.copy()
        while True:
            lower = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
            if (lower == root).all():
                break
            root = lower
        linked = near.any(axis=1)
        return pd.DataFrame({"v": v[linked], "n_links": fresh.sum(axis=1)[linked], "root": root[linked]})

    return verify


def jaccard_join(docs: DataFrame, threshold: Fraction = Fraction(4, 5), words: int = 5, text: str = "text", doc_id: str = "doc_id", depth: int = 3, recall: float = 0.9995, leaf: int = 128, block: int = 256, block_tokens: int = 1 << 20, at: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, class_id, group_id, n_links, kept.

    ``class_id`` is the smallest id of the documents with the same shingle set, ``group_id``
    the smallest of the connected ones, ``n_links`` the number of other classes at the
    threshold; one document of each group is kept, the one with the smallest id.
    ``at`` names columns of ``docs`` that hold file and place of the rows; they are returned too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    runs = number_of_runs(float(threshold), depth, recall)
    file, place = at or place_columns(docs)
    marked = (docs if at else located(docs)[1]).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), file, place)
    with scratch_scope(spark):
        rows = with_tokens(marked.withColumn("row", F.monotonically_increasing_id()), words).drop("text")
        own = F.when(F.size("tokens") > 0, F.xxhash64(F.lit(1), "tokens")).otherwise(F.col("row"))
        sets = rows.select("row", F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("none"), file, place, F.xxhash64("tokens").alias("class1"), own.alias("class2"), "tokens")
        thin = materialize(sampled_tokens(sets, first_bin(depth + 1, runs)), keep=True)
        n_rows = thin.count()

        key = F.struct("class1", "class2")
        first = F.min(F.struct("none", "doc_id", "row", file, place))
        classes = materialize(thin.withColumn("class", key).groupBy("class").agg(first.alias("first"), F.count("*").alias("size"), F.any_value("n_tokens").alias("n_tokens"), F.any_value("sampled").alias("sampled")).withColumn("v", F.col("first.row")))

        tasks = materialize(comparisons(leaves(classes, runs, depth, leaf), runs, block, block_tokens))
        wanted = materialize(in_blocks(tasks.select("v").distinct().join(classes, "v").select(f"first.{file}", f"first.{place}", "v")))
        tokens = with_tokens(look_up(marked, (file, place), wanted, "v").filter("v is not null").select("v", "text"), words).select("v", "tokens")
        found = materialize(tasks.join(tokens, "v").groupBy("task").applyInPandas(compare(threshold), "v long, n_links long, root long"))

        links = found.groupBy("v").agg(F.sum("n_links").alias("n_links"))
        roots = components(found.select(F.col("v").alias("a"), F.col("root").alias("b")))
        marked = materialize(classes.select("v", "class", "first", "size").join(links, "v", "left").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")))
        tops = marked.groupBy("root").agg(F.min("first").alias("top"))
        per_class = materialize(marked.join(tops, "root").select("class", "size", "first", "top", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), keep=True)
    met = join_groups(thin.select("row", "doc_id", "none", *(at or ()), key.alias("class")), per_class, "class", "size", n_rows)
    id_of = lambda x: F.when(~x["none"], x["doc_id"])
    return met.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), *(at or ()), id_of(F.col("first")).alias("class_id"), id_of(F.col("top")).alias("group_id"), "n_links", (F.col("row") == F.col("top.row")).alias("kept"))
