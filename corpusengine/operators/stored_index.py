"""Stored keyword index: segments of postings in impact blocks, kept up to date by what changes.

A segment is a folder of tables written by one build or change: a forward table (a chunk's
length, terms and how often each stands there) by bucket of the document, blocks of postings
by bucket of (tenant, term), changes of document frequencies by the same bucket, changes of
the tenants' numbers of chunks and words, and the documents of older segments that are gone. A
segment counts once its commit row is written, last, so a failed write leaves the index as
it was, and a second writer of the same number fails. A change reads the forward rows of the
documents it touches and nothing else, so its work grows with the change. ``compact`` writes
what is alive as one segment that stands for all before.

No posting is shuffled: each task cuts the postings of its own forward rows, RUN of them at a
time and sorted by term, into blocks, so a term has blocks of many tasks and a hot term is no
task's burden. Where a run has more than LEAST postings of a term, they are cut by impact
(their gain at the average length of their segment, in steps), and at BLOCK postings. A
block is one row: its postings as arrays next to a summary, which bounds the gain of its
postings from above and below at any average length. Search works out a score that ``k``
chunks reach for sure from the summaries alone, leaves out blocks whose postings can't reach it
even with the best of all other terms, and reads the postings of the others; what it returns
equals exhaustive scoring.

Defined results: rows without tenant or document are not indexed; a null text has no words;
a document that is written again loses all its older chunks; deleting what isn't there
changes nothing; repeated chunks count each; a change may hold the same document among
upserts and deletes, and the upsert wins; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusengine.functions.text import words
from corpusengine.operators.index import B, DELTA, K1
from corpusengine.session import materialize, scratch_scope, small_batches

#: Steps of the gain that separate blocks, postings of a block at most, and of a term in a run that is not cut by steps.
STEPS, BLOCK, LEAST = 8, 4096, 64
#: Postings that a task sorts at once, and block rows that it hands over at once.
RUN, HANDED = 1 << 21, 1 << 16
#: What stands between two of the words that ``words`` finds; texts split at it in less time than their words are extracted.
NO_WORD = r"[^\p{L}\p{N}_]+"
#: Bits of a sieve; half a megabyte, which every task gets.
BITS = 1 << 22
TABLES = {
    "forward": "tenant string, doc_id {id}, chunk_index int, dl long, copies int, terms array<string>, tfs array<int>, segment int, part int",
    "blocks": "tenant string, term string, slice long, n long, tf_max long, tf_min long, dl_max long, dl_min long, doc_ids array<{id}>, chunk_indexes array<int>, dls array<long>, tfs array<int>, segment int, bucket int",
    "lost": "tenant string, term string, df long, segment int, bucket int",
    "stats": "tenant string, n long, dl long, segment int",
    "gone": "tenant string, doc_id {id}, of int, n long, segment int",
}
SUMMARY = ["tenant", "term", "slice", "n", "tf_max", "tf_min", "dl_max", "dl_min", "segment", "bucket"]


def gain(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a posting adds to a score, for each unit of its term's weight."""
    return tf * (K1 + 1) / (K1 * (1 - B + B * dl / avgdl) + tf)


def sieve(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``keys`` are not among those of ``wanted``; a join after it shuffles few in vain.

    Keys go by bits of their hash in a table of a fixed size, so it may be broadcast however many there are.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    bits = wanted.select(F.shiftright(at, 6).alias("_at"), bit.alias("_bit")).groupBy("_at").agg(F.bit_or("_bit").alias("_bits"))
    return rows.withColumn("_at", F.shiftright(at, 6)).join(F.broadcast(bits), "_at").filter(F.col("_bits").bitwiseAND(bit) != 0).drop("_at", "_bits")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tenant, doc_id, chunk_index, ws) as forward rows: each word once, with how often it stands there; empty ones are none."""
    for b in batches:
        lists = b.column("ws")
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        held = pc.not_equal(flat, "")
        row, coded = row[held.to_numpy(zero_copy_only=False)], flat.filter(held).dictionary_encode()
        dl, n = np.bincount(row, minlength=len(lists)), max(len(coded.dictionary), 1)
        key, tf = np.unique(row * n + coded.indices.to_numpy(), return_counts=True)
        offsets = pa.array(np.searchsorted(key, np.arange(len(dl) + 1) * n), pa.int32())
        terms, tfs = coded.dictionary.take(pa.array(key % n)), pa.array(tf, pa.int32())
        columns = {"dl": pa.array(dl, pa.int64()), "copies": pa.array(np.ones(len(dl)), pa.int32()), "terms": pa.ListArray.from_arrays(offsets, terms), "tfs": pa.ListArray.from_arrays(offsets, tfs)}
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns.values()], names=["tenant", "doc_id", "chunk_index", *columns])


def blocks_of(rows: pa.Table, block: int, lead: int) -> pa.RecordBatch:
    """The blocks of forward ``rows``, sorted by tenant, term and step; their slices count from ``lead`` on. ``unit`` is the gain of a word that stands once."""
    lists, tenant = rows["terms"].combine_chunks(), rows["tenant"].combine_chunks().dictionary_encode()
    coded = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    tf = rows["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    level = (tf * (K1 + 1) / ((K1 + 1) / rows["unit"].to_numpy()[row] - 1 + tf) * STEPS).astype(np.int64)
    rank = lambda d: np.argsort(pc.array_sort_indices(d.dictionary).to_numpy())[d.indices.to_numpy()].astype(np.int64)
    word = rank(tenant)[row] * len(coded.dictionary) + rank(coded)
    order = np.argsort(word * (level.max() + 1) + level, kind="stable")
    word, level, row, tf = word[order], level[order], row[order], tf[order]
    first = lambda *keys: np.flatnonzero(np.concatenate([[True], reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])]))
    lengths = lambda starts: np.diff(np.append(starts, len(word)))
    of_term = lengths(first(word))
    at = first(word, np.where(np.repeat(of_term > LEAST, of_term), level, 0))
    at = np.flatnonzero((np.arange(len(word)) - np.repeat(at, lengths(at))) % block == 0)
    dl, to, offsets = rows["dl"].to_numpy()[row], pa.array(row), pa.array(np.append(at, len(word)), pa.int32())
    extremes = [f.reduceat(x, at) for x in (tf, dl) for f in (np.maximum, np.minimum)]
    lists = [rows["doc_id"].combine_chunks().take(to), rows["chunk_index"].combine_chunks().take(to), pa.array(dl, pa.int64()), pa.array(tf, pa.int32())]
    term = coded.dictionary.take(coded.indices.take(pa.array(order[at])))
    columns = [tenant.dictionary.take(tenant.indices.take(to.take(pa.array(at)))), term, pa.array(lead + np.arange(len(at)), pa.int64()), pa.array(lengths(at), pa.int64())]
    columns += [pa.array(x, pa.int64()) for x in extremes] + [pa.ListArray.from_arrays(offsets, x) for x in lists]
    return pa.RecordBatch.from_arrays(columns, names=[*SUMMARY[:-2], "doc_ids", "chunk_indexes", "dls", "tfs"])


def cut(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, lead = [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            held.append(b)
            n += len(b.column("terms").flatten())
            if n >= RUN:
                out = blocks_of(pa.Table.from_batches(held), block, lead)
                held, n, lead = [], 0, lead + len(out)
                yield from (out.slice(i, HANDED) for i in range(0, len(out), HANDED))
        if n:
            out = blocks_of(pa.Table.from_batches(held), block, lead)
            yield from (out.slice(i, HANDED) for i in range(0, len(out), HANDED))

    return run


@dataclass(frozen=True)
class StoredIndex:
    spark: SparkSession
    path: str
    buckets: int = 16

    # --- segments ---------------------------------------------------------------------------

    def segments(self) -> list[int]:
        """Committed segments that no compaction stands for, in order."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/commits").select("segment", "replaces").collect()
        except AnalysisException:
            return []
        over = {x for r in rows for x in r["replaces"]}
        return sorted(r["segment"] for r in rows if r["segment"] not in over)

    def read(self, name: str, segments: list[int] | None = None) -> DataFrame:
        """Rows of one of the ``TABLES`` with their segment."""
        segments = self.segments() if segments is None else segments
        # tables without rows have no files that tell their columns, but this one has
        kind = self.spark.read.parquet(f"{self.path}/gone/segment={segments[0]}").schema["doc_id"].dataType.simpleString()
        return self.spark.read.schema(TABLES[name].format(id=kind)).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/segment={k}" for k in segments])

    def _next(self) -> int:
        try:
            return 1 + (self.spark.read.parquet(f"{self.path}/commits").agg(F.max("segment")).first()[0] or 0)
        except AnalysisException:
            return 1

    def _bucket(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def gone(self) -> DataFrame:
        """(tenant, doc_id, of, n): documents whose n rows of segment ``of`` are gone."""
        return self.read("gone").select("tenant", "doc_id", "of", "n")

    def alive(self, rows: DataFrame) -> DataFrame:
        """``rows`` (tenant, doc_id, segment, ...) without those of replaced or deleted documents."""
        gone = self.gone()
        if gone.isEmpty():
            return rows
        return rows.join(gone.select("tenant", "doc_id", F.col("of").alias("segment")), ["tenant", "doc_id", "segment"], "left_anti")

    # --- writing ----------------------------------------------------------------------------

    def write(self, chunks: DataFrame, deletes: DataFrame | None = None) -> None:
        """A segment of new or replaced documents' ``chunks`` (tenant, doc_id, chunk_index, text), without the documents of ``deletes`` (tenant, doc_id)."""
        small_batches(self.spark)
        named = "tenant is not null and doc_id is not null"
        keyed = chunks.select("tenant", "doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), F.split(F.lower(F.coalesce("text", F.lit(""))), NO_WORD).alias("ws")).filter(named)
        kind = keyed.schema["doc_id"].dataType.simpleString()
        rows = keyed.mapInArrow(counted, f"tenant string, doc_id {kind}, chunk_index int, dl long, copies int, terms array<string>, tfs array<int>")
        with scratch_scope(self.spark):
            old = None
            if self.segments():
                touched = chunks.select("tenant", "doc_id")
                if deletes is not None:
                    touched = touched.unionByName(deletes.select("tenant", F.col("doc_id").cast(kind).alias("doc_id")))
                key = ["tenant", "doc_id"]
                touched = materialize(touched.filter(named).distinct())
                parts = [r["part"] for r in touched.select(self._bucket(*key).alias("part")).distinct().collect()]
                past = sieve(self.read("forward").filter(F.col("part").isin(parts)), touched, key)
                old = materialize(self.alive(past.join(touched, key, "left_semi")).select(*key, "dl", "copies", "terms", "segment"))
            self._commit(rows, old, [])

    def compact(self) -> None:
        """One segment of all that is alive, which stands for all segments so far."""
        segments = self.segments()
        if segments:
            self._commit(self.alive(self.read("forward", segments)).drop("segment", "part"), None, segments)

    def _commit(self, rows: DataFrame, old: DataFrame | None, replaces: list[int]) -> None:
        segment = self._next()

        def put(df: DataFrame, name: str, *by: str) -> None:
            # most values differ, so that dictionaries would take more time than they save space
            options = {"compression": "zstd", "parquet.enable.dictionary": "false"}
            df.write.mode("overwrite").options(**options).partitionBy(*by).parquet(f"{self.path}/{name}/segment={segment}")

        key = ["tenant", "doc_id", "chunk_index", "dl"]
        none = rows.select("tenant", "doc_id", F.lit(0).alias("segment")).limit(0)
        put((none if old is None else old).groupBy("tenant", "doc_id", F.col("segment").alias("of")).agg(F.count("*").alias("n")), "gone")
        part = self._bucket("tenant", "doc_id")
        put(rows.withColumn("part", part), "forward", "part")
        forward = self.read("forward", [segment]).drop("segment", "part")
        if not forward.groupBy(*key).count().filter("count > 1").isEmpty():
            put(materialize(self._merged(forward, key)).withColumn("part", part), "forward", "part")
            forward = self.read("forward", [segment]).drop("segment", "part")
        average = forward.groupBy("tenant").agg((F.sum(F.col("dl") * F.col("copies")) / F.sum("copies")).alias("avgdl"))
        tasks = -(-(forward.agg(F.sum("dl")).first()[0] or 0) // RUN) or 1
        weighed = forward.filter("dl > 0").coalesce(tasks).join(F.broadcast(average), "tenant").select(*key, "terms", "tfs", gain(F.lit(1), F.col("dl"), F.col("avgdl")).alias("unit"))
        schema = ", ".join(x for x in TABLES["blocks"].format(id=rows.schema["doc_id"].dataType.simpleString()).split(", ")[:-2])
        put(weighed.mapInArrow(cut(BLOCK), schema).withColumn("bucket", self._bucket("tenant", "term")), "blocks", "bucket")
        change = lambda df, sign: df.groupBy("tenant").agg((sign * F.sum("copies")).alias("n"), (sign * F.sum(F.col("dl") * F.col("copies"))).alias("dl"))
        stats = change(forward, F.lit(1))
        if old is not None:
            less = old.select("tenant", F.explode("terms").alias("term")).groupBy("tenant", "term").agg((-F.count("*")).alias("df"))
            put(less.withColumn("bucket", self._bucket("tenant", "term")).repartition("bucket"), "lost", "bucket")
            stats = stats.unionByName(change(old, F.lit(-1)))
        else:
            put(none.select("tenant", F.lit("").alias("term"), F.lit(0).cast("long").alias("df"), F.lit(0).alias("bucket")), "lost", "bucket")
        put(stats, "stats")
        self.spark.createDataFrame([(segment, replaces)], "segment int, replaces array<int>").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/commits/of={segment}")

    @staticmethod
    def _merged(forward: DataFrame, key: list[str]) -> DataFrame:
        """One row for the rows of a key, which have all their words; ``copies`` says how many they are."""
        each = forward.select(*key, F.explode_outer(F.arrays_zip("terms", "tfs")).alias("x")).select(*key, "x.terms", "x.tfs")
        each = each.groupBy(*key, "terms").agg(F.sum("tfs").cast("int").alias("tfs")).groupBy(*key).agg(F.collect_list(F.when(F.col("terms").isNotNull(), F.struct("terms", "tfs"))).alias("x"))
        copies = forward.groupBy(*key).agg(F.sum("copies").cast("int").alias("copies"))
        same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key])
        return copies.alias("a").join(each.alias("b"), same).select("a.*", F.col("x.terms").alias("terms"), F.col("x.tfs").alias("tfs"))

    # --- reading ----------------------------------------------------------------------------

    def stats(self) -> DataFrame:
        """(tenant, n, avgdl) of what is alive."""
        sums = self.read("stats").groupBy("tenant").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
        return sums.filter("n > 0").select("tenant", "n", (F.col("dl") / F.col("n")).alias("avgdl"))

    def sizes(self) -> DataFrame:
        """(tenant, n_postings, n_words) of what is alive, as the forward table has them."""
        rows = self.alive(self.read("forward").select("tenant", "doc_id", "segment", F.size("terms").alias("n"), F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x).alias("tf")))
        return rows.groupBy("tenant").agg(F.sum("n").alias("n_postings"), F.sum("tf").alias("n_words")).filter("n_postings > 0")

    def frequencies(self, asked: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
        """(tenant, term, df) of what is alive, or of the ``asked`` (tenant, term) only, whose ``blocks`` may be at hand."""
        of = self.read if asked is None else (lambda name: self._of_buckets(name, asked))
        blocks = of("blocks") if blocks is None else blocks
        rows = blocks.select("tenant", "term", F.col("n").alias("df")).unionByName(of("lost").select("tenant", "term", "df"))
        return rows.groupBy("tenant", "term").agg(F.sum("df").alias("df")).filter("df > 0")

    def postings(self) -> DataFrame:
        """(tenant, term, doc_id, chunk_index, tf, dl) of what is alive."""
        return self.alive(self._opened(self.read("blocks"), "tenant", "term", "segment")).select("tenant", "term", "doc_id", "chunk_index", "tf", "dl")

    @staticmethod
    def _opened(blocks: DataFrame, *keep: str) -> DataFrame:
        """``keep``, doc_id, chunk_index, dl and tf of each posting of the blocks."""
        postings = blocks.select(*keep, F.explode(F.arrays_zip("doc_ids", "chunk_indexes", "dls", "tfs")).alias("_x"))
        return postings.select(*keep, F.col("_x.doc_ids").alias("doc_id"), F.col("_x.chunk_indexes").alias("chunk_index"), F.col("_x.dls").alias("dl"), F.col("_x.tfs").alias("tf"))

    def _of_buckets(self, name: str, asked: DataFrame) -> DataFrame:
        """Rows of ``asked`` terms; buckets that hold none of them are not read."""
        key = ["bucket", "tenant", "term"]
        keyed = asked.select("tenant", "term").distinct().withColumn("bucket", self._bucket("tenant", "term"))
        buckets = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]
        return sieve(self.read(name).filter(F.col("bucket").isin(buckets)), keyed, key[1:]).join(keyed, key, "left_semi")

    def needed_blocks(self, weighted: DataFrame, scoped: DataFrame, k: int, blocks: DataFrame | None = None) -> DataFrame:
        """(query_id, tenant, term, idf, avgdl, segment, bucket, slice, needed) of the blocks of ``weighted`` terms (query_id, tenant, term, idf, avgdl)."""
        key = ["query_id", "tenant"]
        blocks = self._of_buckets("blocks", weighted).select(*SUMMARY) if blocks is None else blocks
        met = weighted.join(blocks, ["tenant", "term"])
        met = met.withColumns({"high": F.col("idf") * gain(F.col("tf_max"), F.col("dl_min"), F.col("avgdl")), "low": F.col("idf") * gain(F.col("tf_min"), F.col("dl_max"), F.col("avgdl"))})
        met = materialize(met.drop("tf_max", "tf_min", "dl_max", "dl_min"))
        # chunks of documents that are gone may stand in any block, so as many more are asked for
        dead = self.gone().groupBy("tenant").agg(F.sum("n").alias("dead"))
        sure = met.join(dead, "tenant", "left").withColumn("sum", F.sum("n").over(Window.partitionBy(*key, "term").orderBy(F.desc("low"), "segment", "slice")))
        sure = sure.filter(F.col("sum") >= k + F.coalesce("dead", F.lit(0))).groupBy(*key).agg(F.max("low").alias("least"))
        best = met.groupBy(*key, "term").agg(F.max("high").alias("best"))
        whole = best.groupBy(*key).agg(F.sum("best").alias("whole"))
        out = met.join(best, [*key, "term"]).join(whole, key).join(sure, key, "left").join(scoped.select(*key, F.col("document_id").isNotNull().alias("narrow")), key)
        # in a narrowed search other chunks than its document's say nothing about what is reached
        needed = F.col("narrow") | F.col("least").isNull() | (F.col("high") + F.col("whole") - F.col("best") >= F.col("least") - 1e-5)
        return out.select(*key, "term", "idf", "avgdl", "segment", "bucket", "slice", needed.alias("needed"))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Top ``k`` of each query (query_id, tenant, text, optional document_id): query_id, tenant, doc_id, chunk_index, score, rank."""
        if "document_id" not in queries.columns:
            queries = queries.withColumn("document_id", F.lit(None).cast("long"))
        scoped = materialize(queries.select("query_id", "tenant", "document_id", "text"))
        asked = scoped.select("query_id", "tenant", F.explode(words(F.col("text"))).alias("term")).groupBy("query_id", "tenant", "term").agg(F.count("*").alias("qtf"))
        blocks = materialize(self._of_buckets("blocks", asked).select(*SUMMARY))
        weighted = asked.join(self.frequencies(asked, blocks), ["tenant", "term"]).join(self.stats(), "tenant")
        weighted = materialize(weighted.select("query_id", "tenant", "term", "avgdl", (F.col("qtf") * F.log((F.col("n") + 1) / F.col("df"))).alias("idf")))
        floor = weighted.groupBy("query_id", "tenant").agg(F.sum(F.col("idf") * DELTA).alias("floor"))
        blocks = materialize(self.needed_blocks(weighted, scoped, k, blocks).filter("needed").drop("needed"))
        place = ["bucket", "tenant", "term", "slice", "segment"]
        buckets = [r["bucket"] for r in blocks.select("bucket").distinct().collect()]
        met = sieve(self.read("blocks").filter(F.col("bucket").isin(buckets)).drop("n", "tf_max", "tf_min", "dl_max", "dl_min"), blocks, place[1:3]).join(blocks, place)
        found = self.alive(self._opened(met, "query_id", "tenant", "segment", "idf", "avgdl"))
        keys = ["query_id", "tenant", "doc_id", "chunk_index"]
        matched = found.groupBy(*keys).agg(F.sum(F.col("idf") * gain(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("gain"))
        # chunks without a term of the query have the floor, so the first ones of the scope can fill the list
        chunks = self.alive(self.read("forward").select("tenant", "doc_id", "chunk_index", "copies", "segment"))
        chunks = chunks.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("_copy", "copies")
        wide = scoped.filter("document_id is null").select("query_id", "tenant").join(self._first(chunks, ["tenant"], ["doc_id", "chunk_index"], k), "tenant")
        narrow = scoped.filter("document_id is not null").select("query_id", "tenant", F.col("document_id").alias("doc_id")).join(self._first(chunks, ["tenant", "doc_id"], ["chunk_index"], k), ["tenant", "doc_id"])
        fill = reduce(DataFrame.unionByName, [x.select(*keys, F.lit(0.0).alias("gain")) for x in (wide, narrow)])
        scored = matched.unionByName(fill).groupBy(*keys).agg(F.max("gain").alias("gain")).join(floor, ["query_id", "tenant"]).join(scoped.select("query_id", "tenant", "document_id"), ["query_id", "tenant"])
        scored = scored.filter("document_id is null or document_id = doc_id").withColumn("score", F.round(F.col("gain") + F.col("floor"), 6)).filter("score > 0")
        w = Window.partitionBy("query_id", "tenant").orderBy(F.desc("score"), "doc_id", "chunk_index")
        return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*keys, "score", "rank")

    @staticmethod
    def _first(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
        """The ``k`` first rows of each group."""
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")
