"""Vector search, fusion, reranking and filters of ranked lists, for tables of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusengine.functions import text as T
from corpusengine.operators.vector_index import dimension_of, usable
from corpusengine.session import materialize

RRF_K = 60
# Words that ask for a comparison, wherever they stand.
COMPARISON_RE = "(?i)compare|vs|versus|better|worse|difference|outperform|beat|surpass|how much|which is|contrast|similar|differ|both"
# Fixed value: words that mark a question about a metric, a table or a figure.
METRIC_RE = r"(?i)\b(accuracy|score|rate|gflops?|utmos|wer|srr|sir|tor|mrr|probability|percentage|ratio|threshold|table\s*\d|figure\s*\d)\b"
ROW_RE, FIGURE_RE = r"(?m)^\s*Row \[(.*?)\]:", r"(?m)^\s*Figure:"
MAX_QUERY_BLOCK_MB = 64
MAX_SCORES = 4_000_000


def unit(v: Column) -> Column:
    v = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine top ``k``: query_id, doc_id, score, rank. ``queries`` (query_id, tenant, embedding), ``vectors`` (doc_id, tenant, embedding).

    Queries come to the driver in blocks of at most ``MAX_QUERY_BLOCK_MB``, each broadcast for
    one pass over the vectors; where there are several, a block's hits are written before
    the next one comes. Every batch of vectors gives its own top-k per query, so the shuffle
    carries k rows a batch and query. With a ``document_id`` in both tables, a query that has
    one finds rows of that document only. Vectors that are null, of another dimension than
    most, without length or with an element that is no number are left out, and such queries
    find nothing; so are rows and queries without an id. Ids keep their types.
    """
    dimension = dimension_of(vectors)
    vectors, queries = (df.filter(usable(F.col("embedding"), dimension) & F.col(key).isNotNull()) for df, key in ((vectors, "doc_id"), (queries, "query_id")))
    if "document_id" not in queries.columns or "document_id" not in vectors.columns:
        vectors, queries = (df.withColumn("document_id", F.lit(None).cast("string")) for df in (vectors, queries))
    # compared as texts, since pandas turns whole numbers next to nulls into floats
    vectors, queries = (df.withColumn("document_id", F.col("document_id").cast("string")) for df in (vectors, queries))
    blocks = _query_blocks(queries.select("query_id", "tenant", "document_id", unit(F.col("embedding")).alias("e")))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double"
    block, found = next(blocks, []), None
    while True:
        after = next(blocks, None)
        hits = _search_block(block, vectors, k, kinds)
        if after is None:
            break
        hits = materialize(hits)
        found, block = hits if found is None else found.unionByName(hits), after
    found = hits if found is None else found.unionByName(hits)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _query_blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    block, held = [], 0
    for r in queries.toLocalIterator():
        size = 8 * len(r["e"])
        if block and held + size > MAX_QUERY_BLOCK_MB * 1_000_000:
            yield block
            block, held = [], 0
        block.append((r["query_id"], r["tenant"], np.array(r["e"], dtype=float), r.asDict().get("document_id")))
        held += size
    if block:
        yield block


def _search_block(rows: list[tuple], vectors: DataFrame, k: int, schema: str) -> DataFrame:
    block = vectors.sparkSession.sparkContext.broadcast(rows)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = [r[0] for r in block.value]
        tenants = np.array([r[1] for r in block.value], dtype=object)
        q = np.array([r[2] for r in block.value], dtype=float)
        for df in batches:
            if not len(df) or not len(ids):
                continue
            m = np.vstack(df["embedding"].to_numpy()).astype(float)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            m = (m / np.where(n > 0, n, 1)).T
            doc, own, of = df["doc_id"].to_numpy(), df["tenant"].to_numpy(), df["document_id"].to_numpy()
            # a number for each id in its order, as ids may be texts
            order = np.unique(doc, return_inverse=True)[1]
            # scores of some queries at once, so that they stay within a worker's memory
            some = max(1, MAX_SCORES // len(df))
            for start in range(0, len(ids), some):
                s = np.where(tenants[start : start + some, None] == own[None, :], q[start : start + some] @ m, -np.inf)
                for i, row in enumerate(np.round(s, 6), start):
                    if (only := block.value[i][3]) is not None:
                        row = np.where(of == only, row, -np.inf)
                    top = np.lexsort((order, -row))[:k]
                    top = top[np.isfinite(row[top])]
                    yield pd.DataFrame({"query_id": ids[i], "doc_id": doc[top], "score": row[top]})

    return vectors.select("doc_id", "tenant", "document_id", "embedding").mapInPandas(local, schema)


def fuse(vector: DataFrame, keyword: DataFrame, keys: list[str]) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (``keys``, score, rank); best first, ties in the vector list's order, then the keyword list's."""
    v = vector.select(*keys, F.col("score").alias("vector_score"), F.col("rank").alias("v_rank"))
    t = keyword.select(*keys, F.col("score").alias("keyword_score"), F.col("rank").alias("k_rank"))
    share = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    met = v.join(t, keys, "full").withColumn("combined_score", F.round(share("v_rank") + share("k_rank"), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("combined_score"), F.col("v_rank").asc_nulls_last(), F.col("k_rank").asc_nulls_last())
    return met.select(*keys, F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.greatest(F.coalesce("keyword_score", F.lit(0.0)), F.lit(0.0)).alias("keyword_score"), "combined_score", F.when(F.col("v_rank").isNotNull(), "vector").otherwise("keyword").alias("search_type"), F.row_number().over(w).alias("rank"))


def hybrid_search(questions: DataFrame, keyword: DataFrame, vector: DataFrame, chunks: DataFrame, score_fn: Callable[[pd.Series, pd.Series], pd.Series] | None = None, pool: int = 20, k: int = 6) -> DataFrame:
    """Both ranked lists (query_id, doc_id, score, rank) fused, cut to ``pool``, reranked if there is a scorer, limited in table rows, cut to ``k``.

    ``questions`` (query_id, question) and ``chunks`` (doc_id, text) are joined to the pool only.
    """
    fused = fuse(vector.filter(F.col("rank") <= pool), keyword.filter(F.col("rank") <= pool), ["query_id", "doc_id"]).filter(F.col("rank") <= pool)
    found = fused.join(questions.select("query_id", "question"), "query_id").join(chunks.select("doc_id", "text"), "doc_id")
    kept = filter_table_rows(rerank(found, score_fn, pool))
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recent_labels(documents: DataFrame, latest: int = 20) -> DataFrame:
    """(tenant, label, ord): titles and file names of a tenant's latest processed documents, each label once, newest first."""
    w = Window.partitionBy("tenant").orderBy(F.desc("created_at"), F.desc("doc_id"))
    newest = documents.filter("status = 'processed'").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= latest)
    labels = newest.select("tenant", "n", F.posexplode(F.array("title", "filename")).alias("k", "label")).filter("label <> ''")
    first = labels.groupBy("tenant", "label").agg(F.min(F.struct("n", "k")).alias("at"))
    order = F.row_number().over(Window.partitionBy("tenant").orderBy("at"))
    return first.select("tenant", "label", order.alias("ord")).filter(F.col("ord") <= latest)


def latest_metadata(documents: DataFrame) -> DataFrame:
    """(tenant, metadata) of each tenant's newest document; null if that one has none."""
    return documents.groupBy("tenant").agg(F.max_by(F.struct("metadata"), F.struct("created_at", "doc_id")).alias("m")).select("tenant", "m.metadata")


def keep_best(hits: DataFrame, keys: list[str], score: str = "combined_score") -> DataFrame:
    """The best row per key, the first in rank on a tie."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), "rank")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def rerank(hits: DataFrame, score_fn: Callable[[pd.Series, pd.Series], pd.Series] | None, k: int) -> DataFrame:
    """Second-stage order by ``score_fn(question, text)``, or the order as it is without one."""
    if score_fn is not None:
        hits = hits.withColumn("rerank_score", F.pandas_udf(score_fn, "double")(F.col("question"), F.col("text")))
    else:
        hits = hits.withColumn("rerank_score", F.lit(None).cast("double"))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def is_comparison(question: Column) -> Column:
    return F.coalesce(question.rlike(COMPARISON_RE) | question.contains(" and ") | question.contains(" vs "), F.lit(False))


def candidate_k(question: Column, plain: int = 5, metric: int = 12, pattern: str = METRIC_RE) -> Column:
    """Candidates to fetch: more where a question asks for a metric, since tables rank low."""
    return F.when(question.rlike(pattern), metric).otherwise(plain)


def result_score() -> Column:
    return F.coalesce("rerank_score", "combined_score", F.lit(0.0))


def filter_table_rows(hits: DataFrame) -> DataFrame:
    """Limit table-row chunks (query_id, question, text, rank) by entity; other chunks always stay, order is kept."""
    entity = F.get(F.regexp_extract_all("text", F.lit(ROW_RE), F.lit(1)), F.lit(0))
    name = F.lower(T.entity_name(F.col("entity")))
    df = hits.withColumn("entity", F.when(F.col("text").rlike(ROW_RE), entity))
    df = df.withColumn("named", F.coalesce((name != "") & F.contains(F.lower("question"), name), F.lit(False)))
    q = Window.partitionBy("query_id")
    df = df.withColumn("n_named", F.size(F.collect_set(F.when(F.col("named"), F.col("entity"))).over(q)))
    compare = is_comparison(F.col("question"))
    df = df.withColumn("cap", F.when(compare, 3).when(F.col("n_named") > 1, 2).otherwise(1))
    drop = (F.col("n_named") > 0) & ~compare & ~F.col("named") & F.col("entity").isNotNull()
    df = df.filter(~drop)
    seen = F.row_number().over(Window.partitionBy("query_id", "entity").orderBy("rank"))
    return df.withColumn("seen", seen).filter("entity is null or seen <= cap").drop("seen", "cap", "n_named", "named")


def narrow(hits: DataFrame, size: int = 5) -> DataFrame:
    """Cut metric questions' candidates to ``size``, but never rows of named entities nor figures."""
    entity = F.get(F.regexp_extract_all("text", F.lit(ROW_RE), F.lit(1)), F.lit(0))
    name = F.lower(T.entity_name(entity))
    row = F.col("text").rlike(ROW_RE) & ((name == "") | F.contains(F.lower("question"), name))
    df = hits.withColumn("sure", F.coalesce(row, F.lit(False)) | F.col("text").rlike(FIGURE_RE)).withColumn("s", result_score())
    q = Window.partitionBy("query_id")
    df = df.withColumn("n_sure", F.count_if("sure").over(q)).withColumn("n", F.count("*").over(q))
    df = df.withColumn("fill", F.row_number().over(Window.partitionBy("query_id", "sure").orderBy(F.desc("s"), "rank")))
    metric = F.col("question").rlike(METRIC_RE)
    kept = df.filter(~metric | (F.col("n") <= size) | F.col("sure") | (F.col("fill") <= size - F.col("n_sure")))
    return kept.withColumn("rank", F.row_number().over(q.orderBy(F.desc("s"), "rank"))).drop("s", "n", "n_sure", "fill")


def with_filenames(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """One lookup for all hits; Catalyst broadcasts the registry if it is small."""
    names = documents.select("doc_id", F.col("filename").alias("_name"))
    return hits.join(names, "doc_id", "left").withColumn("filename", F.coalesce("_name", F.lit("Unknown document"))).drop("_name")


def resolve_documents(questions: DataFrame, documents: DataFrame, threshold: float = 0.45, latest: int = 20) -> DataFrame:
    """The tenant's document that a question names: query_id, doc_id, match. By tenant, over its ``latest`` files."""
    from corpusengine.functions.similarity import ratio_bound, sequence_ratio

    w = Window.partitionBy("tenant").orderBy(F.desc("created_at"), F.desc("doc_id"))
    recent = documents.filter("filename <> ''").withColumn("ord", F.row_number().over(w)).filter(F.col("ord") <= latest)
    met = questions.join(recent, "tenant").withColumn("name", T.filename_words(F.col("filename"))).withColumn("q", F.lower("question"))
    tokens = F.filter(F.split("name", " "), lambda t: t != "")
    hit = F.filter(tokens, lambda t: (F.length(t) > 2) & F.contains(F.col("q"), t))
    share = F.when(F.size(tokens) > 0, F.size(hit) / F.size(tokens)).otherwise(0.0)
    met = met.withColumn("share", share)
    # the sequence ratio is worked out only where its bound can beat the share and the threshold
    close = met.withColumn("open", ratio_bound(F.col("name"), F.col("q")) >= F.greatest("share", F.lit(threshold)))
    seq = close.filter("open").withColumn("match", F.greatest("share", sequence_ratio(F.col("name"), F.col("q"))))
    both = seq.unionByName(close.filter("not open").withColumn("match", F.col("share")))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("match"), "ord"))
    return both.withColumn("n", best).filter((F.col("n") == 1) & (F.col("match") >= threshold)).select("query_id", "doc_id", F.round("match", 6).alias("match"))


def match_titles(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """First label (tenant, label, ord) that shares two content words with the question, one of four characters or more."""
    both = F.array_intersect(T.content_words(F.col("question")), T.content_words(F.col("label")))
    met = questions.join(labels, "tenant").withColumn("both", both).filter((F.size("both") >= 2) & F.exists("both", lambda t: F.length(t) >= 4))
    return met.groupBy("query_id").agg(F.min_by("label", "ord").alias("label"))


def shape_results(hits: DataFrame) -> DataFrame:
    scores = {c: F.round(c, 3) for c in ("score", "vector_score", "keyword_score", "combined_score", "rerank_score") if c in hits.columns}
    return hits.withColumns({"text": F.substring("text", 1, 500), **scores})


def admit_queries(queries: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected questions (blank, or longer than ``limit``)."""
    reason = F.when(F.coalesce(F.trim("question"), F.lit("")) == "", "blank").when(F.length("question") > limit, "too long")
    judged = queries.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def grade(queries: DataFrame, hits: DataFrame, low: float = 0.05) -> DataFrame:
    """rejected without documents, low_confidence when the first one's score is not above ``low``, else accepted."""
    top = hits.groupBy("query_id").agg(F.min_by(result_score(), "rank").alias("top"))
    return queries.join(top, "query_id", "left").withColumn("grade", F.when(F.col("top").isNull(), "rejected").when((F.col("top") <= 0) | (F.col("top") < low), "low_confidence").otherwise("accepted"))


def search_messages(messages: DataFrame, query: str, channel: str | None = None, sender: str | None = None, oldest=None, latest=None, count: int = 10) -> DataFrame:
    """Newest messages that hold ``query``, at most ``count`` (1 to 100), with the total before the cut."""
    found = messages.filter(F.contains(F.lower("text"), F.lit(query.lower())))
    for column, value in (("channel", channel), ("sender", sender)):
        found = found if value is None else found.filter(F.col(column) == value)
    found = found if oldest is None else found.filter(F.col("ts") >= oldest)
    found = found if latest is None else found.filter(F.col("ts") <= latest)
    ids = [c for c in ("conv_id", "turn") if c in found.columns]
    count = min(max(count, 1), 100)
    # a top-n of every task, merged; the total is one number
    return found.orderBy(F.desc("ts"), *ids).limit(count).withColumn("total", found.agg(F.count("*")).scalar())
