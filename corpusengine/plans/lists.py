"""Queries over ranked lists, tables and texts made from orders, line items, parts and events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusengine.functions import text as T
from corpusengine.operators import chunking as C
from corpusengine.operators import context as X
from corpusengine.operators import index as I
from corpusengine.operators import retrieval as R
from corpusengine.operators import routing as Q
from corpusengine.plans import corpus, judged
from corpusengine.sources import files as S
from corpusengine.sources import maintenance as K
from corpusengine.sources import tables as G
from corpusengine.session import table

# --- ranked lists: every order is a query, its line items are the hits ---------------------

QUESTIONS = ("compare the rate of Part 1", "rate of Part 1", "rate of Part 1 or Part 2", "what is listed")
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def hits(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, question, doc_id, chunk_index, text, rank, combined_score): two of three hits are rows of a table."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    row = F.concat(F.lit("Row [Part "), (F.col("l_partkey") % 4).cast("string"), F.lit("]: rate="), F.col("l_linenumber").cast("string"))
    text = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("prose about "), F.col("l_partkey").cast("string"))).otherwise(row)
    question = T.first_true([(F.col("l_orderkey") % 4 == k, q) for k, q in enumerate(QUESTIONS)])
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), question.alias("question"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"), text.alias("text"), n.alias("rank"), F.col("l_discount").alias("combined_score"), F.col("l_quantity").alias("quantity"))


_CASE = " ".join(f"WHEN {k} THEN '{q}'" for k, q in enumerate(QUESTIONS))
HITS = f"""h AS (SELECT l_orderkey AS query_id, CASE l_orderkey % 4 {_CASE} END AS question, l_partkey AS doc_id, l_linenumber AS chunk_index, CASE WHEN l_partkey % 3 <> 0 THEN 'Part ' || (l_partkey % 4) END AS entity,
CASE WHEN l_partkey % 3 = 0 THEN 'prose about ' || l_partkey ELSE 'Row [Part ' || (l_partkey % 4) || ']: rate=' || l_linenumber END AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)})::INT AS rank, l_discount AS combined_score, l_quantity AS quantity FROM lineitem)"""


def table_row_filter(spark, d):
    return R.filter_table_rows(hits(spark, d)).select("query_id", "rank", "entity")


ROW_FILTER = f"""WITH {HITS}, n AS (SELECT *, question LIKE 'compare%' AS cmp, coalesce(contains(lower(question), lower(entity)), false) AS named FROM h),
q AS (SELECT query_id, count(DISTINCT entity) FILTER (named) AS k FROM n GROUP BY query_id),
f AS (SELECT n.*, k FROM n JOIN q USING (query_id) WHERE NOT (k > 0 AND NOT cmp AND NOT named AND entity IS NOT NULL)),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id, entity ORDER BY rank) AS seen FROM f)
SELECT query_id, rank, entity FROM s WHERE entity IS NULL OR seen <= CASE WHEN cmp THEN 3 WHEN k > 1 THEN 2 ELSE 1 END"""


def narrowed(spark, d):
    got = R.narrow(hits(spark, d).withColumn("rerank_score", F.lit(None).cast("double")).withColumn("wanted", R.candidate_k(F.col("question"))))
    return got.select("query_id", "doc_id", "chunk_index", "rank", "wanted", R.is_comparison(F.col("question")).alias("compares"))


NARROWED = f"""WITH {HITS}, n AS (SELECT *, entity IS NOT NULL AND contains(lower(question), lower(entity)) AS sure, contains(question, 'rate') AS metric, count(*) OVER (PARTITION BY query_id) AS n FROM h),
m AS (SELECT *, count(*) FILTER (sure) OVER (PARTITION BY query_id) AS n_sure, row_number() OVER (PARTITION BY query_id, sure ORDER BY combined_score DESC, rank) AS fill FROM n)
SELECT query_id, doc_id, chunk_index, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, rank)::INT AS rank, CASE WHEN metric THEN 12 ELSE 5 END AS wanted, question LIKE 'compare%' AS compares FROM m WHERE NOT metric OR n <= 5 OR sure OR fill <= 5 - n_sure"""


def best_chunks(spark, d):
    return R.keep_best(hits(spark, d), ["query_id", "doc_id"]).select("query_id", "doc_id", "rank", "combined_score")


BEST = f"WITH {HITS} SELECT query_id, doc_id, rank, combined_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY combined_score DESC, rank) AS n FROM h) WHERE n = 1"


def _length_score(question: pd.Series, text: pd.Series) -> pd.Series:
    return (text.str.len() * 7 % 11).astype(float)


def reranked(spark, d):
    return R.rerank(hits(spark, d), _length_score, 3).select("query_id", "doc_id", "chunk_index", "rerank_score", "rank")


RERANKED = f"WITH {HITS}, s AS (SELECT *, (length(text) * 7 % 11)::DOUBLE AS rerank_score FROM h) SELECT query_id, doc_id, chunk_index, rerank_score, n AS rank FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank)::INT AS n FROM s) WHERE n <= 3"


def shaped_results(spark, d):
    """Hits with file names, of which the registry lacks some, shaped for an answer."""
    registry = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("filename"))
    got = R.shape_results(R.with_filenames(hits(spark, d).withColumn("score", F.col("quantity") / 7), registry))
    return got.select("query_id", "doc_id", "rank", "filename", "text", "score")


SHAPED = f"WITH {HITS} SELECT query_id, doc_id, rank, coalesce(p_name, 'Unknown document') AS filename, text[1:500] AS text, round(quantity / 7, 3) AS score FROM h LEFT JOIN part ON p_partkey = doc_id AND p_size > 10"


def hybrid_full(spark, d):
    """Keyword and vector search of every benchmark question, fused, row-filtered and cut, as one operator."""
    keyword = I.keyword_search(corpus.questions(spark, d), corpus.chunks(spark, d), 20).select("query_id", "doc_id", "score", "rank")
    vector = R.vector_search(corpus._question_vectors(spark, d), corpus._vectors(spark, d), 20)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return R.hybrid_search(asked, keyword, vector, corpus.docs(spark, d)).select("query_id", "doc_id", "combined_score", "search_type", "rank")


HYBRID = corpus.HYBRID.replace("SELECT * FROM (SELECT query_id, doc_id, vector_score, keyword_score, combined_score", "SELECT query_id, doc_id, combined_score, search_type, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank FROM (SELECT query_id, doc_id, combined_score").replace("WHERE rank <= 6", "SEMI JOIN documents USING (doc_id) WHERE rank <= 20 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 6")


def unknown_tenants(spark, d):
    """Questions of tenants of which most have no documents; those get no rows."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("tenant"), "text")
    return I.keyword_search(asked, corpus.chunks(spark, d), corpus.TOP)


UNKNOWN = corpus.KEYWORD.replace("'src' || (item_id % 20)", "'src' || item_id")


def admitted_queries(spark, d):
    asked = corpus.docs(spark, d).select("doc_id", F.col("text").alias("question"))
    good, bad = R.admit_queries(asked)
    return good.withColumn("reason", F.lit("accepted")).unionByName(bad).groupBy("reason").agg(F.count("*").alias("n"))


ADMITTED = "SELECT CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'blank' WHEN length(text) > 500 THEN 'too long' ELSE 'accepted' END AS reason, count(*) AS n FROM documents GROUP BY 1"


def _registry(spark, d):
    """Parts as documents: tenant is the brand, the newest have the largest keys."""
    status = F.when(F.col("p_size") % 3 == 0, "failed").otherwise("processed")
    meta = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    return table(spark, d, "part").select(F.col("p_brand").alias("tenant"), F.col("p_partkey").alias("doc_id"), F.col("p_partkey").alias("created_at"), status.alias("status"), F.col("p_name").alias("title"), F.concat(F.regexp_replace("p_name", " ", "_"), F.lit(".pdf")).alias("filename"), meta.alias("metadata"))


def recent_labels(spark, d):
    return R.recent_labels(_registry(spark, d))


LABELS = """l AS (SELECT p_brand AS tenant, unnest([p_name, replace(p_name, ' ', '_') || '.pdf']) AS label, unnest([0, 1]) AS k, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS n FROM part WHERE p_size % 3 <> 0) WHERE n <= 20),
rl AS (SELECT * FROM (SELECT tenant, label, row_number() OVER (PARTITION BY tenant ORDER BY place)::INT AS ord FROM (SELECT tenant, label, min(n * 2 + k) AS place FROM l GROUP BY tenant, label)) WHERE ord <= 20)"""
RECENT = f"WITH {LABELS} SELECT * FROM rl"


def title_matches(spark, d):
    asked = table(spark, d, "part").select(F.col("p_brand").alias("tenant"), F.col("p_partkey").alias("query_id"), F.concat(F.lit("is the "), "p_name", F.lit(" in stock")).alias("question"))
    return R.match_titles(asked, R.recent_labels(_registry(spark, d)))


TITLES = f"""WITH {LABELS}, q AS (SELECT p_brand AS tenant, p_partkey AS query_id, {corpus._cw("'is the ' || p_name || ' in stock'")} AS w FROM part), x AS (SELECT tenant, label, ord, {corpus._cw("label")} AS w FROM rl)
SELECT query_id, min_by(label, ord) AS label FROM (SELECT query_id, label, ord, list_intersect(q.w, x.w) AS b FROM q JOIN x USING (tenant)) WHERE len(b) >= 2 AND len(list_filter(b, lambda t: length(t) >= 4)) > 0 GROUP BY query_id"""


ASKS = ("is the {} in stock", "weather in Paris about {}", "list the users of {}", "explain {}", "is {} in my document", "latest news today")


def title_routes(spark, d):
    """Routes of questions that name, or don't name, a document of their tenant, on the table of titles."""
    k = F.col("p_partkey")
    asks = F.get(F.array(*map(F.lit, ASKS)), (k % len(ASKS)).cast("int"))
    asked = table(spark, d, "part").select(F.col("p_brand").alias("tenant"), k.alias("query_id"), F.replace(asks, F.lit("{}"), F.col("p_name")).alias("question"))
    found = Q.with_titles(asked, R.recent_labels(_registry(spark, d)))
    return Q.route(found, title="title").select("query_id", "title", "rule", "source", "confidence")


def _title_routes() -> str:
    rules = [(judged._fits(r), r.name, r.source, r.confidence) for r in (*Q.RULES, *Q.FALLBACK, *Q.AFTER_ACTIVE)]
    rules.insert([r[1] for r in rules].index("document") + 1, ("title IS NOT NULL", "title_match", "documents", 0.95))
    pick = lambda k, default: "CASE " + " ".join(f"WHEN {x[0]} THEN {x[k] if k == 3 else judged.quoted(x[k])}" for x in rules) + f" ELSE {default} END"
    asks = "[" + ", ".join(judged.quoted(a) for a in ASKS) + "]"
    return f"""WITH {LABELS}, q0 AS (SELECT p_brand AS tenant, p_partkey AS query_id, replace({asks}[p_partkey % {len(ASKS)} + 1], '{{}}', p_name) AS q FROM part), q1 AS (SELECT *, {corpus._cw("q")} AS w FROM q0), x AS (SELECT tenant, label, ord, {corpus._cw("label")} AS w FROM rl),
t AS (SELECT query_id, min_by(label, ord) AS title FROM (SELECT query_id, label, ord, list_intersect(q1.w, x.w) AS b FROM q1 JOIN x USING (tenant)) WHERE len(b) >= 2 AND len(list_filter(b, lambda t: length(t) >= 4)) > 0 GROUP BY query_id),
m AS (SELECT q0.query_id, q, title FROM q0 LEFT JOIN t USING (query_id))
SELECT query_id, title, {pick(1, "'default'")} AS rule, {pick(2, "'documents'")} AS source, ({pick(3, "0.5")})::DOUBLE AS confidence FROM m"""


def latest_metadata(spark, d):
    return R.latest_metadata(_registry(spark, d))


METADATA = "SELECT tenant, metadata FROM (SELECT p_brand AS tenant, CASE WHEN p_size % 2 = 0 THEN p_type END AS metadata, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS n FROM part) WHERE n = 1"


def found_messages(spark, d):
    m = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("sender"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("ts"))
    return R.search_messages(m, "en", sender="user", oldest=1000, count=50).select("conv_id", "turn", "ts", "total")


MESSAGES = "SELECT conv_id, turn, conv_id * 1000 + turn AS ts, count(*) OVER () AS total FROM conversations WHERE role = 'user' AND contains(lower(text), 'en') AND conv_id * 1000 + turn >= 1000 ORDER BY ts DESC LIMIT 50"

# --- context ------------------------------------------------------------------------------


def _evidence(spark, d):
    h = hits(spark, d).withColumn("protected", F.col("quantity") > 45).withColumn("score", F.col("combined_score"))
    return X.pick_evidence(h.withColumn("filename", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("f"), F.col("doc_id").cast("string")))))


EVIDENCE = f"{HITS}, ev AS (SELECT * FROM (SELECT *, quantity > 45 AS protected, row_number() OVER (PARTITION BY query_id ORDER BY quantity > 45 DESC, CASE WHEN quantity > 45 THEN rank END, combined_score DESC, rank) AS place FROM h) WHERE place <= 4)"


def source_cards(spark, d):
    """Cards of an order's evidence, and of its customer as a web entry."""
    web = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("query_id"), F.lit(1).alias("place"), F.lit("Web").alias("title"), F.col("o_orderpriority").alias("snippet"))
    cards = X.source_cards(_evidence(spark, d), web)
    return cards.select("query_id", F.array_join(F.transform("sources", lambda c: F.concat_ws("|", "query_id", c["filename"], c["text"], c["doc_id"].cast("string"))), ";").alias("cards"))


CARDS = f"""WITH {EVIDENCE}, c AS (SELECT query_id, 0 AS kind, place, query_id || '|' || coalesce(CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id END, 'Source ' || place) || '|' || text || '|' || doc_id AS card FROM ev
UNION ALL SELECT o_orderkey, 1, 1, o_orderkey || '|Web|' || o_orderpriority FROM orders WHERE o_orderstatus = 'P')
SELECT query_id, string_agg(card, ';' ORDER BY kind, place) AS cards FROM c GROUP BY query_id"""


def _fold(budget: int) -> str:
    """SQL: which of at most four blocks fit, one after the other."""
    used, out = "0", []
    for k in range(1, 5):
        fits = f"(coalesce(p{k}, false) OR ({used}) + coalesce(t{k}, 0) <= {budget}) AND t{k} IS NOT NULL"
        out.append(f"u{k - 1} AS (SELECT *, {fits} AS f{k} FROM {'pv' if k == 1 else f'u{k - 2}'})")
        used += f" + CASE WHEN f{k} THEN t{k} ELSE 0 END"
    return ", ".join(out) + f", fd AS (SELECT *, {used} AS used FROM u3)"


PIVOT = "pv AS (SELECT query_id, " + ", ".join(f"max({T_}) FILTER (place = {k}) AS {n}{k}" for k in range(1, 5) for n, T_ in (("t", "tok"), ("x", "text"))) + ", " + ", ".join(f"bool_or(protected) FILTER (place = {k}) AS p{k}" for k in range(1, 5)) + " FROM ev1 GROUP BY query_id)"
BLOCKS = "concat_ws(chr(10) || chr(10), " + ", ".join(f"CASE WHEN f{k} THEN '[Source {k}]' || chr(10) || x{k} END" for k in range(1, 5)) + ")"
INCLUDED = "concat_ws(',', " + ", ".join(f"CASE WHEN f{k} THEN '{k}' END" for k in range(1, 5)) + ")"
TOKENS = "(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT"


def packed_with_tools(spark, d):
    """Evidence of every order within a small budget, and the result lines of its tools."""
    e = _evidence(spark, d).withColumn("text", F.repeat("text", (F.col("doc_id") % 40).cast("int")))
    kind = F.when(F.col("o_orderkey") % 2 == 0, "database").otherwise("weather")
    line = X.tool_line(kind, F.col("o_orderpriority"), F.col("o_custkey"), F.col("o_orderstatus"), F.when(F.col("o_orderstatus") == "F", "failed"))
    tools = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit(1).alias("place"), line.alias("line"))
    got = X.pack_context(e, 700, tools=tools)
    return got.select("query_id", F.md5("context").alias("context"), F.array_join(F.transform("included", lambda i: i.cast("string")), ",").alias("included"), "used")


PACKED_TOOLS = f"""WITH {EVIDENCE}, ev1 AS (SELECT query_id, place, text, protected, {TOKENS} AS tok FROM (SELECT query_id, place, protected, repeat(text, doc_id % 40) AS text FROM ev)), {PIVOT}, {_fold(150)},
tl AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderkey % 2 = 0 THEN '[Database Result] ' || o_orderpriority || ': ' || o_custkey || ' record(s).' ELSE '[Weather Result] ' || o_orderstatus END AS line FROM orders)
SELECT query_id, md5(CASE WHEN {BLOCKS} = '' AND line IS NULL THEN '(no context available)' ELSE concat_ws(chr(10) || chr(10), nullif({BLOCKS}, ''), line) END) AS context, coalesce({INCLUDED}, '') AS included, coalesce(used, 0)::BIGINT AS used
FROM fd FULL JOIN (SELECT * FROM tl WHERE line IS NOT NULL) t USING (query_id)"""
PACKED = f"""WITH {corpus.BM25}, ev AS (SELECT query_id, k.doc_id, text, rank = 3 AS protected, row_number() OVER (PARTITION BY query_id ORDER BY rank = 3 DESC, CASE WHEN rank = 3 THEN rank END, score DESC, rank) AS place FROM k JOIN documents USING (doc_id) WHERE rank <= {corpus.TOP}),
ev1 AS (SELECT *, {TOKENS} AS tok FROM ev WHERE place <= 4), {PIVOT}, {_fold(2048 - 550)} SELECT query_id, md5(CASE WHEN {BLOCKS} = '' THEN '(no context available)' ELSE {BLOCKS} END) AS context, {INCLUDED} AS included, used::BIGINT AS used FROM fd"""


def answer_states(spark, d):
    """What an answer stands on and how sure it is, with tool and metadata lines, for every order as a run."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    docs, web, routed, tool = k % 2 == 0, F.col("o_orderstatus") == "F", k % 3 == 0, k % 5 == 0
    c = X.confidence(F.col("o_totalprice") / 700000, docs, F.col("o_custkey") % 100 / 100, tool, F.col("o_orderpriority") != "5-LOW")
    authors = F.when(tool, F.array(F.lit("A"), F.col("o_orderstatus"))).otherwise(F.array().cast("array<string>"))
    return o.select("o_orderkey", X.sufficiency(docs, web, routed).alias("evidence"), F.round(c, 9).alias("confidence"), F.round(X.final_confidence(c, F.col("o_totalprice") / 700000, docs | tool), 9).alias("final_confidence"), X.metadata_text(F.col("o_orderpriority"), authors, F.array(F.lit("U"))).alias("metadata"))


STATES = r"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'documents only, web failed' ELSE 'enough' END WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'nothing found, web failed' ELSE 'nothing found in documents' END WHEN o_orderstatus = 'F' THEN 'web failed' ELSE 'no evidence needed' END AS evidence,
round(CASE WHEN o_orderpriority = '5-LOW' THEN least(c, 0.3) ELSE c END, 9) AS confidence, round(CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 5 <> 0 THEN o_totalprice / 700000 * 0.3::DOUBLE WHEN o_orderpriority = '5-LOW' THEN least(c, 0.3) ELSE c END, 9) AS final_confidence, 'Title: ' || o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || 'Authors: A, ' || o_orderstatus ELSE '' END || chr(10) || 'Affiliations: U' AS metadata
FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN least(1.0::DOUBLE, 0.5 * o_totalprice / 700000 + 0.5 * (o_custkey % 100 / 100)) WHEN o_orderkey % 5 = 0 THEN greatest(o_totalprice / 700000, 0.85) ELSE o_totalprice / 700000 END AS c FROM orders)"""

# --- text ---------------------------------------------------------------------------------


def names_and_fields(spark, d):
    """E-mail checks, row labels and field names made from customers."""
    c = table(spark, d, "customer")
    name, key = F.regexp_replace("c_name", "#", ""), F.col("c_custkey")
    email = F.concat(name, F.when(key % 3 == 0, " @x.org").when(key % 3 == 1, "@Mail.Example.com").otherwise("@nowhere"))
    label = F.concat(F.lit(" -"), "c_mktsegment", F.when(key % 2 == 0, " (Ours)").otherwise(" w/o rain"))
    field = F.concat("c_mktsegment", F.when(key % 2 == 0, " → ").otherwise(" -> "), F.lit("S x"))
    return c.select("c_custkey", T.valid_email(email).alias("email_ok"), T.entity_name(label).alias("entity"), T.field_token(field).alias("field"))


NAMES = "SELECT c_custkey, c_custkey % 3 = 1 AS email_ok, c_mktsegment AS entity, lower(c_mktsegment) || '->sx' AS field FROM customer"


def number_tokens(spark, d):
    li = table(spark, d, "lineitem")
    n = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "−").otherwise(""), F.format_number(F.col("l_extendedprice"), 2), F.when(F.col("l_linenumber") % 3 == 0, "%").otherwise(""))
    # the text is a column, made once and not once a use
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", n.alias("number")).select("l_orderkey", "l_linenumber", "l_suppkey", T.number_token(F.col("number")).alias("token"), T.without_references(F.concat(F.lit("see Table "), F.col("l_linenumber").cast("string"), F.lit(" for it"))).alias("plain"))


NUMBERS = "SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '' END || regexp_replace(l_extendedprice::DECIMAL(15,2)::VARCHAR, '\\.?0*$', '') AS token, 'see  for it' AS plain FROM lineitem".replace("\\\\", "\\")


def ranges_and_rows(spark, d):
    """Lines with a range, and positional rows, made from line items."""
    li = table(spark, d, "lineitem")
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    text = F.concat(F.lit("rises from "), n, F.lit(" to "), q, F.lit(" when "), "l_returnflag", F.lit("."))
    row = F.concat(F.lit("Base\n"), n, F.lit("\n"), q, F.lit("\nend"))
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", T.annotate_ranges(text).alias("note"), T.label_positional_row(row, "Base", ["line", "quantity"]).alias("row"))


RANGES = "SELECT l_orderkey, l_linenumber, l_suppkey, 'rises from ' || l_linenumber || ' to ' || l_quantity::INT || ' when ' || l_returnflag || '.' || chr(10) || '[Range: start=' || l_linenumber || ', end=' || l_quantity::INT || ', condition=' || l_returnflag || ']' AS note, 'Base: line=' || l_linenumber || ', quantity=' || l_quantity::INT || chr(10) || 'end' AS row FROM lineitem"


def message_totals(spark, d):
    """Tokens of whole conversations, and the inputs of an embedding."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("m"))
    texts = F.transform("m", lambda x: x["text"])
    return c.select("conv_id", T.total_tokens(texts).alias("tokens"), F.md5(T.embedding_input("search_query", F.get("m", F.lit(0))["text"])).alias("first"))


TOTALS = "SELECT conv_id, sum(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)::INT AS tokens, md5('search_query: ' || min_by(text, turn)) AS first FROM conversations GROUP BY conv_id"


def change_hashes(spark, d):
    """Whether two writings of one record hash the same: keys in another order do, another value doesn't."""
    o = table(spark, d, "orders")
    a, b = F.create_map(F.lit("key"), "o_orderkey", F.lit("customer"), "o_custkey"), F.create_map(F.lit("customer"), "o_custkey", F.lit("key"), "o_orderkey")
    other = F.create_map(F.lit("customer"), "o_custkey", F.lit("key"), F.col("o_orderkey") + (F.col("o_orderkey") % 2))
    return o.select("o_orderkey", (T.change_hash(a) == T.change_hash(b)).alias("same"), (T.change_hash(a) == T.change_hash(other)).alias("unchanged"), F.length(T.change_hash(a)).alias("size"))


CHANGES = "SELECT o_orderkey, true AS same, o_orderkey % 2 = 0 AS unchanged, 12 AS size FROM orders"


def _responses(spark, d):
    """Raw responses of a model made from orders: bare, fenced, embedded before more text, broken, and without a title."""
    k = F.col("o_orderkey").cast("string")
    obj = F.concat(F.lit('{"title":"T'), k, F.lit('","a":{"b":"}{"},"authors":["x"]}'))
    kinds = [obj, F.concat(F.lit("```json\n"), obj, F.lit("\n```")), F.concat(F.lit("so: "), obj, F.lit(' and {"c":2}')), F.concat(F.lit("no "), F.substring(obj, 1, 20)), F.lit('{"title":" "}')]
    return table(spark, d, "orders").select("o_orderkey", T.first_true([(F.col("o_orderkey") % 5 == i, x) for i, x in enumerate(kinds)]).alias("raw"))


def salvaged(spark, d):
    r = _responses(spark, d)
    kept, dropped = T.named_sources(F.concat(F.lit('Sure: {"sources": ["Web", "moon", "documents"'), F.when(F.col("o_orderkey") % 2 == 0, "]").otherwise(""), F.lit("}")), ["web", "documents"])
    return r.select("o_orderkey", T.object_of(F.col("raw")).alias("object"), T.parse_stage(F.col("raw")).alias("stage"), T.metadata_record(F.col("raw"))["title"].alias("title"), F.array_join(kept, ",").alias("sources"), F.array_join(dropped, ",").alias("dropped"))


SALVAGED = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN '{"title":" "}' ELSE '{"title":"T' || o_orderkey || '","a":{"b":"}{"},"authors":["x"]}' END AS object,
CASE o_orderkey % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'fenced' WHEN 2 THEN 'embedded' WHEN 3 THEN 'failed' ELSE 'direct' END AS stage, CASE WHEN o_orderkey % 5 < 3 THEN 'T' || o_orderkey END AS title,
CASE WHEN o_orderkey % 2 = 0 THEN 'web,documents' ELSE '' END AS sources, CASE WHEN o_orderkey % 2 = 0 THEN 'moon' ELSE '' END AS dropped FROM orders"""

# --- chunks and files ---------------------------------------------------------------------


def figures(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("seq"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("heading"), F.col("p_type").alias("caption"), F.when(F.col("p_size") % 3 > 0, F.col("p_name")).otherwise("").alias("description"))
    return C.figure_chunks(p)


FIGURES = "SELECT p_partkey AS doc_id, 0 AS seq, CASE WHEN p_size > 25 THEN '[Section: ' || p_brand || ']' || chr(10) ELSE '' END || 'Figure: ' || p_type || chr(10) || p_name AS text FROM part WHERE p_size % 3 > 0"


def recovered_pages(spark, d):
    """Line items as attempts on an order's pages: the first stage that worked gives the page's text."""
    a = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(F.bool_or(F.col("l_linestatus") == "F").alias("ok"))
    a = a.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.instr(F.lit("ANR"), F.col("l_returnflag")).alias("stage"), "ok", F.col("l_returnflag").alias("text"))
    return C.recover_pages(a)


RECOVERED = """WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, strpos('ANR', l_returnflag)::INT AS stage, bool_or(l_linestatus = 'F') AS ok, l_returnflag AS text FROM lineitem GROUP BY ALL)
SELECT doc_id, page, min_by(text, stage) FILTER (ok) AS text, min(stage) FILTER (ok) AS stage, NOT bool_or(ok) AS lost FROM a GROUP BY doc_id, page"""


def uploads(spark, d):
    """Parts as uploads of several types and sizes: admitted or not and why, and which can be parsed here."""
    k = F.col("p_partkey")
    kind = T.first_true([(k % 6 == i, x) for i, x in enumerate((".PDF", ".txt", ".exe", "", ".csv", ".docx"))])
    up = table(spark, d, "part").select(F.when(k % 11 > 0, F.concat("p_name", kind)).alias("filename"), F.when(k % 7 == 0, 1 << 30).otherwise(k).alias("size_bytes"))
    ok, bad = S.admit_uploads(up)
    parsed, other = S.dispatch(ok.withColumn("path", F.col("filename")))
    kinds = bad.select("reason").unionByName(parsed.select(F.concat(F.lit("parsed "), "format").alias("reason"))).unionByName(other.select(F.concat(F.lit("not parsed "), "format").alias("reason")))
    return kinds.groupBy("reason").agg(F.count("*").alias("n"))


UPLOADS = """SELECT CASE WHEN p_partkey % 11 = 0 THEN 'null_name' WHEN p_partkey % 6 IN (2, 3) THEN 'bad_type' WHEN p_partkey % 7 = 0 THEN 'too_large' ELSE CASE WHEN p_partkey % 6 IN (1, 4) THEN 'parsed ' ELSE 'not parsed ' END || ['pdf', 'txt', '', '', 'csv', 'docx'][p_partkey % 6 + 1] END AS reason, count(*) AS n FROM part GROUP BY 1"""


def stored(spark, d):
    c = corpus.chunks(spark, d).withColumn("tenant", F.when(F.col("doc_id") % 9 > 0, F.col("tenant"))).withColumn("embedding", F.lit(None).cast("array<float>"))
    return S.stored_chunks(c).groupBy("tenant").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


STORED = "SELECT source AS tenant, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE doc_id % 9 > 0 AND text <> '' GROUP BY source"


def second_pages(spark, d):
    listing = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("tenant"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("created_at"))
    return S.pages_per_tenant(listing, 3, 4).select("tenant", "doc_id", "place")


SECOND = "SELECT * FROM (SELECT o_custkey::VARCHAR AS tenant, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS place FROM orders) WHERE place > 3 AND place <= 7"

# --- maintenance --------------------------------------------------------------------------


def paired(spark, d):
    """Documents and vectors by number: what stands on one side only is told, not cut."""
    c = table(spark, d, "documents").select("doc_id", F.lit(0).alias("chunk_index"))
    e = table(spark, d, "embeddings").filter("label % 5 > 0").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_index"), "embedding")
    whole, left = K.pair_embeddings(c, e)
    return whole.select("doc_id", F.lit("paired").alias("reason")).unionByName(left.select("doc_id", "reason"))


PAIRED = "SELECT coalesce(doc_id, vec_id) AS doc_id, CASE WHEN doc_id IS NULL THEN 'no chunk' WHEN vec_id IS NULL THEN 'no embedding' ELSE 'paired' END AS reason FROM documents FULL JOIN (SELECT vec_id FROM embeddings WHERE label % 5 > 0) e ON doc_id = vec_id"


def deleted(spark, d):
    """Chunks without those of documents labelled toxic; a tombstone of another tenant deletes nothing."""
    c = corpus.chunks(spark, d)
    bad = table(spark, d, "labels").filter("toxic = 1").select("doc_id", F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string")).alias("tenant"))
    return K.delete_documents(c, bad).groupBy("tenant").agg(F.count("*").alias("n"))


DELETED = "SELECT source AS tenant, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE toxic = 1 AND l.doc_id = d.doc_id AND 'src' || (l.doc_id % 7) = source) GROUP BY source"


def updated(spark, d):
    """Labels written over documents' status; null columns of a change change nothing."""
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("status"), F.col("n_chars").alias("chunks"))
    changes = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "failed").alias("status"), F.when(F.col("quality") == 1, F.lit(0)).cast("long").alias("chunks"))
    return K.update_columns(rows, changes, "doc_id")


UPDATED = "SELECT doc_id, CASE WHEN toxic = 1 THEN 'failed' ELSE lang END AS status, CASE WHEN quality = 1 THEN 0 ELSE n_chars END AS chunks FROM documents LEFT JOIN labels USING (doc_id)"
AS_OF = "TIMESTAMP '2024-01-10 00:00:00'"


def retained(spark, d):
    e = table(spark, d, "events")
    return K.retain(e, F.expr(AS_OF)).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


RETAINED = f"SELECT event_type, count(*) AS n, min(event_id) AS first FROM events WHERE ts >= {AS_OF} - INTERVAL 7 DAYS GROUP BY event_type"


def own_rows(spark, d):
    """Counts and the newest document of every status, asked by one tenant and by none."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 10).cast("string").alias("tenant"), F.col("o_orderstatus").alias("status"), F.struct("o_orderdate", "o_orderkey").alias("created_at"))
    t = G.Tables({"documents": o, "users": table(spark, d, "customer").withColumn("password_hash", F.md5("c_name"))})
    rows = None
    for name, tenant in (("own", "3"), ("all", None)):
        n = t.count("documents", F.col("status") == "P", tenant).select(F.lit(name).alias("asked"), F.lit("count").alias("what"), "n")
        new = t.latest("documents", tenant=tenant).select(F.lit(name).alias("asked"), F.lit("latest").alias("what"), F.col("doc_id").alias("n"))
        both = n.unionByName(new)
        rows = both if rows is None else rows.unionByName(both)
    users = t.count("users", tenant="3").select(F.lit("users").alias("asked"), F.concat(F.lit("columns "), F.lit(len(t.safe("users").columns)).cast("string")).alias("what"), "n")
    return rows.unionByName(users)


OWN = """WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders), m AS (SELECT * FROM o WHERE o_custkey % 10 = 3)
SELECT 'own' AS asked, 'count' AS what, count(*) FILTER (o_orderstatus = 'P') AS n FROM m UNION ALL SELECT 'own', 'latest', arg_min(o_orderkey, r) FROM m
UNION ALL SELECT 'all', 'count', count(*) FILTER (o_orderstatus = 'P') FROM o UNION ALL SELECT 'all', 'latest', arg_min(o_orderkey, r) FROM o UNION ALL SELECT 'users', 'columns 5', count(*) FROM customer"""


def _embed_fn(texts: list[str]) -> list[list[float]]:
    if any("o" not in t for t in texts):
        raise ValueError("a text without o")
    return [[float(len(t))] for t in texts]


def embedded(spark, d):
    """Part names embedded by a function that fails on some: those keep their error, all others get a vector."""
    got = K.embed(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text")), _embed_fn, 2)
    return got.select("p_partkey", F.get("embedding", F.lit(0)).alias("v"), F.col("error").isNotNull().alias("failed"))


EMBEDDED = "SELECT p_partkey, CASE WHEN contains(p_name, 'o') THEN length(p_name)::DOUBLE END AS v, NOT contains(p_name, 'o') AS failed FROM part"

QUERIES = {
    "r_table_row_filter": (table_row_filter, ROW_FILTER),
    "r_narrowed": (narrowed, NARROWED),
    "r_best_chunks": (best_chunks, BEST),
    "r_reranked": (reranked, RERANKED),
    "r_shaped_results": (shaped_results, SHAPED),
    "r_hybrid_search_full": (hybrid_full, HYBRID),
    "r_unknown_tenants": (unknown_tenants, UNKNOWN),
    "r_admitted_queries": (admitted_queries, ADMITTED),
    "r_recent_labels": (recent_labels, RECENT),
    "r_title_matches": (title_matches, TITLES),
    "q_title_routes": (title_routes, _title_routes()),
    "r_latest_metadata": (latest_metadata, METADATA),
    "r_messages": (found_messages, MESSAGES),
    "x_source_cards": (source_cards, CARDS),
    "x_packed_with_tools": (packed_with_tools, PACKED_TOOLS),
    "x_packed_context": (corpus.packed_context, PACKED),
    "x_answer_states": (answer_states, STATES),
    "t_names_and_fields": (names_and_fields, NAMES),
    "t_number_tokens": (number_tokens, NUMBERS),
    "t_ranges_and_rows": (ranges_and_rows, RANGES),
    "t_message_totals": (message_totals, TOTALS),
    "t_change_hashes": (change_hashes, CHANGES),
    "j_salvaged": (salvaged, SALVAGED),
    "c_figures": (figures, FIGURES),
    "c_recovered_pages": (recovered_pages, RECOVERED),
    "s_uploads": (uploads, UPLOADS),
    "s_stored_chunks": (stored, STORED),
    "s_listing_pages": (second_pages, SECOND),
    "k_paired_embeddings": (paired, PAIRED),
    "k_deleted_documents": (deleted, DELETED),
    "k_updated_columns": (updated, UPDATED),
    "g_retained": (retained, RETAINED),
    "g_own_rows": (own_rows, OWN),
    "e_embedded": (embedded, EMBEDDED),
}
