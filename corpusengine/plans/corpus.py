"""Queries over documents, pages, embeddings and benchmark: text, chunks, index, retrieval.

The tenant of a document is its source; the questions are the benchmark's texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusengine.functions import text as T
from corpusengine.operators import chunking as C
from corpusengine.operators import context as X
from corpusengine.operators import evaluate as M
from corpusengine.operators import index as I
from corpusengine.operators import retrieval as R
from corpusengine.operators import text_chunks as TC
from corpusengine.operators.stored_index import StoredIndex
from corpusengine.operators.vector_index import VectorIndex
from corpusengine.sources import maintenance as K
from corpusengine.session import scratch_dir, table

TOP = 5
#: Cells of the vector index that a query looks into.
PROBES = 16
WORDS_SQL = r"regexp_extract_all(lower(coalesce({t}, '')), '([\p{{L}}\p{{N}}_]+)', 1)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.col("source").alias("tenant"), "doc_id", F.lit(0).alias("chunk_index"), "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text, asked of the tenant numbered like its id modulo the number of sources."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("tenant"), F.col("text"))


# --- text ---------------------------------------------------------------------------------


def text_clean(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", F.md5(T.join_hyphenated_lines(t)).alias("joined"), F.md5(T.chunker_form(t)).alias("form"))


TEXT_CLEAN = r"""SELECT doc_id, md5(regexp_replace(text, '([a-z])-\n([a-z])', '\1\2', 'g')) AS joined,
md5(regexp_replace(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^[\s]+|[\s]+$', '', 'g')) AS form FROM documents"""


def text_decimal_points(spark, d):
    prices = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("paid %s for %s", F.regexp_replace(F.col("l_extendedprice").cast("decimal(15,2)").cast("string"), r"\.", ","), F.col("l_quantity").cast("int").cast("string")).alias("t"))
    return prices.select("l_orderkey", "l_linenumber", T.decimal_points(F.col("t")).alias("t"))


DECIMAL = "SELECT l_orderkey, l_linenumber, 'paid ' || l_extendedprice::DECIMAL(15,2) || ' for ' || l_quantity::INT AS t FROM lineitem"


def html_sanitise(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.sanitise_html(F.col("html"))).alias("h"))


HTML = r"""SELECT page_id, md5(regexp_replace(replace(regexp_replace(regexp_replace(html, '(?i)<script[^>]*>.*?</script>', '', 'g'), '<[^>]+>', '', 'g'), chr(0), ''), '^[\s]+|[\s]+$', '', 'g')) AS h FROM pages"""


def filename_words(spark, d):
    return table(spark, d, "part").select("p_partkey", T.filename_words(F.concat("p_name", F.lit(".PDF"))).alias("name"))


FILENAMES = r"SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(p_name || '.PDF', '\.\w+$', '')), '[^a-z0-9]+', ' ', 'g')) AS name FROM part"


def token_estimate(spark, d):
    return docs(spark, d).groupBy("source").agg(F.sum(T.estimate_tokens(F.col("text"))).cast("long").alias("tokens"), F.max(T.estimate_tokens(F.col("text"))).cast("long").alias("most"))


TOKENS = "SELECT source, sum(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT AS tokens, max(CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT AS most FROM documents GROUP BY source"


def content_overlap(spark, d):
    c = table(spark, d, "conversations")
    a = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("t"), T.content_words(F.col("text")).alias("a"))
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("t"), T.content_words(F.col("text")).alias("b"))
    return a.join(b, ["conv_id", "t"]).select("conv_id", "t", F.round(T.overlap_ratio(F.col("a"), F.col("b")), 6).alias("overlap"))


def _cw(t: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOPWORDS)
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9]+')), lambda w: w NOT IN ({stop}))"


OVERLAP = f"""WITH a AS (SELECT conv_id, turn AS t, {_cw("text")} AS a FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn - 1 AS t, {_cw("text")} AS b FROM conversations WHERE role = 'assistant')
SELECT conv_id, t, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS overlap FROM a JOIN b USING (conv_id, t)"""


def point_ids(spark, d):
    return K.with_point_ids(chunks(spark, d)).select("doc_id", "chunk_index", "id")


POINT_IDS = """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id || '_0')) AS h FROM documents)
SELECT doc_id, 0 AS chunk_index, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM h"""


def cache_keys(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", T.cache_key(F.col("conv_id").cast("string"), F.col("text"), F.lit("v1")).alias("key"))


CACHE_KEYS = "SELECT conv_id, turn, 'querycache:' || md5(lower(conv_id || ':' || text || ':v1')) AS key FROM conversations WHERE role = 'user'"

# --- chunks -------------------------------------------------------------------------------


def chunk_documents(spark, d):
    return TC.chunk_documents(docs(spark, d))


def _chunk_sql() -> str:
    """Splitting by lists, merging by recursion over the pieces; `documents` holds no tables."""
    blanks = "'" + "".join(chr(n) for n in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) + "'"
    tokens = "(CASE WHEN {0} = '' THEN 0 ELSE greatest(1, length({0}) // 4) END)".format
    levels = [f"p0 AS (SELECT doc_id, [{{'s': trim(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), {blanks}), 't': ''}}] AS p FROM documents)"]
    for i, mark in enumerate(("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")):
        cut = f"list_filter(list_transform(string_split(x.s, '{mark}'), lambda s, i: {{'s': trim(s, {blanks}), 't': CASE WHEN i < len(string_split(x.s, '{mark}')) THEN '{mark}' ELSE x.t END}}), lambda q: q.s <> '')"
        keep = f"CASE WHEN {tokens('x.s')} <= 150 THEN [x] ELSE {cut} END" if i else cut
        levels.append(f"p{i + 1} AS (SELECT doc_id, flatten(list_transform(p, lambda x: {keep})) AS p FROM p{i})")
    return f"""WITH RECURSIVE {", ".join(levels)},
hard AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN {tokens('x.s')} <= 150 THEN [x.s || x.t]
  ELSE list_transform(range(0, (length(x.s) - 1) // 600 + 1), lambda j: substr(x.s, j * 600 + 1, 600) || CASE WHEN j = (length(x.s) - 1) // 600 THEN x.t ELSE '' END) END)) AS p FROM p8),
x AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS n FROM hard),
w AS (SELECT doc_id, n, [x] AS held, {tokens('x')} AS k, NULL::VARCHAR AS done FROM x WHERE n = 1
UNION ALL SELECT w.doc_id, x.n, CASE WHEN k + {tokens('x')} <= 150 THEN list_append(held, x) ELSE list_append(held[len(held) - o + 1:], x) END,
  CASE WHEN k + {tokens('x')} <= 150 THEN k + {tokens('x')} ELSE greatest(1, length(array_to_string(list_append(held[len(held) - o + 1:], x), '')) // 4) END,
  CASE WHEN k + {tokens('x')} > 150 THEN array_to_string(held, '') END
FROM (SELECT *, list_max(list_filter(range(0, len(held) + 1), lambda j: coalesce(list_sum(list_transform(held[len(held) - j + 1:], lambda h: {tokens('h')})), 0) <= 50)) AS o FROM w) w JOIN x ON x.doc_id = w.doc_id AND x.n = w.n + 1),
c AS (SELECT doc_id, n, 0 AS l, done FROM w WHERE done IS NOT NULL
UNION ALL SELECT doc_id, max(n), 1, array_to_string(arg_max(held, n), '') FROM w GROUP BY doc_id)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n, l) - 1)::INT AS chunk_index, trim(done, {blanks}) AS text, {tokens('done')}::INT AS tokens FROM c WHERE trim(done, {blanks}) <> ''"""


CHUNKS = _chunk_sql()


def table_blocks(spark, d):
    """Reports of orders, each with a table of its lines that ends in one of three ways."""
    line = F.concat_ws(" ", "l_linenumber", F.floor("l_quantity"), F.floor("l_extendedprice"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("x")))), lambda s: s["x"]), "\n")
    kind = F.col("l_orderkey") % 3
    after = F.when(kind == 0, BREAK).when(kind == 1, PROSE).otherwise(F.concat(F.lit("Table 2: total\n"), F.col("n").cast("string")))
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("rows"), F.count("*").alias("n"))
    reports = orders.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit(f"{INTRO}Table 1: lines\nquantity and price of each\n"), "rows", F.lit("\n"), after).alias("text"))
    return TC.table_blocks(reports)


INTRO = "The order was sent in parts, as the table below says.\n"
BREAK = "\n\nshort text"
PROSE = "The lines above are all that was ordered, and nothing of them came back later."
TABLE_BLOCKS = f"""WITH t AS (SELECT l_orderkey AS doc_id, count(*) AS n, 'Table 1: lines\nquantity and price of each\n' || string_agg(l_linenumber || ' ' || floor(l_quantity)::BIGINT || ' ' || floor(l_extendedprice)::BIGINT, '\n' ORDER BY l_linenumber, l_linenumber || ' ' || floor(l_quantity)::BIGINT || ' ' || floor(l_extendedprice)::BIGINT) AS rows FROM lineitem GROUP BY l_orderkey)
SELECT doc_id, 0 AS block, false AS whole, '{INTRO}' AS text FROM t UNION ALL SELECT doc_id, 1, true, rows FROM t
UNION ALL SELECT doc_id, 2, false, CASE doc_id % 3 WHEN 0 THEN '\nshort text' ELSE '{PROSE}' END FROM t WHERE doc_id % 3 < 2
UNION ALL SELECT doc_id, 3, true, 'Table 2: total\n' || n FROM t WHERE doc_id % 3 = 2"""


def hard_split(spark, d):
    return C.hard_split(docs(spark, d)).select("doc_id", "chunk_index", F.md5("text").alias("h"))


HARD = "SELECT doc_id, i::INT AS chunk_index, md5(substr(text, (i * 600 + 1)::INT, 600)) AS h FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 600 + 1)) AS i FROM documents WHERE length(text) > 0)"


def page_items(spark, d):
    return C.items_of_pages(table(spark, d, "pages"))


PAGE_ITEMS = rf"""WITH b AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS h FROM pages),
m AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?i)<({"|".join(C.ITEM_TAGS)})(\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g'), '(?i)</({"|".join(C.ITEM_TAGS)})\s*>', chr(1) || chr(2), 'g'), '<[^>]*>', '', 'g') AS h FROM b),
p AS (SELECT page_id, unnest(string_split(h, chr(1))) AS part, generate_subscripts(string_split(h, chr(1)), 1) AS k FROM m),
i AS (SELECT page_id, k, lower(split_part(part, chr(2), 1)) AS tag, trim(regexp_replace({{text}}, '\s+', ' ', 'g'), ' ') AS text FROM p WHERE k > 1)
SELECT page_id AS doc_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INT AS seq, CASE WHEN tag = 'table' THEN 'table' WHEN tag[1] = 'h' THEN 'section_header' ELSE 'text' END AS label, text FROM i WHERE tag <> '' AND text <> ''"""
_text = "split_part(part, chr(2), -1)"
for _a, _b in C.CHARACTERS.items():
    _text = f"replace({_text}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
PAGE_ITEMS = PAGE_ITEMS.replace("{text}", _text)


def page_sections(spark, d):
    return C.section_chunks(C.items_of_pages(table(spark, d, "pages")))


PAGE_SECTIONS = f"""WITH RECURSIVE it AS ({PAGE_ITEMS}),
s AS (SELECT *, count(*) FILTER (label = 'section_header') OVER w AS section, last_value(CASE WHEN label = 'section_header' THEN text END IGNORE NULLS) OVER w AS heading FROM it WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
t AS (SELECT doc_id, section, heading, text, greatest(1, length(text) // 4) AS tok, row_number() OVER (PARTITION BY doc_id, section ORDER BY seq) AS n FROM s WHERE label = 'text'),
w AS (SELECT doc_id, section, n, 0 AS part, tok AS size FROM t WHERE n = 1
UNION ALL SELECT t.doc_id, t.section, t.n, CASE WHEN size + tok > 150 THEN part + 1 ELSE part END, CASE WHEN size + tok > 150 THEN tok ELSE size + tok END FROM w JOIN t ON t.doc_id = w.doc_id AND t.section = w.section AND t.n = w.n + 1),
c AS (SELECT doc_id, section, part, coalesce('[Section: ' || any_value(heading) || ']' || chr(10), '') || string_agg(text, ' ' ORDER BY n) AS text FROM w JOIN t USING (doc_id, section, n) GROUP BY doc_id, section, part)
SELECT doc_id, section, part, text, greatest(1, length(text) // 4) AS tokens, row_number() OVER (PARTITION BY doc_id ORDER BY section, part) - 1 AS chunk_index FROM c"""


def order_table_rows(spark, d):
    """Line items of each order as serialised table rows, with a repeated column."""
    cells = F.array(F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", cells.alias("c")))), lambda x: x["c"]).alias("rows"))
    t = rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("seq"), F.lit("Orders").alias("heading"), F.lit(None).cast("string").alias("caption"), F.array(*map(F.lit, ("line", "quantity", "flag", "flag"))).alias("columns"), "rows")
    return C.table_rows(t).drop("row")


ORDER_ROWS = "SELECT l_orderkey AS doc_id, 0 AS seq, '[Section: Orders]' || chr(10) || 'Row [' || l_linenumber || ']: quantity=' || l_quantity::INT || ', flag=' || l_returnflag || ', flag (2)=' || l_linestatus AS text FROM lineitem"


def data_lines(spark, d):
    lines = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(C.is_data_row(F.col("line"))).alias("n_data"), F.count_if(C.is_table_line(F.col("line"))).alias("n_table"))


DATA_LINES = r"""WITH l AS (SELECT doc_id, line, length(regexp_replace(line, '[0-9%.,\-/±()\[\]\s]', '', 'g')) / greatest(length(line), 1) < 0.35 AS data FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '')
SELECT doc_id, count(*) AS n, count(*) FILTER (data) AS n_data, count(*) FILTER (data OR (length(line) < 45 AND NOT ends_with(line, '.'))) AS n_table FROM l GROUP BY doc_id"""


def page_batches(spark, d):
    t = docs(spark, d).select("doc_id", F.ceil(F.col("n_chars") / 600).alias("n_pages"))
    return C.page_batches(t)


BATCHES = "SELECT doc_id, s::BIGINT AS first_page, least(s + 5, n)::BIGINT AS end_page FROM (SELECT doc_id, n, unnest(range(0, n::BIGINT, 5)) AS s FROM (SELECT doc_id, ceil(n_chars / 600) AS n FROM documents) WHERE n > 0)"


def _blocks(spark, d):
    lines = docs(spark, d).select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "block")).filter("block <> ''")
    return lines.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "block")


def boilerplate(spark, d):
    """Lines of a source that aren't on half of its documents, counted."""
    return C.drop_boilerplate(_blocks(spark, d), share=0.02).groupBy("doc_id").agg(F.count("*").alias("n"))


BOILER = """WITH b AS (SELECT source AS doc_id, doc_id AS page, line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''),
p AS (SELECT doc_id, count(DISTINCT page) AS n FROM b GROUP BY doc_id), o AS (SELECT doc_id, line, count(DISTINCT page) AS k FROM b GROUP BY ALL)
SELECT b.doc_id, count(*) AS n FROM b JOIN p USING (doc_id) JOIN o USING (doc_id, line) WHERE NOT (p.n >= 3 AND k >= greatest(3, floor(p.n * 0.02))) GROUP BY b.doc_id"""

# --- index and retrieval ------------------------------------------------------------------


def index_stats(spark, d):
    postings, terms, stats = I.build_index(chunks(spark, d))
    per = postings.groupBy("tenant").agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_words"))
    return per.join(terms.groupBy("tenant").agg(F.count("*").alias("n_terms"), F.max("df").alias("max_df")), "tenant").join(stats.select("tenant", "n", F.round("avgdl", 6).alias("avgdl")), "tenant")


INDEX = f"""WITH c AS (SELECT source AS tenant, doc_id, {WORDS_SQL.format(t="text")} AS w FROM documents), p AS (SELECT tenant, doc_id, term, count(*) AS tf FROM (SELECT tenant, doc_id, unnest(w) AS term FROM c) GROUP BY ALL),
t AS (SELECT tenant, term, count(*) AS df FROM p GROUP BY ALL)
SELECT tenant, (SELECT count(*) FROM p WHERE p.tenant = s.tenant) AS n_postings, (SELECT sum(tf)::BIGINT FROM p WHERE p.tenant = s.tenant) AS n_words, (SELECT count(*) FROM t WHERE t.tenant = s.tenant) AS n_terms, (SELECT max(df) FROM t WHERE t.tenant = s.tenant) AS max_df, n, avgdl
FROM (SELECT tenant, count(*) AS n, round(avg(len(w)), 6) AS avgdl FROM c GROUP BY tenant) s"""

BM25 = f"""c AS (SELECT source AS tenant, doc_id, {WORDS_SQL.format(t="text")} AS w FROM documents), st AS (SELECT tenant, count(*) AS n, avg(len(w)) AS avgdl FROM c GROUP BY tenant),
p AS (SELECT tenant, doc_id, term, count(*) AS tf FROM (SELECT tenant, doc_id, unnest(w) AS term FROM c) GROUP BY ALL), t AS (SELECT tenant, term, count(*) AS df FROM p GROUP BY ALL),
q AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS tenant, term, count(*) AS qtf FROM (SELECT item_id, unnest({WORDS_SQL.format(t="text")}) AS term FROM benchmark) GROUP BY ALL),
i AS (SELECT q.*, qtf * ln((n + 1) / df) AS idf, avgdl FROM q JOIN t USING (tenant, term) JOIN st USING (tenant)),
f AS (SELECT query_id, tenant, sum(idf) AS floor FROM i GROUP BY ALL),
g AS (SELECT query_id, i.tenant, p.doc_id, sum(idf * tf * 2.5 / (1.5 * (0.25 + 0.75 * len(w) / avgdl) + tf)) AS gain FROM i JOIN p USING (tenant, term) JOIN c ON c.doc_id = p.doc_id GROUP BY ALL),
a AS (SELECT f.query_id, f.tenant, c.doc_id, round(coalesce(gain, 0) + floor, 6) AS score FROM f JOIN c USING (tenant) LEFT JOIN g ON g.query_id = f.query_id AND g.doc_id = c.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM a WHERE score > 0)"""


def keyword_topk(spark, d):
    return I.keyword_search(questions(spark, d), chunks(spark, d), TOP)


KEYWORD = f"WITH {BM25} SELECT query_id, tenant, doc_id, 0 AS chunk_index, score, rank::INT AS rank FROM k WHERE rank <= {TOP}"


def keyword_topk_stemmed(spark, d):
    return I.keyword_search(questions(spark, d), chunks(spark, d), TOP, stem=True)


def keyword_scoped(spark, d):
    scoped = questions(spark, d).join(docs(spark, d).groupBy(F.col("source").alias("tenant")).agg(F.min("doc_id").alias("document_id")), "tenant")
    return I.keyword_search(scoped, chunks(spark, d), TOP)


SCOPED = f"WITH {BM25} SELECT query_id, k.tenant, doc_id, 0 AS chunk_index, score, 1 AS rank FROM a k JOIN (SELECT source AS tenant, min(doc_id) AS d FROM documents GROUP BY source) m ON m.tenant = k.tenant AND m.d = k.doc_id WHERE score > 0"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("all").alias("tenant"), "embedding")


def vector_topk(spark, d):
    v = _vectors(spark, d)
    q = v.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "tenant", "embedding")
    return R.vector_search(q, v, 10)


VECTOR = """SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id)::INT AS rank
FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE rank <= 10"""


def stored_index_search(spark, d):
    """The keyword search over a stored index, by blocks."""
    index = StoredIndex(spark, f"{scratch_dir(spark)}/{uuid.uuid4().hex}")
    index.write(chunks(spark, d))
    return index.search(questions(spark, d), TOP)


def _kept_up_index(spark, d) -> StoredIndex:
    """All documents but every fifth are indexed; then the others come, every seventh is written anew and every eleventh deleted."""
    index = StoredIndex(spark, f"{scratch_dir(spark)}/{uuid.uuid4().hex}")
    every = chunks(spark, d)
    index.write(every.filter("doc_id % 5 <> 0"))
    index.write(every.filter("doc_id % 5 = 0"), every.filter("doc_id % 11 = 0"))
    index.write(every.filter("doc_id % 7 = 0").withColumn("text", F.concat(F.lit("revised edition "), "text")), every.filter("doc_id % 11 = 0"))
    index.write(every.limit(0), every.filter("doc_id % 11 = 0"))
    return index


def kept_up_search(spark, d):
    return _kept_up_index(spark, d).search(questions(spark, d), TOP)


KEPT_UP = "documents AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN 'revised edition ' || text ELSE text END AS text FROM main.documents WHERE doc_id % 11 <> 0)"
KEPT_UP_SEARCH = f"WITH {KEPT_UP}, {BM25} SELECT query_id, tenant, doc_id, 0 AS chunk_index, score, rank::INT AS rank FROM k WHERE rank <= {TOP}"


def kept_up_stats(spark, d):
    index = _kept_up_index(spark, d)
    per = index.sizes()
    terms = index.frequencies().groupBy("tenant").agg(F.count("*").alias("n_terms"), F.max("df").alias("max_df"))
    return per.join(terms, "tenant").join(index.stats().select("tenant", "n", F.round("avgdl", 6).alias("avgdl")), "tenant")


KEPT_UP_STATS = INDEX.replace("WITH c AS", f"WITH {KEPT_UP}, c AS")


def vector_index_search(spark, d):
    """The same queries as the exact search, against a partitioned index of all vectors."""
    v = _vectors(spark, d)
    index = VectorIndex.build(v, f"{scratch_dir(spark)}/{uuid.uuid4().hex}")
    q = v.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "tenant", "embedding")
    return index.search(q, 10, probes=PROBES)


def _question_vectors(spark, d):
    """A benchmark item's vector is the embedding with its number."""
    return table(spark, d, "embeddings").join(table(spark, d, "benchmark"), F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), F.lit("all").alias("tenant"), "embedding")


def hybrid_search(spark, d):
    keyword = I.keyword_search(questions(spark, d), chunks(spark, d), 20).select("query_id", "doc_id", "score", "rank")
    vector = R.vector_search(_question_vectors(spark, d), _vectors(spark, d), 20)
    return R.fuse(vector, keyword, ["query_id", "doc_id"]).filter("rank <= 6")


HYBRID = f"""WITH {BM25}, kw AS (SELECT query_id, doc_id, score, rank FROM k WHERE rank <= 20),
v0 AS (SELECT item_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM benchmark JOIN embeddings e ON e.vec_id = item_id, embeddings v),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v0) WHERE rank <= 20),
m AS (SELECT coalesce(v.query_id, kw.query_id) AS query_id, coalesce(v.doc_id, kw.doc_id) AS doc_id, coalesce(v.score, 0) AS vector_score, greatest(coalesce(kw.score, 0), 0) AS keyword_score, round(coalesce(1 / (60 + v.rank), 0) + coalesce(1 / (60 + kw.rank), 0), 9) AS combined_score, CASE WHEN v.rank IS NULL THEN 'keyword' ELSE 'vector' END AS search_type, v.rank AS vr, kw.rank AS kr FROM v FULL JOIN kw ON v.query_id = kw.query_id AND v.doc_id = kw.doc_id)
SELECT * FROM (SELECT query_id, doc_id, vector_score, keyword_score, combined_score, search_type, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, vr NULLS LAST, kr NULLS LAST)::INT AS rank FROM m) WHERE rank <= 6"""


def retrieval_grades(spark, d):
    q = questions(spark, d).select("query_id")
    return R.grade(q, keyword_topk(spark, d).select("query_id", "rank", F.lit(None).cast("double").alias("rerank_score"), F.col("score").alias("combined_score"))).select("query_id", F.round("top", 6).alias("top"), "grade")


GRADES = f"WITH {BM25} SELECT item_id AS query_id, score AS top, CASE WHEN score IS NULL THEN 'rejected' WHEN score <= 0 OR score < 0.05 THEN 'low_confidence' ELSE 'accepted' END AS grade FROM benchmark LEFT JOIN (SELECT * FROM k WHERE rank = 1) k ON item_id = query_id"


def recall_report(spark, d):
    """Recall, MRR and precision of keyword search, a question's rarest long words being what an answer must hold."""
    keys = questions(spark, d).select(F.col("query_id").alias("id"), F.slice(F.sort_array(F.filter(F.array_distinct(T.words(F.col("text"))), lambda w: F.length(w) > 8)), 1, 3).alias("keywords"))
    hits = keyword_topk(spark, d).join(docs(spark, d).select("doc_id", "text"), "doc_id")
    return M.retrieval_report(M.retrieval_items(keys, hits))


RECALL = f"""WITH {BM25}, y AS (SELECT item_id AS id, list_sort(list_filter(list_distinct({WORDS_SQL.format(t="text")}), lambda w: length(w) > 8))[1:3] AS kw FROM benchmark),
h AS (SELECT y.id, kw, k.rank, len(list_filter(kw, lambda w: contains(lower(d.text), w))) > 0 AS m FROM y LEFT JOIN k ON k.query_id = y.id AND k.rank <= {TOP} LEFT JOIN documents d ON d.doc_id = k.doc_id),
ri AS (SELECT id, min(CASE WHEN m THEN rank END) AS f, CASE WHEN count(rank) > 0 AND max(len(kw)) > 0 THEN count(*) FILTER (m) / count(rank) END AS pr FROM h GROUP BY id)
SELECT count(*) AS n, round(avg(CASE WHEN f IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, round(avg(coalesce(1 / f, 0)), 6) AS mrr, round(avg(pr), 6) AS context_precision FROM ri"""


def packed_context(spark, d):
    hits = keyword_topk(spark, d).join(docs(spark, d).select("doc_id", "text"), "doc_id").withColumn("protected", F.col("rank") == 3)
    return X.pack_context(X.pick_evidence(hits), 2048).select("query_id", F.md5("context").alias("context"), F.array_join(F.transform("included", lambda i: i.cast("string")), ",").alias("included"), "used")


def document_resolution(spark, d):
    names = table(spark, d, "part").select(F.lit("all").alias("tenant"), F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit(".pdf")).alias("filename"), F.col("p_partkey").alias("created_at"))
    asked = table(spark, d, "part").select(F.lit("all").alias("tenant"), F.col("p_partkey").alias("query_id"), F.concat(F.lit("what does "), F.lower("p_name"), F.lit(" say")).alias("question"))
    return R.resolve_documents(asked, names)


def coverage_gate(spark, d):
    pages = docs(spark, d).select("doc_id", F.sequence(F.lit(0), F.floor((F.greatest("n_chars", F.lit(1)) - 1) / 600).cast("int")).alias("pages"))
    got = C.hard_split(docs(spark, d)).filter("chunk_index % 7 <> 3").select("doc_id", F.col("chunk_index").alias("page"))
    return M.coverage(pages, got).select("doc_id", "n_expected", F.round("coverage", 6).alias("coverage"), F.size("missing").cast("long").alias("n_missing"), "complete")


COVERAGE = """WITH p AS (SELECT doc_id, unnest(range(0, (greatest(n_chars, 1) - 1) // 600 + 1)) AS page, length(text) AS n FROM documents), g AS (SELECT *, page % 7 <> 3 AND n > page * 600 AS have FROM p)
SELECT doc_id, count(*) AS n_expected, round(1 - count(*) FILTER (NOT have) / count(*), 6) AS coverage, count(*) FILTER (NOT have) AS n_missing, count(*) FILTER (NOT have) = 0 AS complete FROM g GROUP BY doc_id"""


def replace_reindexed(spark, d):
    """Documents of one source come again, shortened; all others stay."""
    old = chunks(spark, d)
    new = old.filter("tenant = 'src1'").withColumn("text", F.substring("text", 1, 100))
    return K.replace_documents(old, new).groupBy("tenant").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


REPLACED = "SELECT source AS tenant, count(*) AS n, sum(CASE WHEN source = 'src1' THEN least(length(text), 100) ELSE length(text) END)::BIGINT AS chars FROM documents GROUP BY source"


def latest_uploads(spark, d):
    reg = docs(spark, d).select(F.col("source").alias("tenant"), F.concat("lang", (F.col("n_chars") % 10).cast("string")).alias("filename"), "doc_id", F.col("doc_id").alias("created_at"))
    return K.reuploads(reg)[0].select("tenant", "filename", "doc_id")


UPLOADS = "SELECT source AS tenant, lang || (n_chars % 10) AS filename, max(doc_id) AS doc_id FROM documents GROUP BY ALL"

QUERIES = {
    "t_clean": (text_clean, TEXT_CLEAN),
    "t_decimal_points": (text_decimal_points, DECIMAL),
    "t_html_sanitise": (html_sanitise, HTML),
    "t_filename_words": (filename_words, FILENAMES),
    "t_token_estimate": (token_estimate, TOKENS),
    "t_content_overlap": (content_overlap, OVERLAP),
    "t_cache_keys": (cache_keys, CACHE_KEYS),
    "k_point_ids": (point_ids, POINT_IDS),
    "k_replace_reindexed": (replace_reindexed, REPLACED),
    "k_latest_uploads": (latest_uploads, UPLOADS),
    "c_chunk_documents": (chunk_documents, CHUNKS),
    "c_table_blocks": (table_blocks, TABLE_BLOCKS),
    "c_hard_split": (hard_split, HARD),
    "c_page_items": (page_items, PAGE_ITEMS),
    "c_page_sections": (page_sections, PAGE_SECTIONS),
    "c_table_rows": (order_table_rows, ORDER_ROWS),
    "c_data_lines": (data_lines, DATA_LINES),
    "c_page_batches": (page_batches, BATCHES),
    "c_boilerplate": (boilerplate, BOILER),
    "e_coverage": (coverage_gate, COVERAGE),
    "r_index_stats": (index_stats, INDEX),
    "r_keyword_topk": (keyword_topk, KEYWORD),
    "r_keyword_stemmed": (keyword_topk_stemmed, None),
    "r_keyword_scoped": (keyword_scoped, SCOPED),
    "r_vector_topk": (vector_topk, VECTOR),
    "r_vector_index": (vector_index_search, None),
    "r_index_search": (stored_index_search, KEYWORD),
    "r_index_kept_up": (kept_up_stats, KEPT_UP_STATS),
    "r_index_kept_up_search": (kept_up_search, KEPT_UP_SEARCH),
    "r_hybrid_search": (hybrid_search, HYBRID),
    "r_grades": (retrieval_grades, GRADES),
    "r_document_resolution": (document_resolution, None),
    "m_recall_report": (recall_report, RECALL),
}
