"""Queries over run logs made from orders, events and conversations: routing, verdicts, evaluation, memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusengine.functions.text import first_true
from corpusengine.operators import evaluate as M
from corpusengine.operators import routing as Q
from corpusengine.operators import validate as V
from corpusengine.session import table
from corpusengine.streaming import sessions as D


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- questions ----------------------------------------------------------------------------

#: Beginnings of questions; what follows is an order's number. Every rule has one at least.
ASKED = (
    "who are the authors of my paper no", "compare my document with the latest public data of", "summarise the uploaded file no", "how many users are in group", "what is 12 * ", "find slack messages about case", "send an email to customer",
    "weather in Paris on day", "latest news about item", "stock price now of", "explain the meaning of law", "what is recursion", "what is GPT-Neo", "how does it boil", "how does the FullNet work", "history", "total pdfs of year", "according to section",
    "5 apples minus ", "records of year", "today or not, ", "who was king no", "tell me of", "show users of my app in row", "divide 10 by 5 and add", "post it in slack to team", "my latest uploads or sessions since", "is it windy",
)


def questions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    begin = F.get(F.array(*map(F.lit, ASKED)), (k % len(ASKED)).cast("int"))
    end = F.when(k % 2 == 0, F.concat(F.lit(" "), (k % 90).cast("string"))).otherwise("")
    return table(spark, d, "orders").select("o_orderkey", F.concat(begin, end).alias("question"), (k % 3 == 0).alias("active"))


QUESTIONS = f"qs AS (SELECT o_orderkey, [{', '.join(map(quoted, ASKED))}][o_orderkey % {len(ASKED)} + 1] || CASE WHEN o_orderkey % 2 = 0 THEN ' ' || (o_orderkey % 90) ELSE '' END AS q, o_orderkey % 3 = 0 AS active FROM orders)"


def question_routes(spark, d):
    """The rule that decides on each question, of a tenant with documents or without."""
    return Q.route(questions(spark, d), active="active").select("o_orderkey", "rule", "source", "confidence")


def _fits(r: Q.Rule) -> str:
    return " AND ".join([f"regexp_matches(q, {quoted(p)})" for p in r.all_of] + [f"NOT regexp_matches(q, {quoted(p)})" for p in r.none_of])


def _routes() -> str:
    rules = [(_fits(r), r.name, r.source, r.confidence) for r in (*Q.RULES, *Q.FALLBACK)] + [("active", "active_documents", "documents", 0.5)] + [(_fits(r), r.name, r.source, r.confidence) for r in Q.AFTER_ACTIVE]
    pick = lambda k, default: "CASE " + " ".join(f"WHEN {x[0]} THEN {x[k] if k == 3 else quoted(x[k])}" for x in rules) + f" ELSE {default} END"
    return f"WITH {QUESTIONS} SELECT o_orderkey, {pick(1, quoted('default'))} AS rule, {pick(2, quoted('documents'))} AS source, ({pick(3, '0.5')})::DOUBLE AS confidence FROM qs"


def question_intents(spark, d):
    """Arithmetic, concrete tool, structured intent, placeholder and next step of each question."""
    q, k = F.col("question"), F.col("o_orderkey")
    sources = first_true([(k % 5 == i, F.array(*map(F.lit, x))) for i, x in enumerate((("slack",), ("calculator",), ("documents", "web"), ("direct",)))], F.array().cast("array<string>"))
    entity, kind, own = Q.structured_intent(q)
    message, sure = Q.placeholder(sources, ["documents", "calculator", "direct"], F.lit(0.9))
    answered = F.when(k % 7 == 0, "Title: x")
    return questions(spark, d).select("o_orderkey", Q.has_arithmetic(q).alias("arithmetic"), Q.concrete_tool(sources, q).alias("tool"), entity.alias("entity"), kind.alias("kind"), own.alias("own"), message.alias("message"), sure.alias("confidence"), Q.next_step(answered, sources).alias("step"))


def _intents() -> str:
    at = lambda p: f"CASE WHEN regexp_matches(q, '(?i)\\b(?:{p})\\b') THEN length(regexp_extract(q, '(?is)^(.*?)\\b(?:{p})\\b', 1)) END"
    places = ", ".join(f"{at(p)} AS e_{e}" for e, p in Q.ENTITIES.items())
    names = list(Q.ENTITIES)
    least = "least(" + ", ".join(f"e_{e}" for e in names) + ")"
    entity = "CASE " + " ".join(f"WHEN e_{e} = {least} THEN '{e}'" for e in sorted(names)) + " END"
    return rf"""WITH {QUESTIONS}, x AS (SELECT *, {places}, o_orderkey % 5 AS s FROM qs)
SELECT o_orderkey, regexp_matches(q, '(?i)\b(add|sum|plus|minus|subtract|multiply|times|divide|average|difference|total)\b') AND len(regexp_extract_all(q, '\d+(?:\.\d+)?')) >= 2 AS arithmetic,
CASE s WHEN 0 THEN CASE WHEN regexp_matches(q, '(?i)\b(post|send|share|notify)\b') THEN 'slack_post' ELSE 'slack_search' END WHEN 1 THEN 'calculator' END AS tool, {entity} AS entity,
CASE WHEN regexp_matches(q, '(?i)\b(how many|count|number of)\b') THEN 'count' WHEN regexp_matches(q, '(?i)\b(latest|last|newest|most recent)\b') THEN 'latest' ELSE 'list' END AS kind, regexp_matches(q, '(?i)\b(my|mine|i have|i''ve)\b') AS own,
CASE s WHEN 0 THEN 'not available: slack' WHEN 2 THEN 'not available: web' END AS message, (CASE WHEN s IN (0, 2) THEN 0.6 ELSE 0.9 END)::DOUBLE AS confidence,
CASE WHEN o_orderkey % 7 = 0 THEN 'end' WHEN s = 2 THEN 'retriever' WHEN s IN (3, 4) THEN 'answer' ELSE 'tools' END AS step FROM x"""


# --- verdicts -----------------------------------------------------------------------------


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs with the critic's figures."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sources = first_true([(k % 4 == i, F.array(*map(F.lit, x))) for i, x in enumerate((("documents",), ("web", "documents"), ("calculator",)))], F.array(F.lit("direct")))
    answer = F.when(k % 13 == 0, " ").when(k % 17 > 0, F.col("o_orderpriority"))
    return table(spark, d, "orders").select(
        "o_orderkey", sources.alias("sources"), (F.col("o_orderstatus") == "O").alias("is_valid"), F.when(c % 4 > 0, (c % 11) * 10.0).otherwise(c % 2).cast("double").alias("critic_confidence"), ((k % 10) / 10).alias("grounding"),
        F.when(c % 3 > 0, (c % 8) / 8).alias("retrieval"), (k % 3).alias("n_issues"), F.when(F.col("o_orderstatus") == "F", "failed").alias("tool_error"), (k % 5).alias("n_docs"), (c % 2).alias("n_web"),
        F.when(k % 6 > 0, "found").alias("evidence"), F.when(k % 2 == 0, "planning").when(k % 3 == 0, "moon").alias("model_label"), answer.alias("answer"),
    )


RUNS = """rn AS (SELECT o_orderkey, o_orderkey % 4 AS s, o_orderstatus = 'O' AS is_valid, CASE WHEN o_custkey % 4 > 0 THEN (o_custkey % 11) * 10.0 ELSE o_custkey % 2 END AS cc, (o_orderkey % 10) / 10 AS g, coalesce(CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 8) / 8 END, 0.5) AS r,
o_orderkey % 3 AS n_issues, CASE WHEN o_orderstatus = 'F' THEN 'failed' END AS tool_error, o_orderkey % 5 AS n_docs, o_custkey % 2 AS n_web, o_orderkey % 6 = 0 AS nothing, CASE WHEN o_orderkey % 2 = 0 THEN 'planning' ELSE 'unknown' END AS label,
CASE WHEN o_orderkey % 13 = 0 THEN ' ' WHEN o_orderkey % 17 > 0 THEN o_orderpriority END AS answer FROM orders),
jd AS (SELECT *, CASE WHEN cc > 1 THEN cc / 100 ELSE cc END AS c FROM rn),
vd AS (SELECT *, NOT is_valid AND c = 0 AND n_issues = 0 AND g >= 0.8 AND r >= 0.7 AS acc, is_valid AND c >= 0.8 AND g < 0.2 AS rej FROM jd),
fn AS (SELECT *, (is_valid OR acc) AND NOT rej AS verdict, CASE WHEN acc THEN greatest(c, 0.75) WHEN rej THEN least(c, 0.2) ELSE c END AS vc FROM vd)"""


def verdicts(spark, d):
    j = V.failure_class(V.judge(runs(spark, d)))
    return j.select(
        "o_orderkey", "verdict", F.round("verdict_confidence", 6).alias("verdict_confidence"), F.round("blended", 4).alias("blended"), "failure", V.source_validity(F.get("sources", F.lit(0)), F.col("tool_error"), F.col("answer")).alias("source_valid"),
        V.cacheable(F.col("answer"), F.col("tool_error"), F.col("verdict_confidence"), "5-LOW").alias("cacheable"),
    )


VERDICTS = f"""WITH {RUNS} SELECT o_orderkey, verdict, round(vc::DOUBLE, 6) AS verdict_confidence, round_even((0.7::DOUBLE * vc + 0.3::DOUBLE * r)::DOUBLE, 4) AS blended,
CASE WHEN verdict THEN '' WHEN s = 2 AND tool_error IS NOT NULL THEN 'tool' WHEN s IN (0, 1) AND n_docs = 0 THEN 'retrieval' WHEN s = 1 AND n_web = 0 THEN 'tool' WHEN g >= 0.8 THEN label WHEN g < 0.2 AND NOT nothing THEN 'generation' WHEN nothing AND s IN (0, 1) THEN 'retrieval' WHEN nothing AND s = 2 THEN 'tool' ELSE label END AS failure,
CASE s WHEN 2 THEN tool_error IS NULL WHEN 3 THEN coalesce(length(trim(answer, ' ')) > 0, false) END AS source_valid, tool_error IS NULL AND coalesce(trim(answer, ' '), '') <> '' AND answer <> '5-LOW' AND vc > 0 AS cacheable FROM fn"""


def evidence_texts(spark, d):
    r = runs(spark, d)
    text = V.evidence_text(F.when(F.col("n_docs") > 0, "docs"), F.lit("tool line"), F.lit("meta"), F.array_union("sources", F.when(F.col("n_web") == 1, F.array(F.lit("tool"))).otherwise(F.array(F.lit("metadata")))))
    return r.select("o_orderkey", text.alias("evidence"))


EVIDENCE = f"WITH {RUNS} SELECT o_orderkey, concat_ws(chr(10) || chr(10), CASE WHEN s IN (0, 1) AND n_docs > 0 THEN 'docs' END, CASE WHEN n_web = 1 THEN 'tool line' ELSE 'meta' END) AS evidence FROM rn"


def number_checks(spark, d):
    """An answer's numbers against an order's table rows: right ones, ones of another row, and none."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.concat(F.lit("Row [L"), F.col("l_linenumber").cast("string"), F.lit("]: quantity="), F.col("l_quantity").cast("int").cast("string")))).alias("rows"), F.max(F.col("l_quantity").cast("int")).alias("q"))
    answer = F.when(F.col("l_orderkey") % 3 == 0, "It is none.").when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("It is "), F.col("q").cast("string"))).otherwise("It is 777")
    got = li.select("l_orderkey", answer.alias("a"), F.array_join("rows", "\n").alias("c"))
    return got.select("l_orderkey", F.size(V.numbers(F.col("a"))).alias("n_numbers"), V.numbers_grounded(F.col("a"), F.col("c"), F.lit("quantity of it")).alias("grounded"))


NUMBERS = "SELECT DISTINCT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE 1 END AS n_numbers, l_orderkey % 3 <> 2 AS grounded FROM lineitem"


def field_checks(spark, d):
    """Answers about a field of an order's rows: right, of the other field, of no row, or from a source that needs no ground."""
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    row = F.format_string("Row [Item %s]: precision=%d, recall=%d", F.char(64 + line), F.col("l_quantity").cast("int"), (k * 7 + line * line) % 50)
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"), F.max(F.col("l_quantity").cast("int")).alias("q"))
    question = F.when(k % 3 == 0, "What is the precision of it?").when(k % 3 == 1, "Which Recall has it?").otherwise("And how much is it?")
    answer = F.concat(F.lit("It is "), F.when(k % 2 == 0, F.col("q")).otherwise(k % 50).cast("string"), F.lit("."))
    source = F.when(k % 5 == 0, "calculator").when(k % 5 < 4, "documents")
    got = li.select("l_orderkey", answer.alias("a"), "rows", question.alias("question"), source.alias("source"))
    return got.select("l_orderkey", V.numbers_grounded(F.col("a"), F.col("rows"), F.col("question"), strict=True, source=F.col("source"), fields=V.FIELDS).alias("grounded"))


FIELD_CHECKS = """WITH r AS (SELECT l_orderkey AS k, list(l_quantity::INT) AS p, list((l_orderkey * 7 + l_linenumber * l_linenumber) % 50) AS r, max(l_quantity::INT) AS q FROM lineitem GROUP BY 1),
a AS (SELECT *, CASE WHEN k % 2 = 0 THEN q ELSE k % 50 END AS v FROM r)
SELECT k AS l_orderkey, k % 5 = 0 OR k % 3 <> 1 AND list_contains(p, v) OR k % 3 <> 0 AND list_contains(r, v) AS grounded FROM a"""

# --- evaluation ---------------------------------------------------------------------------

SAID = ("", " The paper does not mention it.", " I could not find\nthat.", " There is no relevant information.", " I am not sure.")


def _answers(spark, d):
    """Assistant turns as answers, of which some decline, to items of which some are traps."""
    k = F.col("conv_id") * 7 + F.col("turn")
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    return c.select("conv_id", "turn", F.concat(F.substring("text", 1, 80), F.lit("."), F.get(F.array(*map(F.lit, SAID)), (k % len(SAID)).cast("int"))).alias("answer"), (k % 3 == 0).alias("is_trap"), F.when(k % 4 > 0, "answer").otherwise("retrieval").alias("kind"), F.when(k % 6 > 0, k % 4).alias("n_claims"), (k % 8 == 0).alias("mismatch"))


ANSWERS = f"""an AS (SELECT conv_id, turn, text[1:80] || '.' || [{", ".join("'" + s.replace(chr(10), "' || chr(10) || '") + "'" for s in SAID)}][k % {len(SAID)} + 1] AS answer, k % 3 = 0 AS is_trap, k % 4 > 0 AS asks, CASE WHEN k % 6 > 0 THEN k % 4 END AS n_claims, k % 8 = 0 AS mismatch FROM (SELECT *, conv_id * 7 + turn AS k FROM conversations WHERE role = 'assistant')),
ad AS (SELECT *, regexp_matches(answer, {quoted('(?i)' + '|'.join(f'(?:{p})' for p in M.ABSTENTIONS))}) AS declines, greatest(1, length(answer) - length(translate(answer, '.' || chr(10), ''))) AS sentences FROM an)"""


def answer_scores(spark, d):
    a = F.col("answer")
    return _answers(spark, d).select("conv_id", "turn", M.trap_pass(F.col("is_trap"), a).alias("trap"), M.false_decline(F.col("is_trap"), F.col("kind"), a).alias("false_decline"), F.round(M.faithfulness(F.col("n_claims"), a, F.col("mismatch")), 6).alias("faithful"), M.keyword_hits(a, F.array(F.lit("EN"), F.lit("tion"), F.lit("zzz"))).alias("hits"))


SCORES = f"""WITH {ANSWERS} SELECT conv_id, turn, CASE WHEN is_trap THEN declines END AS trap, CASE WHEN NOT is_trap AND asks THEN declines END AS false_decline,
round(CASE WHEN mismatch THEN CASE WHEN n_claims IS NULL THEN 0.3 ELSE least(greatest(0, 1 - n_claims / sentences), 0.3) END ELSE CASE WHEN n_claims IS NOT NULL THEN greatest(0, 1 - n_claims / sentences) END END, 6)::DOUBLE AS faithful, contains(lower(answer), 'en')::INT + contains(lower(answer), 'tion')::INT AS hits FROM ad"""


def cache_trials(spark, d):
    """Events of a user as the cold and the warm run of an item."""
    run = F.when(F.col("event_id") % 2 == 0, "cold").otherwise("warm")
    t = table(spark, d, "events").select(F.concat(F.when(F.col("user_id") % 3 == 0, "cache_miss_").otherwise("cache_hit_"), F.col("user_id").cast("string")).alias("id"), run.alias("run"), F.col("value").alias("seconds"))
    return M.cache_report(t, 60.0)


CACHE = """WITH p AS (SELECT user_id, max(value) FILTER (event_id % 2 = 0) AS cold, max(value) FILTER (event_id % 2 = 1) AS warm FROM events GROUP BY user_id)
SELECT count(*) AS n, round(avg(CASE WHEN (warm < 60.0) = (user_id % 3 <> 0) THEN 1.0 WHEN warm IS NOT NULL THEN 0.0 END), 6) AS accuracy, round(avg(cold), 2) AS mean_cold, round(avg(warm), 2) AS mean_warm FROM p"""


def _cases(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda x, names: F.get(F.array(*map(F.lit, names)), (x % len(names)).cast("int"))
    return table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("category"), pick(k, ("documents", "web", "database")).alias("source"), pick(c, ("documents", "web")).alias("expected_source"), pick(k, ("sql", "search")).alias("tool"), F.when(c % 3 > 0, pick(c, ("sql", "search"))).alias("expected_tool"),
        F.when(c % 5 == 0, F.array(F.lit("web"), F.lit("database"))).alias("forbidden"), (k % 7 > 0).alias("answered"), F.when(k % 19 == 0, "boom").alias("error"),
    )


CASES = """cs AS (SELECT o_orderkey, o_orderpriority AS category, ['documents', 'web', 'database'][o_orderkey % 3 + 1] AS source, ['documents', 'web'][o_custkey % 2 + 1] AS es, ['sql', 'search'][o_orderkey % 2 + 1] AS tool, CASE WHEN o_custkey % 3 > 0 THEN ['sql', 'search'][o_custkey % 2 + 1] END AS et, o_custkey % 5 = 0 AS f, o_orderkey % 7 > 0 AS answered, o_orderkey % 19 = 0 AS err FROM orders),
ck AS (SELECT *, source = es AS p, CASE WHEN et IS NOT NULL THEN tool = et END AS t, NOT (f AND source <> 'documents') AS clean FROM cs)"""


def routing_report(spark, d):
    return M.routing_report(_cases(spark, d))


ROUTING = f"""WITH {CASES} SELECT category, count(*) AS n, round(avg((p AND coalesce(t, true) AND clean)::INT), 6) AS pass_rate, round(avg(p::INT), 6) AS planner_accuracy, round(avg(t::INT), 6) AS tool_accuracy, round(avg(clean::INT), 6) AS isolation, round(avg(answered::INT), 6) AS answer_rate FROM ck GROUP BY category"""


def routing_verdicts(spark, d):
    return M.routing_verdicts(_cases(spark, d)).select("o_orderkey", "passed", "failure")


FAILURE = "CASE WHEN err THEN 'error' WHEN NOT clean THEN 'forbidden_source' WHEN NOT p THEN 'wrong_source' WHEN et IS NOT NULL AND NOT t THEN 'wrong_tool' WHEN NOT answered THEN 'no_answer' ELSE '' END"
RVERDICTS = f"WITH {CASES} SELECT o_orderkey, {FAILURE} = '' AS passed, {FAILURE} AS failure FROM ck"


def failure_histogram(spark, d):
    return M.failure_histogram(M.routing_verdicts(_cases(spark, d)))


HISTOGRAM = f"WITH {CASES} SELECT failure, count(*) AS count FROM (SELECT {FAILURE} AS failure FROM ck) WHERE failure <> '' GROUP BY failure"


def samples(spark, d):
    """An order's question, answer, ordered contexts and reference, of which some lack."""
    o = table(spark, d, "orders")
    golden = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("question"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_orderstatus")).alias("reference"))
    answers = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("string").alias("answer"))
    h = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.struct("l_linenumber", "l_partkey").alias("rank"), F.col("l_partkey").cast("string").alias("text"))
    return M.samples(golden, answers, h).select("id", "question", F.array_join("contexts", ",").alias("contexts"), "reference", "lacks_reference")


SAMPLES = "SELECT o_orderkey AS id, o_orderpriority AS question, c AS contexts, CASE WHEN o_custkey % 4 > 0 THEN o_orderstatus END AS reference, o_custkey % 4 = 0 AS lacks_reference FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS c FROM lineitem GROUP BY l_orderkey) x ON l_orderkey = o_orderkey"

# --- memory and requests ------------------------------------------------------------------


def loaded_context(spark, d):
    """History, the latest three summaries and a preference of every user, made from their events."""
    e = table(spark, d, "events")
    user = F.col("user_id").alias("tenant")
    users = e.select(user).distinct()
    history = e.filter("event_type = 'click'").select(user, F.col("event_id").alias("turn"), F.col("event_id").cast("string").alias("text"))
    summaries = e.filter("event_type = 'error'").select(user, F.col("event_id").alias("created_at"), F.col("props").alias("summary"))
    prefs = e.filter("value > 150").select(user, F.col("event_id").alias("ts"), F.round("value", 2).cast("string").alias("value"))
    got = D.load_context(users, history, summaries, prefs, "none")
    return got.select("tenant", F.md5(F.array_join("history", ",")).alias("history"), F.array_join("summaries", ";").alias("summaries"), "preference")


CONTEXT = """WITH h AS (SELECT user_id, md5(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS history FROM events WHERE event_type = 'click' GROUP BY user_id),
s AS (SELECT user_id, string_agg(props, ';' ORDER BY event_id DESC) AS summaries FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'error') WHERE n <= 3 GROUP BY user_id),
p AS (SELECT user_id, max_by(round(value, 2)::VARCHAR, event_id) AS preference FROM events WHERE value > 150 GROUP BY user_id)
SELECT user_id AS tenant, history, summaries, coalesce(preference, 'none') AS preference FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN h USING (user_id) LEFT JOIN s USING (user_id) LEFT JOIN p USING (user_id)"""
AS_OF = "TIMESTAMP '2024-01-05 00:00:00'"


def cache_statistics(spark, d):
    """Hits and misses by event type, keys alive at a time, and keys left once one prefix is cleared."""
    e = table(spark, d, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), "ts", (F.col("value") < 20).alias("hit"))
    alive = D.live_keys(D.clear_prefix(e, "cl"), F.expr(AS_OF), 86400).withColumnRenamed("n", "alive")
    return D.cache_statistics(e).join(alive, "prefix", "left")


STATISTICS = f"""SELECT event_type AS prefix, count(*) AS n, count(*) FILTER (value < 20) AS hits, count(*) FILTER (value >= 20) AS misses, round(count(*) FILTER (value < 20) / count(*), 6) AS hit_rate,
CASE WHEN NOT starts_with(event_type, 'cl') THEN nullif(count(DISTINCT user_id) FILTER (ts <= {AS_OF} AND ts > {AS_OF} - INTERVAL 1 DAY), 0) END AS alive FROM events GROUP BY event_type"""


def audit_records(spark, d):
    """Events as requests, and the user's next event as their response."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    responses = e.select(F.lag("event_id").over(w).alias("request_id"), "ts", F.col("event_type").alias("status")).filter("request_id is not null")
    requests = e.select(F.col("event_id").alias("request_id"), "ts", F.col("event_type").alias("path"))
    return D.audit_records(requests, responses, ["p", "e"]).select("request_id", "path", "status", "ms")


AUDIT = "SELECT event_id AS request_id, event_type AS path, status, ms FROM (SELECT *, lead(event_type) OVER w AS status, round((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000, 3) AS ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type[1] IN ('p', 'e')"

QUERIES = {
    "q_question_routes": (question_routes, _routes()),
    "q_question_intents": (question_intents, _intents()),
    "v_verdicts": (verdicts, VERDICTS),
    "v_evidence_texts": (evidence_texts, EVIDENCE),
    "v_number_checks": (number_checks, NUMBERS),
    "v_field_checks": (field_checks, FIELD_CHECKS),
    "m_answer_scores": (answer_scores, SCORES),
    "m_cache_trials": (cache_trials, CACHE),
    "m_routing_report": (routing_report, ROUTING),
    "m_routing_verdicts": (routing_verdicts, RVERDICTS),
    "m_failure_histogram": (failure_histogram, HISTOGRAM),
    "m_samples": (samples, SAMPLES),
    "d_loaded_context": (loaded_context, CONTEXT),
    "d_cache_statistics": (cache_statistics, STATISTICS),
    "d_audit_records": (audit_records, AUDIT),
}
