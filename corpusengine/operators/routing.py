"""Routing of question tables by ordered rules kept as data, compiled to one ``when`` chain."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusengine.functions.text import first_true
from corpusengine.operators.retrieval import match_titles


class Rule(NamedTuple):
    name: str
    source: str
    confidence: float
    all_of: tuple[str, ...]
    none_of: tuple[str, ...] = ()


OWN = r"(?i)\b(my|our|uploaded|the)\s+(uploaded\s+)?(document|paper|pdf|file|report|resume|thesis|upload)s?\b"
WEATHER = r"(?i)\b(weather|temperature|forecast|rain|snow|humidity|wind)\b"
PLACE_OR_TIME = r"(?i)\b(in|at|for|near)\s+[a-z][a-z -]{1,40}|\b(today|tomorrow|tonight|now|currently|this week)\b"
FRESH = r"(?i)\b(latest|current|recent|newest|today|this week|this month|recently|lately)\b"
NEWS = r"(?i)\b(news|developments?|events?|updates?|papers?|research|models?|tools?|trends?|released|launched|announced|changed)\b"
CONCEPT = r"(?i)^\s*(what (is|are)|how (does|do)|explain|define|why (is|are|do|does))\b"
#: Our own stored data, and names that look technical (hyphen or digit inside, capitals inside).
STORE = r"(?i)\b(database|our app|this app|stored|collection)\b"
ENTITY = r"\b([A-Za-z]+-[A-Z][A-Za-z]*|[A-Za-z]+\d+\w*|[A-Z][a-z]+[A-Z]\w*|[A-Z]{2,6}-?\d+)\b"
#: The default table, in order; the first rule that fits decides. Any other table of rules will do.
RULES = (
    Rule("metadata", "metadata", 0.95, (r"(?i)\b(title|authors?|affiliations?)\b", OWN)),
    Rule("multi_source", "documents,web", 0.95, (r"(?i)\b(compare|verify|cross-?check|cross-?reference)\b", OWN, r"(?i)\b(latest|current|recent|external|public|online)\b")),
    Rule("document", "documents", 0.95, (OWN,)),
    Rule("database", "database", 0.95, (r"(?i)\b(how many|list|show|count|latest)\b", r"(?i)\b(users?|sessions?|records?|uploads?)\b")),
    Rule("calculator", "calculator", 0.95, (r"(?i)\d+\s*[-+*/÷×]\s*\d+|\b(percent|percentage)\s+of\b|\b(square|cube)\s+root\b|\b(add|sum|multiply|divide|subtract)\b.*\d.*\d",)),
    Rule("message_search", "slack_search", 0.95, (r"(?i)\bslack\b", r"(?i)\b(find|search|said|mention(ed)?|discuss(ed)?|messages?|threads?)\b")),
    Rule("action", "tool", 0.95, (r"(?i)\b(send|post|email|notify|schedule|remind)\b", r"(?i)\b(to|on|via|in|me)\b")),
    Rule("weather", "weather", 0.95, (WEATHER, PLACE_OR_TIME)),
    Rule("web", "web", 0.9, (FRESH, NEWS)),
    Rule("live", "web", 0.85, (r"(?i)\b(price|score|stock|exchange rate|schedule)\b", r"(?i)\b(now|today|current|live)\b")),
    Rule("explanation", "direct", 0.9, (r"(?i)\b(explain|define|definition of|history of|meaning of|difference between|how (does|do) .+ works?)\b",), (OWN,)),
    Rule("concept", "direct", 0.9, (r"(?i)^\s*what('s| is| are)\b",), (OWN, STORE, ENTITY, r"\d")),
    Rule("mechanism", "direct", 0.9, (r"(?i)^\s*how (does|do)\b",), (OWN, ENTITY)),
)
#: Asked when no rule of the table fits, in order; the rules need a word only. ``active`` stands for a tenant with documents.
FALLBACK = (
    Rule("said_explanation", "direct", 0.6, (r"(?i)\b(explain|define|history|meaning)\b",)),
    Rule("said_weather", "weather", 0.6, (WEATHER,), (CONCEPT,)),
    Rule("said_action", "tool", 0.6, (r"(?i)\b(send|post|notify|remind|schedule)\b",)),
    Rule("said_count", "database", 0.6, (r"(?i)\b(how many|number of|count of|total)\b", r"(?i)\b(users?|accounts?|documents?|pdfs?|files?|uploads?|records?|sessions?|chats?)\b")),
    Rule("said_document", "documents", 0.6, (r"(?i)\b(papers?|pdfs?|files?|documents?|uploaded|attached|according to|figure|section)\b",)),
    Rule("said_arithmetic", "calculator", 0.6, (r"(?i)\b(add|sum|plus|minus|subtract|multiply|times|divide|average)\b", r"\d\D+\d")),
    Rule("said_database", "database", 0.6, (r"(?i)\b(database|users|records|signed up|collection)\b",)),
    Rule("said_web", "web", 0.6, (r"(?i)\b(latest|current|today|breaking|recent|search for)\b",)),
)
AFTER_ACTIVE = (Rule("said_concept", "direct", 0.6, (r"(?i)\b(what (is|are)|what's|who (is|was)|how (does|do)|why (does|do)|capital of|difference between)\b",)),)


def fits(rule: Rule, question: Column) -> Column:
    out = F.lit(True)
    for p in rule.all_of:
        out = out & question.rlike(p)
    for p in rule.none_of:
        out = out & ~question.rlike(p)
    return F.coalesce(out, F.lit(False))


def route(questions: DataFrame, rules=RULES, question: str = "question", fallback=FALLBACK, after_active=AFTER_ACTIVE, active: str | None = None, title: str | None = None, titles_after: str = "document") -> DataFrame:
    """``questions`` with rule, source and confidence of the first rule that fits.

    Then the fallback's; then documents, where the column ``active`` says that the tenant has
    some; then ``after_active``; else documents by default. Where the column ``title`` names
    a document of the tenant (``with_titles``), documents are asked right after the rule
    ``titles_after``, at the front in a table without that rule.
    """
    q = F.col(question)
    of = lambda name, source, c: F.struct(F.lit(name).alias("rule"), F.lit(source).alias("source"), F.lit(c).alias("confidence"))
    row = lambda r: (fits(r, q), of(r.name, r.source, r.confidence))
    has = [] if active is None else [(F.coalesce(F.col(active), F.lit(False)), of("active_documents", "documents", 0.5))]
    table = list(map(row, rules))
    if title is not None:
        at = next((k + 1 for k, r in enumerate(rules) if r.name == titles_after), 0)
        table.insert(at, (F.col(title).isNotNull(), of("title_match", "documents", 0.95)))
    picked = first_true([*table, *map(row, fallback), *has, *map(row, after_active)], None)
    return questions.withColumn("_r", F.coalesce(picked, of("default", "documents", 0.5))).select("*", "_r.*").drop("_r")


def with_titles(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """``questions`` (query_id, tenant, question) with ``title``: the tenant's first label that the question names, else null.

    ``labels`` (tenant, label, ord) are those of ``recent_labels``, at most 20 a tenant; every
    row of a repeated ``query_id`` gets the id's first label.
    """
    return questions.drop("title").join(match_titles(questions, labels).withColumnRenamed("label", "title"), "query_id", "left")


def has_arithmetic(question: Column) -> Column:
    """An operation word and two numbers."""
    return question.rlike(r"(?i)\b(add|sum|plus|minus|subtract|multiply|times|divide|average|difference|total)\b") & (F.size(F.regexp_extract_all(question, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))) >= 2)


def concrete_tool(sources: Column, question: Column) -> Column:
    """The tool of a plan with one source, null otherwise."""
    only = F.when(F.size(sources) == 1, sources[0])
    post = question.rlike(r"(?i)\b(post|send|share|notify)\b")
    return F.when(only == "slack", F.when(post, "slack_post").otherwise("slack_search")).when(only.isin("calculator", "weather", "web", "database", "email"), only)


def placeholder(sources: Column, implemented: list[str], confidence: Column) -> tuple[Column, Column]:
    missing = F.array_except(sources, F.array(*map(F.lit, implemented)))
    return F.when(F.size(missing) > 0, F.concat(F.lit("not available: "), F.array_join(missing, ", "))), F.when(F.size(missing) > 0, F.least(confidence, F.lit(0.6))).otherwise(confidence)


#: Entity of a structured question -> its words.
ENTITIES = {"documents": "documents?|files?|uploads?|papers?", "sessions": "sessions?|chats?|conversations?", "memory": "memor(?:y|ies)|preferences?", "users": "users?|accounts?"}


def structured_intent(question: Column) -> tuple[Column, Column, Column]:
    """Entity named first, kind (latest, list, count) and whether only own rows are meant."""
    places = F.array(*[F.struct(F.regexp_instr(question, F.lit(f"(?i)\\b(?:{p})\\b")).alias("at"), F.lit(e).alias("entity")) for e, p in ENTITIES.items()])
    found = F.array_min(F.filter(places, lambda x: x["at"] > 0))
    kind = first_true([(question.rlike(r"(?i)\b(how many|count|number of)\b"), "count"), (question.rlike(r"(?i)\b(latest|last|newest|most recent)\b"), "latest")], "list")
    return found["entity"], kind, F.coalesce(question.rlike(r"(?i)\b(my|mine|i have|i've)\b"), F.lit(False))


def next_step(metadata_answer: Column, sources: Column) -> Column:
    has = lambda s: F.array_contains(sources, s)
    return first_true([(metadata_answer.isNotNull(), "end"), (has("documents"), "retriever"), (F.size(sources) == 0, "answer"), (has("direct"), "answer")], "tools")
