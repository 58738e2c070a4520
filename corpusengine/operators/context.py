"""Context assembly: evidence, budget, history, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusengine.functions.text import estimate_tokens, first_true


def pick_evidence(hits: DataFrame, n: int = 4) -> DataFrame:
    """Protected chunks first, in their order, then the best scored; ``n`` a query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("protected"), F.when(F.col("protected"), F.col("rank")), F.desc("score"), "rank")
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def pack_context(evidence: DataFrame, window: int, scaffold: int = 0, tools: DataFrame | None = None) -> DataFrame:
    """Blocks of a query, in ``place`` order, that fit the budget: query_id, context, included, dropped, used.

    A block that doesn't fit is skipped and a later one may still enter; protected ones always do.
    ``tools`` (query_id, place, line) follow the sources, in their order, also where no block fits.
    """
    budget = F.lit(max(window - 500 - scaffold - 50, 0)).cast("long")
    rows = evidence.select("query_id", F.struct("place", "text", "protected", estimate_tokens(F.col("text")).cast("long").alias("tokens")).alias("b"))
    lists = rows.groupBy("query_id").agg(F.sort_array(F.collect_list("b")).alias("blocks"))
    fits = lambda a, b: b["protected"] | (a["used"] + b["tokens"] <= budget)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("places"))
    step = lambda a, b: F.struct(F.when(fits(a, b), a["used"] + b["tokens"]).otherwise(a["used"]).alias("used"), F.when(fits(a, b), F.array_append(a["places"], b["place"])).otherwise(a["places"]).alias("places"))
    done = lists.withColumn("walk", F.aggregate("blocks", start, step))
    chosen = F.filter("blocks", lambda b: F.array_contains(F.col("walk.places"), b["place"]))
    text = F.array_join(F.transform(chosen, lambda b: F.concat(F.lit("[Source "), b["place"].cast("string"), F.lit("]\n"), b["text"])), "\n\n")
    blocks = F.when(F.size(chosen) > 0, text)
    if tools is not None:
        lines = tools.filter("line is not null").groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n\n").alias("tool_text"))
        done = done.join(lines, "query_id", "full")
        blocks = F.when(F.col("tool_text").isNotNull() | (F.size(chosen) > 0), F.concat_ws("\n\n", blocks, F.col("tool_text")))
    places = F.coalesce(F.col("walk.places"), F.array().cast("array<int>"))
    dropped = F.array_except(F.coalesce(F.transform("blocks", lambda b: b["place"]), F.array().cast("array<int>")), places)
    return done.select("query_id", F.coalesce(blocks, F.lit("(no context available)")).alias("context"), places.alias("included"), dropped.alias("dropped"), F.coalesce(F.col("walk.used"), F.lit(0).cast("long")).alias("used"))


def source_cards(evidence: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """Cards of a query's evidence in ``place`` order, then those of ``web`` (query_id, place, title, snippet)."""
    none = lambda kind: F.lit(None).cast(kind)
    card = F.struct("doc_id", "chunk_index", F.coalesce("filename", F.concat(F.lit("Source "), F.col("place").cast("string"))).alias("filename"), F.substring("text", 1, 200).alias("text"), "score")
    rows = evidence.select("query_id", F.lit(0).alias("kind"), "place", card.alias("card"))
    if web is not None:
        types = {f.name: f.dataType for f in evidence.schema}
        page = F.struct(none(types["doc_id"]).alias("doc_id"), none(types["chunk_index"]).alias("chunk_index"), F.col("title").alias("filename"), F.substring("snippet", 1, 200).alias("text"), none(types["score"]).alias("score"))
        rows = rows.unionByName(web.select("query_id", F.lit(1).alias("kind"), "place", page.alias("card")))
    return rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("kind", "place", "card"))), lambda x: x["card"]).alias("sources"))


def recent_history(messages: DataFrame, budget: int = 800) -> DataFrame:
    """The newest messages of each conversation within ``budget`` tokens, one at least."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    df = messages.withColumn("tokens", estimate_tokens(F.col("text"))).withColumn("back", F.row_number().over(w))
    df = df.withColumn("sum", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.filter((F.col("back") == 1) | (F.col("sum") <= budget)).drop("sum")


def history_text(messages: DataFrame, budget: int = 800) -> DataFrame:
    """User turns of the recent history as one text per conversation."""
    kept = recent_history(messages, budget).filter("role = 'user'")
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(F.lit("User: "), x["text"])), "\n").alias("history"))


def sufficiency(has_docs: Column, web_error: Column, documents_routed: Column) -> Column:
    """What evidence an answer stands on."""
    return first_true([(has_docs & ~web_error, "enough"), (has_docs & web_error, "documents only, web failed"), (documents_routed & web_error, "nothing found, web failed"), (documents_routed, "nothing found in documents"), (web_error, "web failed")], "no evidence needed")


def confidence(base: Column, has_docs: Column, mean_score: Column, tool_only: Column, grounded: Column) -> Column:
    value = F.when(has_docs, F.least(F.lit(1.0), 0.5 * base + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean_score)))).when(tool_only, F.greatest(base, F.lit(0.85))).otherwise(base)
    return F.when(grounded, value).otherwise(F.least(value, F.lit(0.3)))


def final_confidence(value: Column, base: Column, usable: Column, factor: float = 0.3) -> Column:
    """``value``, or where no document and no tool result is usable, ``factor`` of the plan's confidence."""
    return F.when(F.coalesce(usable, F.lit(False)), value).otherwise(base * factor)


def tool_line(kind: Column, name: Column, n: Column, value: Column, error: Column) -> Column:
    """One line per tool result, null when it failed or is empty."""
    return F.when(error.isNotNull(), None).when(kind == "database", F.format_string("[Database Result] %s: %d record(s).", name, n)).when(kind == "calculator", F.concat(F.lit("[Calculator Result] "), value)).when(value != "", F.concat(F.lit("["), F.initcap(kind), F.lit(" Result] "), value))


def metadata_text(title: Column, authors: Column, affiliations: Column) -> Column:
    part = lambda label, v: F.when(v != "", F.concat(F.lit(label), v))
    return F.concat_ws("\n", part("Title: ", title), part("Authors: ", F.array_join(authors, ", ")), part("Affiliations: ", F.array_join(affiliations, ", ")))
