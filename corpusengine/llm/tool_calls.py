"""Tool-call linking in chat tables.

Calls and results are rows of their own. They are linked by a hash join on the
identifier, calls are put in topological order of the calls that they build on, their
arguments are validated against the tool's schema, and the linked exchange is serialised as
canonical JSON: keys sorted at every depth, no blanks, numbers without leading or trailing
zeros, each value parsed and written anew.

A call builds on any number of others (``after``: one id or an array of ids). Its level is
the length of the longest chain below it. Where a call waits for one other only, its level
is a function max(a, x + w) of the other's level x; such functions compose, so chains are
contracted by pointer doubling: a chain of n calls takes log2 n joins. Calls that wait for
several are settled as those get their levels. No task ever holds a conversation.

Defined results: a call without a result has ``status`` pending; of several results to one
id the one of the earliest turn counts and ``n_results`` tells how many there were; results
of no call are not returned by ``link_calls`` but by ``orphans``; repeated calls of one id in
one conversation count once, the earliest, then smallest arguments; an ``after`` that names
no call counts as none; a call in a cycle, or that waits for one, has null level and status
cyclic; calls with null ids link to nothing and are returned by ``unidentified``; null
arguments are invalid; an argument that is no JSON value is invalid and written as null;
extra columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from corpusengine.session import materialize

#: Type of an argument: the name of a scalar type (string, integer, number, boolean), a list
#: with the type of an array's items, or the members of an object.
Type = str | list | dict
#: Schema of a tool: argument -> (type, required).
Schemas = dict[str, dict[str, tuple[Type, bool]]]
SCALARS = {"string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DECIMAL|DOUBLE)", "boolean": "^BOOLEAN$"}


def json_string(text: Column) -> Column:
    """``text`` as a JSON string, null for null."""
    whole = F.to_json(F.struct(text.alias("t")))
    return F.when(text.isNotNull(), F.substr(whole, F.lit(6), F.length(whole) - 6))


def json_object(members: dict[str, Column]) -> Column:
    """Canonical object of members that are JSON already; null members are null."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in sorted(members.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_value(text: Column) -> Column:
    """``text`` as a variant, null unless it is exactly one JSON value.

    A parser stops after the first value; inside an array and inside an object, what stands
    behind the value can't be read as the end of both.
    """
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(inside.isNotNull() & (F.size(alone) == 1), alone[0])


def canonical(text: Column) -> Column:
    """The JSON value ``text`` with keys sorted at every depth and no blanks; ``null`` if it is none."""
    return F.coalesce(F.to_json(json_value(text)), F.lit("null"))


def type_errors(value: Column, kind: Type, name: str) -> Column:
    """What is wrong with a variant under a type: array of texts."""
    shape = F.upper(F.schema_of_variant(value))
    no = lambda what: F.array(F.lit(f"{name} is no {what}"))
    none = F.array().cast("array<string>")
    if isinstance(kind, str):
        return F.when(~shape.rlike(SCALARS[kind]), no(kind)).otherwise(none)
    if isinstance(kind, list):
        items = F.try_variant_get(value, "$", "array<variant>")
        return F.when(~shape.startswith("ARRAY"), no("array")).otherwise(F.flatten(F.transform(items, lambda x: type_errors(x, kind[0], f"{name}[]"))))
    member = lambda k: F.try_variant_get(value, f"$['{k}']", "variant")
    checks = [F.when(member(k).isNull(), F.array(F.lit(f"missing {name}.{k}")) if required else none).otherwise(type_errors(member(k), of, f"{name}.{k}")) for k, (of, required) in kind.items()]
    keys = F.array_except(F.json_object_keys(F.to_json(value)), F.array(*map(F.lit, kind)))
    extra = F.transform(keys, lambda k: F.concat(F.lit(f"unexpected {name}."), k))
    return F.when(~shape.startswith("OBJECT"), no("object")).otherwise(F.concat(*checks, extra))


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with ``arguments`` (map of argument to JSON) under the schema of tool ``name``: sorted, null-free array."""
    found = F.when(name.isNull() | ~name.isin(*schemas), F.array(F.lit("unknown tool")))
    words = {str: lambda k: k, list: lambda k: "array", dict: lambda k: "object"}
    for tool, schema in schemas.items():
        checks = []
        for a, (kind, required) in schema.items():
            value = json_value(arguments[a])
            missing = F.array(F.lit(f"missing {a}")) if required else F.array().cast("array<string>")
            checks.append(F.when(~F.map_contains_key(arguments, F.lit(a)) | arguments[a].isNull(), missing).when(value.isNull(), F.array(F.lit(f"{a} is no {words[type(kind)](kind)}"))).otherwise(type_errors(value, kind, a)))
        extra = F.transform(F.array_except(F.map_keys(arguments), F.array(*map(F.lit, schema))), lambda k: F.concat(F.lit("unexpected "), k))
        found = found.when(name == tool, F.sort_array(F.concat(*checks, extra)))
    return F.when(arguments.isNull(), F.array(F.lit("no arguments"))).otherwise(found)


def canonical_map(arguments: Column) -> Column:
    """A map of argument to JSON as a canonical object."""
    members = F.transform(F.array_sort(F.map_entries(arguments)), lambda e: F.concat(json_string(e["key"]), F.lit(":"), canonical(e["value"])))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def before(calls: DataFrame) -> Column:
    """``after`` of ``calls`` as an array."""
    if isinstance(calls.schema["after"].dataType, ArrayType):
        return F.array_distinct(F.array_compact("after"))
    return F.array_compact(F.array("after"))


def contract(single: DataFrame, max_doublings: int) -> DataFrame:
    """``single`` (call, down, w, base: level = max(base, level of down + w)) with ``down`` moved to the end of its chain."""
    total = single.count()
    for k in range(max_doublings):
        further = single.select(F.col("call").alias("down"), F.col("down").alias("down2"), F.col("w").alias("w2"), F.col("base").alias("base2"))
        met = single.join(further, "down", "left")
        moved = met.select("call", F.coalesce("down2", "down").alias("down"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.greatest("base", F.coalesce(F.col("base2") + F.col("w"), "base")).alias("base"), F.col("down2").isNotNull().alias("moved"))
        moved = materialize(moved)
        single = moved.drop("moved")
        if (1 << k) > total or moved.filter("moved").isEmpty():
            break
    return single


def levels(calls: DataFrame, max_doublings: int = 40) -> DataFrame:
    """``calls`` (conv_id, call_id, after) with ``level``: calls below on the longest chain; null in or above a cycle."""
    key = F.struct("conv_id", "call_id")
    nodes = materialize(calls.select(key.alias("call"), before(calls).alias("after")))
    named = nodes.select("call", F.explode("after").alias("call_id")).select("call", F.struct("call.conv_id", "call_id").alias("down"))
    edges = materialize(named.join(nodes.select(F.col("call").alias("down")), "down", "left_semi").select("call", "down", F.lit(1).cast("long").alias("w")))
    # a waiting call: the level that settled calls below give it, and its edges to calls that wait themselves
    waiting = nodes.select("call", F.lit(0).cast("long").alias("base"))
    settled = None
    while True:
        ready = materialize(waiting.join(edges, "call", "left_anti").select("call", F.col("base").alias("level")))
        settled = ready if settled is None else settled.unionByName(ready)
        known = ready.withColumnRenamed("call", "down")
        rest = materialize(edges.join(known, "down", "left"))
        if rest.isEmpty() or ready.isEmpty():
            break
        reached = rest.filter("level is not null").groupBy("call").agg(F.max(F.col("level") + F.col("w")).alias("reached"))
        waiting = waiting.join(ready, "call", "left_anti").join(reached, "call", "left").select("call", F.greatest("base", F.coalesce("reached", "base")).alias("base"))
        open_ = rest.filter("level is null").groupBy("call", "down").agg(F.max("w").alias("w"))
        counted = materialize(open_.groupBy("call").agg(F.count("*").alias("n"), F.any_value("down").alias("down"), F.any_value("w").alias("w")).join(waiting, "call"))
        single = contract(counted.filter("n = 1").select("call", "down", "w", "base"), max_doublings)
        several = open_.join(counted.filter("n > 1").select("call"), "call", "left_semi")
        # what hangs on a contracted chain hangs on its end
        ends = single.select(F.col("call").alias("down"), F.col("down").alias("down2"), F.col("w").alias("w2"), F.col("base").alias("base2"))
        moved = materialize(several.join(ends, "down", "left"))
        lifted = moved.groupBy("call").agg(F.max(F.col("base2") + F.col("w")).alias("lifted"))
        edges = materialize(moved.select("call", F.coalesce("down2", "down").alias("down"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w")).groupBy("call", "down").agg(F.max("w").alias("w")).unionByName(single.select("call", "down", "w")))
        base = waiting.join(single.select("call", F.col("base").alias("b1")), "call", "left").join(lifted, "call", "left")
        waiting = materialize(base.select("call", F.greatest("base", F.coalesce("b1", "base"), F.coalesce("lifted", "base")).alias("base")))
    done = settled.select("call.conv_id", "call.call_id", "level")
    return calls.join(done, ["conv_id", "call_id"], "left")


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call: conv_id, call_id, turn, level, after, name, valid, errors, result_turn, n_results, status, json.

    ``calls``: conv_id, turn, call_id, name, arguments (map of argument to JSON), after.
    ``results``: conv_id, turn, call_id, content. ``level`` then ``turn`` is a topological order.
    """
    calls = calls.filter("conv_id is not null and call_id is not null")
    least = F.min_by(F.struct("turn", "name", "arguments", "after"), F.struct(F.col("turn").isNull(), "turn", "name", F.to_json("arguments")))
    one = calls.groupBy("conv_id", "call_id").agg(least.alias("c")).select("conv_id", "call_id", "c.*")
    ordered = materialize(levels(materialize(one)))
    answers = results.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min_by(F.struct(F.col("turn").alias("result_turn"), "content"), F.struct(F.col("turn").isNull(), "turn", "content")).alias("r"), F.count("*").alias("n_results"))
    met = ordered.join(answers, ["conv_id", "call_id"], "left")
    errors = argument_errors(F.col("name"), F.col("arguments"), schemas)
    met = met.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
    status = F.when(F.col("level").isNull(), "cyclic").when(~F.col("valid"), "invalid").when(F.col("n_results").isNull(), "pending").otherwise("linked")
    after = F.to_json("after") if isinstance(calls.schema["after"].dataType, ArrayType) else json_string(F.col("after"))
    json = json_object({"after": after, "arguments": canonical_map(F.col("arguments")), "id": json_string(F.col("call_id")), "name": json_string(F.col("name")), "result": json_string(F.col("r.content"))})
    return met.select("conv_id", "call_id", "turn", "level", "after", "name", "valid", F.array_join("errors", "; ").alias("errors"), F.col("r.result_turn").alias("result_turn"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), status.alias("status"), json.alias("json"))


def unidentified(calls: DataFrame) -> DataFrame:
    """Calls without a conversation or an id of their own."""
    return calls.filter("conv_id is null or call_id is null")


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that answer no call."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")


#: The tool that turns of a plain conversation are read as calls of.
REPLY = {"reply": {"length": ("integer", True), "text": ("string", True), "turn": ("integer", True)}}


def calls_of_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table conv_id, turn, role, text.

    A user's turn t is a call ``c<t>`` of ``reply`` that builds on the user's last turn but
    one, ``c<t-2>``; the assistant's turn t answers ``c<t-1>``. A blank text is sent as null.
    Other roles (system) neither call nor answer.
    """
    at = lambda k: F.concat(F.lit("c"), (F.col("turn") - k).cast("string"))
    text = F.when(F.trim("text") != "", json_string(F.col("text")))
    arguments = F.create_map(F.lit("turn"), F.col("turn").cast("string"), F.lit("text"), text, F.lit("length"), F.length("text").cast("string"))
    calls = conversations.filter("role = 'user'").select("conv_id", "turn", at(0).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), at(2).alias("after"))
    results = conversations.filter("role = 'assistant'").select("conv_id", "turn", at(1).alias("call_id"), F.coalesce("text", F.lit("")).alias("content"))
    return calls, results
