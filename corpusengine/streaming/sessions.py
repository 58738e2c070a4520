"""Conversation memory, result cache and rate limits: batch forms and stateful streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusengine.functions.text import estimate_tokens
from corpusengine.operators.hooks import call_rows
from corpusengine.operators.ordered import walk_groups

MAX_MESSAGES, MAX_TOKENS = 10, 1200
CACHE_SECONDS = 3600
SESSION = "24 hours"
SESSION_MICROS = 24 * 3600 * 1_000_000


def bounded_memory(messages: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """``messages`` with ``kept``: the newest within both limits, one at least. Equal to evicting the oldest step by step."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    df = messages.withColumn("tokens", estimate_tokens(F.col(text))).withColumn("back", F.row_number().over(w))
    df = df.withColumn("sum", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("kept", (F.col("back") == 1) | ((F.col("back") <= MAX_MESSAGES) & (F.col("sum") <= MAX_TOKENS))).drop("sum")


def evicted_summary(messages: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """What fell out of each memory, as an unsummarised excerpt."""
    gone = bounded_memory(messages, key, order, text).filter("not kept")
    line = F.concat_ws(": ", "role", F.substring(text, 1, 100))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return gone.groupBy(key).agg(F.concat(F.lit("(unsummarized excerpt) "), F.array_join(parts, "; ")).alias("summary"), F.count("*").alias("n_evicted"))


def evictions(messages: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Messages that fall out of memory, with ``evicted_at``: the ``order`` of the message whose coming pushes them out.

    A message goes with the first later one that makes more than MAX_MESSAGES from it on, or
    more than MAX_TOKENS; as that one stays, only the next MAX_MESSAGES rows can be it. So the
    step comes from running sums in one window of bounded reach. Rows of equal ``order`` come
    by role and text; rows without a key are one conversation.
    """
    w = Window.partitionBy(key).orderBy(order, "role", text)
    df = messages.withColumn("_sum", F.sum(estimate_tokens(F.col(text))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_before", F.col("_sum") - estimate_tokens(F.col(text)))
    df = df.withColumn("_next", F.collect_list(F.struct(F.col(order).alias("o"), F.col("_sum").alias("s"))).over(w.rowsBetween(1, MAX_MESSAGES)))
    over = F.filter("_next", lambda x: x["s"] - F.col("_before") > MAX_TOKENS)
    step = F.coalesce(F.get(over, F.lit(0)), F.get("_next", F.lit(MAX_MESSAGES - 1)))
    return df.withColumn("_step", step).filter("_step is not null").withColumn("evicted_at", F.col("_step")["o"]).drop("_sum", "_before", "_next", "_step")


def eviction_log(messages: DataFrame, summarize: Callable[[list[list[str]]], list[str]] | None = None, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """One row per step that evicts: key, ``evicted_at``, ``summary``, ``n_evicted`` and, with ``summarize``, ``error``.

    The fallback summary is an excerpt of what goes, in its order. ``summarize`` is asked for
    many steps in one call, each a list of "role: text" lines; a step that it fails on keeps
    the excerpt, and the failure in ``error``. A step evicts MAX_MESSAGES messages at most.
    """
    line = lambda x, most: F.concat_ws(": ", x["r"], x["t"] if most is None else F.substring(x["t"], 1, most))
    gone = evictions(messages, key, order, text)
    # nulls in a struct keep their rows; collect_list drops only null elements
    held = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("role").alias("r"), F.col(text).alias("t"))))
    steps = gone.groupBy(key, "evicted_at").agg(held.alias("_held"))
    excerpt = F.concat(F.lit("(unsummarized excerpt) "), F.array_join(F.transform("_held", lambda x: line(x, 100)), "; "))
    steps = steps.withColumns({"summary": excerpt, "n_evicted": F.size("_held").cast("long")})
    if summarize is None:
        return steps.drop("_held")
    asked = call_rows(steps.withColumn("_held", F.transform("_held", lambda x: line(x, None))), summarize, ["_held"], "_said")
    return asked.withColumn("summary", F.coalesce("_said", "summary")).drop("_held", "_said")


def sessions(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Sessions that end a day after their last event; works on streams with a watermark."""
    return events.groupBy(key, F.session_window(ts, SESSION).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("started"), F.col("s.end").alias("expires"), "n")


def load_context(users: DataFrame, history: DataFrame, summaries: DataFrame, preferences: DataFrame, default: str) -> DataFrame:
    """Per user (tenant): ordered history, the latest three summaries, preference or default."""
    h = history.groupBy("tenant").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("history"))
    w = Window.partitionBy("tenant").orderBy(F.desc("created_at"))
    s = summaries.withColumn("n", F.row_number().over(w)).filter("n <= 3").groupBy("tenant").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "summary"))), lambda x: x["summary"]).alias("summaries"))
    p = preferences.groupBy("tenant").agg(F.max_by("value", "ts").alias("preference"))
    return users.join(h, "tenant", "left").join(s, "tenant", "left").join(p, "tenant", "left").withColumn("preference", F.coalesce("preference", F.lit(default)))


def _decided(requests: DataFrame, flag: str) -> str:
    kind = lambda c: requests.schema[c].dataType.simpleString()
    return f"key {kind('key')}, request_id {kind('request_id')}, {flag} boolean"


def cache_hits(requests: DataFrame, seconds: float = CACHE_SECONDS) -> DataFrame:
    """``requests`` (key, request_id, ts) with ``hit``. A miss stores its answer for ``seconds`` from then; hits don't extend it. A request without a time is a miss that stores nothing."""
    life = pd.Timedelta(seconds=seconds)

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        until = None
        for key, request, t in rows:
            hit = None not in (until, t) and t < until
            until = until if hit or t is None else t + life
            yield key, request, hit

    return walk_groups(requests.select("key", "request_id", "ts"), ["key"], ["ts", "request_id"], walk, _decided(requests, "hit"))


def live_keys(stores: DataFrame, as_of: Column, seconds: int = CACHE_SECONDS) -> DataFrame:
    """Number of cache keys alive at ``as_of``, by prefix."""
    alive = stores.filter((F.col("ts") <= as_of) & (F.col("ts") > as_of - F.make_dt_interval(secs=F.lit(seconds))))
    return alive.groupBy(F.split("key", ":")[0].alias("prefix")).agg(F.count_distinct("key").alias("n"))


def cache_statistics(requests: DataFrame) -> DataFrame:
    """Per prefix of ``requests`` (key, hit): requests, hits, misses, hit rate."""
    per = requests.groupBy(F.split("key", ":")[0].alias("prefix")).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    return per.withColumns({"misses": F.col("n") - F.col("hits"), "hit_rate": F.round(F.col("hits") / F.col("n"), 6)})


def clear_prefix(stores: DataFrame, prefix: str) -> DataFrame:
    """``stores`` without the keys that start with ``prefix``."""
    return stores.filter(~F.coalesce(F.col("key").startswith(prefix), F.lit(False)))


def rate_limit(requests: DataFrame, most: int, seconds: float) -> DataFrame:
    """``requests`` (key, request_id, ts) with ``allowed``: fewer than ``most`` accepted in the window before; rejected ones don't count. A request without a time is accepted and doesn't count."""
    window = pd.Timedelta(seconds=seconds)

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        taken: list = []
        for key, request, t in rows:
            taken = taken if t is None else [x for x in taken if x > t - window]
            allowed = t is None or len(taken) < most
            if allowed and t is not None:
                taken.append(t)
            yield key, request, allowed

    return walk_groups(requests.select("key", "request_id", "ts"), ["key"], ["ts", "request_id"], walk, _decided(requests, "allowed"))


def audited(requests: DataFrame, prefixes: list[str]) -> DataFrame:
    """Requests on audited paths; the same on a stream."""
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.col("path").startswith(p)
    return requests.filter(keep)


def audit_records(requests: DataFrame, responses: DataFrame, prefixes: list[str]) -> DataFrame:
    """Audited requests (request_id, ts, path, ...) with status and milliseconds of their response; null where none came."""
    r = responses.select("request_id", F.col("ts").alias("_done"), "status")
    took = F.round((F.unix_micros(F.col("_done").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000, 3)
    return audited(requests, prefixes).join(r, "request_id", "left").withColumn("ms", took).drop("_done")


class RateLimiter(StatefulProcessor):
    """Streaming rate limit per key over (key, request_id, ts): state is the accepted times in the window."""

    def __init__(self, most: int, seconds: float, ttl_ms: int | None = None):
        self.most, self.seconds, self.ttl_ms = most, seconds, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getListState("taken", "t double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        taken = [t[0] for t in self.taken.get()]
        df = pd.concat(list(rows)).sort_values(["ts", "request_id"])
        out = []
        for ts in df["ts"]:
            t = ts.timestamp()
            taken = [x for x in taken if x > t - self.seconds]
            out.append(len(taken) < self.most)
            if out[-1]:
                taken.append(t)
        self.taken.put([(t,) for t in taken])
        yield pd.DataFrame({"key": key[0], "request_id": df["request_id"], "allowed": out})

    def close(self) -> None:
        pass


class QueryCache(StatefulProcessor):
    """Streaming result cache per key over (key, request_id, ts): state is the time the stored answer lives until."""

    def __init__(self, seconds: float = CACHE_SECONDS, ttl_ms: int | None = None):
        self.seconds, self.ttl_ms = seconds, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "t double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else float("-inf")
        df = pd.concat(list(rows)).sort_values(["ts", "request_id"])
        out = []
        for ts in df["ts"]:
            t = ts.timestamp()
            out.append(t < until)
            if not out[-1]:
                until = t + self.seconds
        self.until.update((until,))
        yield pd.DataFrame({"key": key[0], "request_id": df["request_id"], "hit": out})

    def close(self) -> None:
        pass


class SessionMemory(StatefulProcessor):
    """Streaming bounded memory per conversation over (conv_id, turn, role, text): emits what each batch evicts.

    With ``expires``, rows have ``us`` too, their event time in microseconds, and the stream
    runs in event time: a conversation's memory ends ``expires`` microseconds after its last
    message, by a timer when the watermark passes, or when a message comes that much later.
    What ends so is not an eviction.
    """

    def __init__(self, ttl_ms: int | None = None, expires: int | None = None):
        self.ttl_ms, self.expires = ttl_ms, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "turn long, role string, text string", ttlDurationMs=self.ttl_ms)
        if self.expires:
            self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, gone = [tuple(r) for r in self.held.get()], []
        last = self.last.get()[0] if self.expires and self.last.exists() else None
        size = lambda m: max(1, len(m[2]) // 4) if m[2] else 0
        for m in pd.concat(list(rows)).sort_values("turn").itertuples():
            if self.expires:
                held = [] if last is not None and m.us > last + self.expires else held
                last = m.us if last is None else max(last, m.us)
            held.append((int(m.turn), m.role, m.text))
            while len(held) > 1 and (len(held) > MAX_MESSAGES or sum(map(size, held)) > MAX_TOKENS):
                gone.append(held.pop(0))
        self.held.put(held)
        if self.expires:
            self.last.update((int(last),))
            set_timer(self.handle, last + self.expires)
        if gone:
            yield pd.DataFrame({"conv_id": key[0], "turn": pd.Series([g[0] for g in gone], dtype="int64"), "role": pd.Series([g[1] for g in gone], dtype=object)})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


class SessionClock(StatefulProcessor):
    """Sessions in event time per key over (key, ts, us): each is emitted once, when the watermark passes its end, and its state goes.

    Rows may come in any order within the watermark's delay: several sessions of a key can be
    open and grow together. State is three numbers an open session, whatever its events.
    """

    def __init__(self, gap: int = SESSION_MICROS):
        self.gap, self.ttl_ms = gap, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "started long, last long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        spans = [tuple(r) for r in self.open.get()]
        for df in rows:
            counts = df["us"].value_counts()
            spans = self.joined(spans + [(int(t), int(t), int(n)) for t, n in counts.items()])
        self.open.put(spans)
        set_timer(self.handle, min(last for _, last, _ in spans) + self.gap)
        return iter([])

    def joined(self, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for started, last, n in sorted(spans):
            if out and started <= out[-1][1] + self.gap:
                out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
            else:
                out.append((started, last, n))
        return out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        spans = [tuple(r) for r in self.open.get()]
        over, left = [s for s in spans if s[1] + self.gap <= now], [s for s in spans if s[1] + self.gap > now]
        if left:
            self.open.put(left)
            set_timer(self.handle, min(last for _, last, _ in left) + self.gap)
        else:
            self.open.clear()
        if over:
            yield pd.DataFrame({"key": key[0], "started": pd.Series([s[0] for s in over], dtype="int64"), "last": pd.Series([s[1] for s in over], dtype="int64"), "n": pd.Series([s[2] for s in over], dtype="int64")})

    def close(self) -> None:
        pass


def set_timer(handle: StatefulProcessorHandle, micros: int) -> None:
    """The key's only event-time timer, at the millisecond in which ``micros`` has passed."""
    for at in list(handle.listTimers()):
        handle.deleteTimer(at)
    handle.registerTimer(-(-int(micros) // 1000))


def session_stream(events: DataFrame, key: str, ts: str = "ts", delay: str = "1 hour", gap: int = SESSION_MICROS) -> DataFrame:
    """The rows of ``sessions`` from a stream, each once its end is ``delay`` behind the newest event.

    A row no newer than the watermark is late and is left out, as is one without a time.
    """
    kind = events.schema[key].dataType.simpleString()
    timed = events.filter(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", delay)
    timed = timed.withColumn("us", F.unix_micros("ts"))
    out = stream(timed, "key", SessionClock(gap), f"key {kind}, started long, last long, n long", event_time=True)
    return out.select(F.col("key").alias(key), F.timestamp_micros("started").alias("started"), F.timestamp_micros(F.col("last") + gap).alias("expires"), "n")


def stream(requests: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str = "append", event_time: bool = False) -> DataFrame:
    """A stateful operator on a stream; state is kept per key in the checkpoint, which survives lost executors.

    With a processor's ``ttl_ms`` the state of idle keys ends by processing time; decisions
    follow event time. With ``event_time`` the requests need a watermark, and timers end state.
    """
    clock = "EventTime" if event_time else "ProcessingTime" if processor.ttl_ms else "none"
    return requests.groupBy(key).transformWithStateInPandas(processor, schema, mode, clock)
