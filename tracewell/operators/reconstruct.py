"""Conversations from bodies: system prompt, tools and turns of every thread, with the metrics of each turn.

A later request of a thread holds the earlier ones, so only the fullest request of a thread is taken apart. It is chosen on
counts alone, for which no content is decoded, and only then are bodies read. Metrics come from every invocation and meet
turns by position: a request of N messages was answered by turn N.

Joins here are merges: both sides grow with the records. Tables that were written for them are compressed files, whose size
tells Spark little of their rows', so left alone it gathers large sides on the driver to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.envelopes import family
from tracewell.operators import blocks as b
from tracewell.operators import chat_completions, generate_content, messages_api
from tracewell.sources.scratch import written

#: What tells session conversations apart; conversations without a session id are not reconstructed.
KEY = ("day", "provider", "session_id")
COUNTS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "latency_ms", "first_byte_ms")
#: The kinds of bodies, by family.
ENVELOPES = {"anthropic": messages_api, "openai": chat_completions, "gemini": generate_content}


def _records(records: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Session records of kinds with kind, their family, and empty thread ids for null."""
    rows = records.withColumn("thread_id", b.s(F.col("thread_id"))).withColumn("kind", family(F.col("provider"), F.col("model_id")))
    return rows.where((F.col("session_id") != "") & F.col("kind").isin(*kinds))


def _by_kind(make, kinds: tuple[str, ...]) -> Column:
    """make(envelope) of a row's kind; plain where there is one kind, for a smaller plan."""
    out = make(ENVELOPES[kinds[0]])
    for kind in kinds[1:]:
        out = F.when(F.col("kind") == kind, make(ENVELOPES[kind])).otherwise(out)
    return out


def _count(kinds: tuple[str, ...]) -> Column:
    """struct<n_in, turn_index> of input_body."""
    return _by_kind(lambda e: F.struct(*(x.alias(c) for x, c in zip(e.counted(b.object_of(F.col("input_body"), e.THIN)), ("n_in", "turn_index"), strict=True))), kinds)


def _metrics(rows: DataFrame) -> Column:
    """The metrics of an invocation, from its record and its reply."""
    m = F.col("m")
    larger = lambda new, old: F.when(new > 0, new).otherwise(F.col(old)).alias(old)
    # the record's own latency counts where replies carry none
    latency = F.col("latency_ms") if "latency_ms" in rows.columns else F.lit(0).cast("long")
    return F.struct("ts", "request_id", "model_id", larger(m["asked"], "input_tokens"), larger(m["answered"], "output_tokens"), larger(m["read"], "cache_read_tokens"), larger(m["written"], "cache_write_tokens"), F.when(F.col("kind") == "anthropic", m["latency"]).otherwise(F.coalesce(latency, F.lit(0))).cast("long").alias("latency_ms"), m["first"].alias("first_byte_ms"), m["stop"].alias("stop_reason"))


def _told(records: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(KEY, thread_id, kind, ts, n, n_in: messages of a valid request or 0, turn_index: the place of its answer, metrics) of session records.

    Bodies are read once for it, and what is left of them is small; it is written, since several steps need it.
    """
    rows = _records(records, kinds).withColumn("m", _by_kind(lambda e: e.metrics(F.col("output_body")), kinds)).withColumn("c", _count(kinds))
    rows = rows.withColumn("metrics", _metrics(rows))
    return written(rows.select(*KEY, "thread_id", "kind", "ts", "n", F.coalesce("c.n_in", F.lit(0)).alias("n_in"), F.coalesce("c.turn_index", F.lit(0)).alias("turn_index"), "metrics"), "told")


def chosen(counted: DataFrame) -> DataFrame:
    """(KEY, thread_id, n, is_main) of the fullest request of every thread, of counted (KEY, thread_id, ts, n, n_in).

    Of equals the earliest counts (ts, then n). The main thread starts first, then has more records, then the smaller id;
    if it has no valid request (n_in = 0), its conversation has no threads.
    """
    best = F.max(F.when(F.col("n_in") > 0, F.struct("n_in", -F.coalesce("ts", F.lit(0)), -F.col("n").cast("decimal(20,0)"), "n"))).alias("best")
    found = counted.groupBy(*KEY, "thread_id").agg(best, F.min("ts").alias("start"), F.count("*").alias("records"))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("start", F.col("records").desc(), "thread_id"))
    first = found.select(*KEY, "thread_id", F.col("best.n").alias("n"), F.col("best").isNotNull().alias("valid"), place.alias("place"))
    # whether the main thread is valid, told to all threads of the conversation
    led = first.withColumn("led", F.max(F.when(F.col("place") == 1, F.col("valid"))).over(Window.partitionBy(*KEY)))
    return led.where("valid and led").select(*KEY, "thread_id", "n", (F.col("place") == 1).alias("is_main"))


def threads(records: DataFrame, kinds: tuple[str, ...] = tuple(ENVELOPES)) -> DataFrame:
    """(KEY, thread_id, is_main, system_prompt, tools, turns, reply, metrics) of every thread that can be taken apart.

    The fullest valid request of a thread is used (see chosen). Null ids count as empty. Records of other kinds than kinds
    are left out.
    """
    return _taken_apart(records, kinds, _told(records, kinds))


def _taken_apart(records: DataFrame, kinds: tuple[str, ...], told: DataFrame) -> DataFrame:
    """threads() of records that _told tells about: only the chosen requests' bodies are joined and read."""
    picked = chosen(told).join(told.select(*KEY, "thread_id", "n", "metrics").hint("merge"), [*KEY, "thread_id", "n"])
    picked = picked.select(*(F.col(c).alias(f"c_{c}") for c in (*KEY, "thread_id", "n")), "is_main", "metrics")
    on = [F.col(c) == F.col(f"c_{c}") for c in (*KEY, "thread_id", "n")]
    rows = _records(records, kinds).join(picked.hint("merge"), on[0] & on[1] & on[2] & on[3] & on[4])
    rows = rows.withColumn("asked", _by_kind(lambda e: e.request(F.col("input_body")), kinds)).withColumn("reply", _by_kind(lambda e: e.reply(F.col("output_body")), kinds))
    return rows.where("asked is not null").select(*KEY, "thread_id", "is_main", F.col("asked.system").alias("system_prompt"), F.col("asked.tools").alias("tools"), F.col("asked.turns").alias("turns"), "reply", "metrics")


def turns(records: DataFrame, kinds: tuple[str, ...] = tuple(ENVELOPES)) -> DataFrame:
    """A row per turn: KEY, thread_id (empty for the main thread), turn_index, role, text, blocks (JSON text) and metrics.

    records have the columns of the readers (KEY, thread_id, ts, n, request_id, model_id, token counts, bodies). An answer
    without blocks makes no turn. Metrics of earlier turns are those of the first invocation with as many messages, on
    assistant turns only; turns without any have zeros and empty strings.
    """
    told = _told(records, kinds)
    known = _taken_apart(records, kinds, told)
    # the reply is the turn after those sent, if it has blocks
    sent = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["blocks"].alias("blocks"), F.lit(False).alias("answers")))
    reply = F.when(F.size("reply.blocks") > 0, F.array(F.struct(F.col("reply.role").alias("role"), F.col("reply.blocks").alias("blocks"), F.lit(True).alias("answers")))).otherwise(F.array())
    each = known.select(*KEY, "thread_id", "is_main", "metrics", F.posexplode(F.concat(sent, reply)).alias("turn_index", "t")).withColumn("own", F.when(F.col("t.answers"), F.col("metrics"))).drop("metrics")
    made = told.where("n_in > 0").groupBy(*KEY, "thread_id", "turn_index").agg(F.min_by("metrics", F.struct("ts", "n")).alias("found"))
    rows = each.join(made.hint("merge"), [*KEY, "thread_id", "turn_index"], "left")
    rows = rows.withColumn("m", F.coalesce("own", F.when(F.col("t.role") == "assistant", F.col("found")))).withColumn("blocks", F.col("t.blocks"))
    texts = F.filter(F.transform("blocks", lambda x: F.when(x["type"] == "text", x["text"])), lambda t: F.length(t) > 0)
    return rows.select(
        *KEY, F.when(F.col("is_main"), "").otherwise(F.col("thread_id")).alias("thread_id"), "turn_index", F.col("t.role").alias("role"), F.array_join(texts, "\n\n").alias("text"), F.to_json("blocks").alias("blocks"), F.col("m").isNotNull().alias("has_metrics"), F.coalesce("m.ts", F.lit(0).cast("long")).alias("ts"),
        b.s(F.col("m.request_id")).alias("request_id"), b.s(F.col("m.model_id")).alias("model_id"), *(F.coalesce(f"m.{c}", F.lit(0).cast("long")).alias(c) for c in COUNTS), b.s(F.col("m.stop_reason")).alias("stop_reason"),
    )


def tool_calls(turns: DataFrame) -> DataFrame:
    """(conversation key, thread_id, tool_id, tool_name, tool_input, called_at, answered_at, result, is_error) of every call of turns.

    A call meets the first result with its id in its thread; calls without one have nulls there.
    """
    block = F.from_json("blocks", f"array<{b.BLOCK}>")
    each = turns.select(*KEY, "thread_id", "turn_index", F.explode(block).alias("x")).where("x.type in ('tool_use', 'tool_result')")
    # calls and results both come from it; turns are costly to make
    each = written(each.select(*KEY, "thread_id", "turn_index", F.struct(*(f"x.{c}" for c in ("type", "tool_id", "tool_name", "tool_input", "result_content", "is_error"))).alias("x")), "tools")
    calls = each.where("x.type = 'tool_use'").select(*KEY, "thread_id", b.s(F.col("x.tool_id")).alias("tool_id"), b.s(F.col("x.tool_name")).alias("tool_name"), b.s(F.col("x.tool_input")).alias("tool_input"), F.col("turn_index").alias("called_at"))
    results = each.where("x.type = 'tool_result' and x.tool_id <> ''").groupBy(*KEY, "thread_id", F.col("x.tool_id").alias("tool_id"))
    first = F.min_by(F.struct("turn_index", b.s(F.col("x.result_content")).alias("result"), F.coalesce("x.is_error", F.lit(False)).alias("is_error")), "turn_index").alias("r")
    return calls.join(results.agg(first).hint("merge"), [*KEY, "thread_id", "tool_id"], "left").select(*calls.columns, F.col("r.turn_index").alias("answered_at"), "r.result", "r.is_error")
