"""Messages API bodies: requests of messages with content blocks, replies whole or streamed by block index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import blocks as b

REQUEST = "system variant, messages array<struct<role: string, content: variant>>, tools array<struct<name: string, description: string, input_schema: variant>>, broken string"
REPLY = "role string, content variant, stop_reason string, usage struct<cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>, broken string"
CHUNKS = """array<struct<type: string, index: int, content_block: struct<type: string, id: string, name: string>,
 delta: struct<type: string, text: string, thinking: string, partial_json: string, stop_reason: string>,
 message: struct<usage: struct<cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>>,
 `amazon-bedrock-invocationMetrics`: struct<invocationLatency: bigint, firstByteLatency: bigint, cacheReadInputTokenCount: bigint, cacheWriteInputTokenCount: bigint>>>"""
SENT = """array<struct<type: string, text: string, thinking: string, id: string, name: string, input: variant, tool_use_id: string, content: variant, is_error: boolean,
 source: struct<type: string, media_type: string, data: string, url: string>>>"""
PARTS = "array<struct<type: string, text: string>>"
#: What is read of every request: who speaks, and whether the rest has the right shape.
THIN = "messages array<struct<role: string>>, tools array<struct<name: string>>, broken string"


def _joined_text(v: Column, mark: str) -> Column:
    """A string, the non-empty texts of an array's parts joined by mark, or the JSON text of anything else."""
    parts = F.filter(F.transform(F.try_variant_get(v, "$", PARTS), lambda p: p["text"]), lambda t: F.length(t) > 0)
    kind = b.kind_of(v)
    return F.when(v.isNull() | (kind == "VOID"), "").when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("ARRAY"), F.array_join(parts, mark)).otherwise(F.to_json(v))


def _media(source: Column) -> Column:
    data, url, kind = b.s(source["data"]), b.s(source["url"]), b.s(source["type"])
    linked = (kind == "url") | (kind != "base64") & (url != "")
    inline = (kind == "base64") | (kind != "url") & (url == "") & (data != "")
    return b.block("media", mime_type=b.s(source["media_type"]), file_uri=F.when(linked, url), inline=b.true(inline), byte_size=F.when(inline, F.nullif(text.base64_length(data).cast("long"), F.lit(0).cast("long"))))


def _taken_apart(x: Column) -> Column:
    kind = b.s(x["type"])
    return (
        F.when(kind == "text", b.block("text", text=x["text"]))
        .when(kind == "thinking", b.block("thinking", text=x["thinking"]))
        .when(kind == "tool_use", b.block("tool_use", tool_name=x["name"], tool_id=x["id"], tool_input=b.json_text(x["input"])))
        .when(kind == "tool_result", b.block("tool_result", tool_id=x["tool_use_id"], result_content=_joined_text(x["content"], "\n"), is_error=b.true(x["is_error"])))
        .when(kind.isin("image", "document"), _media(x["source"]))
        .otherwise(b.block(kind, text=b.json_text(x["content"])))
    )


def blocks_of(content: Column) -> Column:
    """array<BLOCK> of a message's content: a string, an array of blocks, or anything else as its JSON text."""
    kind, none = b.kind_of(content), b.none()
    plain = F.try_variant_get(content, "$", "string")
    blocks = F.transform(F.try_variant_get(content, "$", SENT), _taken_apart)
    return (
        F.when(content.isNull(), F.array(b.block("text")))
        .when(kind == "VOID", none)
        .when(kind == "STRING", F.when(plain == "", none).otherwise(F.array(b.block("text", text=plain))))
        .when(kind.startswith("ARRAY") & blocks.isNotNull(), blocks)
        .otherwise(F.array(b.block("text", text=F.to_json(content))))
    )


def streamed_blocks(chunks: Column) -> Column:
    """array<BLOCK> of a streamed reply: per index, the deltas after its last start, joined in order; empty texts are left out."""
    placed = F.transform(chunks, lambda c, i: F.struct(i.alias("at"), c.alias("c")))
    starts = F.filter(placed, lambda p: p["c"]["type"] == "content_block_start")
    indexes = F.array_sort(F.array_distinct(F.transform(starts, lambda p: F.coalesce(p["c"]["index"], F.lit(0)))))
    of = lambda p, i: F.coalesce(p["c"]["index"], F.lit(0)) == i

    def piece(d: Column) -> Column:
        return F.when(d["type"] == "text_delta", b.s(d["text"])).when(d["type"] == "thinking_delta", b.s(d["thinking"])).when(d["type"] == "input_json_delta", b.s(d["partial_json"])).otherwise("")

    def assembled(i: Column) -> Column:
        start = F.element_at(F.filter(starts, lambda p: of(p, i)), -1)
        deltas = F.filter(placed, lambda p: of(p, i) & (p["at"] > start["at"]) & (p["c"]["type"] == "content_block_delta"))
        return F.struct(start["c"]["content_block"].alias("b"), F.array_join(F.transform(deltas, lambda p: piece(p["c"]["delta"])), "").alias("s"))

    def made(x: Column) -> Column:
        start = x["b"]
        return F.when(start["type"] == "tool_use", b.block("tool_use", tool_name=start["name"], tool_id=start["id"], tool_input=b.arguments(x["s"]))).otherwise(b.block(start["type"], text=x["s"]))

    kept = F.filter(F.transform(indexes, assembled), lambda x: (x["b"]["type"] == "tool_use") | x["b"]["type"].isin("text", "thinking") & (x["s"] != ""))
    return F.transform(kept, made)


def streamed_metrics(chunks: Column) -> Column:
    """Of a streamed reply; later chunks overwrite earlier ones, and none of it counts without a stop reason or latency."""
    zero = F.lit(0).cast("long")
    count = lambda x: F.coalesce(x, zero)
    none = b.metrics(F.lit(""), zero, zero, zero, zero)

    def step(acc: Column, c: Column) -> Column:
        m, u = c["amazon-bedrock-invocationMetrics"], c["message"]["usage"]
        more = lambda new, old: F.when(count(new) > 0, new).otherwise(old)
        return (
            F.when((c["type"] == "message_delta") & c["delta"].isNotNull(), b.metrics(c["delta"]["stop_reason"], acc["latency"], acc["first"], acc["read"], acc["written"]))
            .when((c["type"] == "message_stop") & m.isNotNull(), b.metrics(acc["stop"], m["invocationLatency"], m["firstByteLatency"], m["cacheReadInputTokenCount"], m["cacheWriteInputTokenCount"]))
            .when(c["type"] == "message_start", b.metrics(acc["stop"], acc["latency"], acc["first"], more(u["cache_read_input_tokens"], acc["read"]), more(u["cache_creation_input_tokens"], acc["written"])))
            .otherwise(acc)
        )

    return F.aggregate(chunks, none, step, lambda a: F.when((a["stop"] == "") & (a["latency"] == 0), none).otherwise(a))


def counted(thin: Column) -> tuple[Column, Column]:
    """(messages of a request, the place of the turn that answers it)."""
    n = F.coalesce(F.size(thin["messages"]), F.lit(0))
    return n, n


def request(body: Column) -> Column:
    """struct<system, tools, turns> of a request."""
    r = b.object_of(body, REQUEST)
    tools = F.transform(r["tools"], lambda t: b.tool(t["name"], t["description"], t["input_schema"]))
    turns = F.transform(r["messages"], lambda m: F.struct(b.s(m["role"]).alias("role"), blocks_of(m["content"]).alias("blocks")))
    return F.when(F.size(turns) > 0, F.struct(_joined_text(r["system"], "\n\n").alias("system"), tools.alias("tools"), turns.alias("turns")))


def reply(body: Column) -> Column:
    """struct<role, blocks> of a reply; null without one."""
    chunks, whole = b.array_of(body, CHUNKS), b.object_of(body, REPLY)
    streamed = F.when(chunks.isNotNull(), F.struct(F.lit("assistant").alias("role"), streamed_blocks(chunks).alias("blocks")))
    return F.coalesce(streamed, F.when(F.length(whole["role"]) > 0, F.struct(whole["role"].alias("role"), blocks_of(whole["content"]).alias("blocks"))))


def metrics(body: Column) -> Column:
    chunks, whole = F.when(F.ltrim(body).startswith("["), F.from_json(body, CHUNKS)), b.object_of(body, REPLY)
    zero = F.lit(0)
    of_whole = b.metrics(whole["stop_reason"], zero, zero, whole["usage"]["cache_read_input_tokens"], whole["usage"]["cache_creation_input_tokens"])
    return F.coalesce(F.when(chunks.isNotNull(), streamed_metrics(chunks)), F.when(whole.isNotNull(), of_whole), b.metrics(F.lit(""), zero, zero, zero, zero))
