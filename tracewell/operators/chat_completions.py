"""Chat completion bodies: messages with string or part content and tool calls, replies whole or streamed by tool index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import blocks as b

_CALL = "struct<id: string, function: struct<name: string, arguments: string>>"
_MESSAGE = f"role: string, content: variant, tool_calls: array<{_CALL}>, function_call: struct<name: string, arguments: string>, tool_call_id: string"
REQUEST = f"messages array<struct<{_MESSAGE}>>, tools array<struct<function: struct<name: string, description: string, parameters: variant>>>, broken string"
THIN = "messages array<struct<role: string>>, tools array<struct<function: struct<name: string>>>, broken string"
_USAGE = "usage struct<prompt_tokens: bigint, completion_tokens: bigint, prompt_tokens_details: struct<cached_tokens: bigint>>"
REPLY = f"choices array<struct<message: struct<{_MESSAGE}>, finish_reason: string>>, {_USAGE}, broken string"
CHUNKS = "array<struct<choices: array<struct<delta: struct<content: string, tool_calls: array<struct<index: int, id: string, function: struct<name: string, arguments: string>>>>>>>>"
PARTS = "array<struct<type: string, text: string, image_url: struct<url: string>>>"
#: Roles whose messages make the system prompt.
SYSTEM = ("system", "developer")


def _is_image(p: Column) -> Column:
    return (b.s(p["type"]) == "image_url") | p["image_url"].isNotNull()


def content_text(content: Column) -> Column:
    """A string, or an array's non-empty texts and a mark for each image, joined by line breaks, or the JSON text of anything else."""
    kind, parts = b.kind_of(content), F.try_variant_get(content, "$", PARTS)
    texts = F.filter(F.transform(parts, lambda p: F.when(_is_image(p), F.lit("[image]")).otherwise(b.s(p["text"]))), lambda t: t != "")
    return F.when(content.isNull() | (kind == "VOID"), "").when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(kind.startswith("ARRAY") & parts.isNotNull(), F.array_join(texts, "\n")).otherwise(F.to_json(content))


def _image(p: Column) -> Column:
    url = b.s(p["image_url"]["url"])
    data = text.data_uri(url)
    inline = url.rlike("(?s)^data:[^,]*base64[^,]*,")
    return b.block("media", mime_type=F.when(inline, data["mime"]), inline=b.true(inline), byte_size=F.when(inline, F.nullif(text.base64_length(data["payload"]).cast("long"), F.lit(0).cast("long"))), file_uri=F.when(~inline, url))


def user_blocks(content: Column) -> Column:
    """A text block of a string; a block per text or image part of an array; anything else as its JSON text."""
    kind, parts = b.kind_of(content), F.try_variant_get(content, "$", PARTS)
    plain = F.try_variant_get(content, "$", "string")
    shown = F.filter(parts, lambda p: _is_image(p) | (b.s(p["text"]) != ""))
    return (
        F.when(content.isNull() | (kind == "VOID"), b.none())
        .when(kind == "STRING", F.when(plain == "", b.none()).otherwise(F.array(b.block("text", text=plain))))
        .when(kind.startswith("ARRAY") & parts.isNotNull(), F.transform(shown, lambda p: F.when(_is_image(p), _image(p)).otherwise(b.block("text", text=p["text"]))))
        .otherwise(F.array(b.block("text", text=F.to_json(content))))
    )


def _call(name: Column, id_: Column, given: Column) -> Column:
    return b.block("tool_use", tool_name=name, tool_id=id_, tool_input=b.arguments(given))


def assistant_blocks(m: Column) -> Column:
    """The text, if any, a tool_use block per tool call, and one for a function call of the older form."""
    said = content_text(m["content"])
    calls = F.coalesce(F.transform(m["tool_calls"], lambda c: _call(c["function"]["name"], c["id"], b.s(c["function"]["arguments"]))), b.none())
    old = m["function_call"]
    named = b.s(old["name"]) != ""
    return F.concat(F.when(said != "", F.array(b.block("text", text=said))).otherwise(b.none()), calls, F.when(named, F.array(_call(old["name"], F.lit(""), b.s(old["arguments"])))).otherwise(b.none()))


def _turn(m: Column) -> Column:
    role = b.s(m["role"])
    result = F.array(b.block("tool_result", tool_id=m["tool_call_id"], result_content=content_text(m["content"])))
    blocks = F.when(role == "tool", result).when(role == "assistant", assistant_blocks(m)).otherwise(user_blocks(m["content"]))
    return F.struct(F.when(role == "tool", "user").otherwise(role).alias("role"), blocks.alias("blocks"))


def _speaks(m: Column) -> Column:
    return ~b.s(m["role"]).isin(*SYSTEM)


def counted(thin: Column) -> tuple[Column, Column]:
    """(messages of a request, the place of the turn that answers it: system messages make no turns)."""
    return F.coalesce(F.size(thin["messages"]), F.lit(0)), F.coalesce(F.size(F.filter(thin["messages"], _speaks)), F.lit(0))


def request(body: Column) -> Column:
    """struct<system, tools, turns> of a request; turns without blocks are left out."""
    r = b.object_of(body, REQUEST)
    system = F.filter(F.transform(F.filter(r["messages"], lambda m: ~_speaks(m)), lambda m: content_text(m["content"])), lambda t: t != "")
    turns = F.filter(F.transform(F.filter(r["messages"], _speaks), _turn), lambda t: F.size(t["blocks"]) > 0)
    tools = F.transform(r["tools"], lambda t: b.tool(t["function"]["name"], t["function"]["description"], t["function"]["parameters"]))
    return F.when(F.size(r["messages"]) > 0, F.struct(F.array_join(system, "\n\n").alias("system"), tools.alias("tools"), turns.alias("turns")))


def streamed_blocks(chunks: Column) -> Column:
    """The texts of all chunks joined, then a tool_use block per index, in order of indexes; the last id and name count."""
    deltas = F.transform(F.filter(chunks, lambda c: F.size(c["choices"]) > 0), lambda c: c["choices"][0]["delta"])
    said = F.array_join(F.transform(deltas, lambda d: b.s(d["content"])), "")
    calls = F.flatten(F.filter(F.transform(deltas, lambda d: d["tool_calls"]), lambda c: c.isNotNull()))
    index = lambda c: F.coalesce(c["index"], F.lit(0))

    def made(i: Column) -> Column:
        mine = F.filter(calls, lambda c: index(c) == i)
        last = lambda get: F.get(F.reverse(F.filter(F.transform(mine, get), lambda x: F.length(x) > 0)), F.lit(0))
        return _call(last(lambda c: c["function"]["name"]), last(lambda c: c["id"]), F.array_join(F.transform(mine, lambda c: b.s(c["function"]["arguments"])), ""))

    tools = F.transform(F.array_sort(F.array_distinct(F.transform(calls, index))), made)
    return F.concat(F.when(said != "", F.array(b.block("text", text=said))).otherwise(b.none()), F.coalesce(tools, b.none()))


def reply(body: Column) -> Column:
    """struct<role, blocks> of a reply; null without blocks."""
    first = F.get(b.object_of(body, REPLY)["choices"], F.lit(0))
    chunks = b.array_of(body, CHUNKS)
    blocks = F.when(chunks.isNotNull(), streamed_blocks(chunks)).when(first.isNotNull(), assistant_blocks(first["message"]))
    return F.when(F.size(blocks) > 0, F.struct(F.lit("assistant").alias("role"), blocks.alias("blocks")))


def metrics(body: Column) -> Column:
    """Of a whole reply; a streamed one tells nothing."""
    r, zero = b.object_of(body, REPLY), F.lit(0)
    u = r["usage"]
    return b.metrics(F.get(r["choices"], F.lit(0))["finish_reason"], zero, zero, u["prompt_tokens_details"]["cached_tokens"], zero, u["prompt_tokens"], u["completion_tokens"])
