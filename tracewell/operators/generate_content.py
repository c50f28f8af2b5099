"""Generate-content bodies: contents of parts, replies whole or as a list of chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import blocks as b

PART = """struct<text: string, thought: boolean, functionCall: struct<name: string, args: variant>, functionResponse: struct<name: string, response: variant>,
 inlineData: struct<mimeType: string, data: string>, fileData: struct<mimeType: string, fileUri: string>>"""
REQUEST = f"""contents array<struct<role: string, parts: array<{PART}>>>, systemInstruction struct<parts: array<struct<text: string>>>,
 tools array<struct<functionDeclarations: array<struct<name: string, description: string, parameters: variant>>>>, broken string"""
THIN = "contents array<struct<role: string>>, tools array<struct<functionDeclarations: array<struct<name: string>>>>, broken string"
_FIELDS = f"candidates array<struct<content: struct<parts: array<{PART}>>, finishReason: string>>, usageMetadata struct<promptTokenCount: bigint, candidatesTokenCount: bigint, cachedContentTokenCount: bigint>"
REPLY = f"{_FIELDS}, broken string"
CHUNKS = f"array<struct<{_FIELDS}>>"


def _block(p: Column) -> Column:
    """The block of a part, by what it holds; null for a part without anything."""
    call, result, inline, file = p["functionCall"], p["functionResponse"], p["inlineData"], p["fileData"]
    shown = F.when(b.s(p["text"]) != "", b.block(F.when(F.coalesce(p["thought"], F.lit(False)), "thinking").otherwise("text"), text=p["text"]))
    return (
        F.when(call.isNotNull(), b.block("tool_use", tool_name=call["name"], tool_input=b.json_text(call["args"])))
        .when(result.isNotNull(), b.block("tool_result", tool_id=result["name"], result_content=b.json_text(result["response"])))
        .when(inline.isNotNull(), b.block("media", mime_type=inline["mimeType"], inline=F.lit(True), byte_size=F.nullif(text.base64_length(inline["data"]).cast("long"), F.lit(0).cast("long"))))
        .when(file.isNotNull(), b.block("media", mime_type=file["mimeType"], file_uri=file["fileUri"]))
        .otherwise(shown)
    )


def blocks_of(parts: Column) -> Column:
    """The blocks of parts; neighbouring texts, and neighbouring thoughts, are one block."""
    all_ = F.filter(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), _block), lambda x: x.isNotNull())
    joins = lambda a, c: (a["type"] == c["type"]) & c["type"].isin("text", "thinking")

    def joined(xs: Column) -> Column:
        starts = F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | ~joins(F.get(xs, i - 1), x), i)), lambda i: i.isNotNull())

        def made(at: Column, k: Column) -> Column:
            x, to = F.get(xs, at), F.coalesce(F.get(starts, k + 1), F.size(xs))
            run = F.array_join(F.transform(F.slice(xs, at + 1, to - at), lambda y: b.s(y["text"])), "")
            return F.when(x["type"].isin("text", "thinking"), b.block(x["type"], text=run)).otherwise(x)

        return F.transform(starts, made)

    return F.element_at(F.transform(F.array(all_), joined), 1)


def counted(thin: Column) -> tuple[Column, Column]:
    """(contents of a request, the place of the turn that answers it)."""
    n = F.coalesce(F.size(thin["contents"]), F.lit(0))
    return n, n


def request(body: Column) -> Column:
    """struct<system, tools, turns> of a request: a turn per content, with or without blocks."""
    r = b.object_of(body, REQUEST)
    texts = F.filter(F.transform(r["systemInstruction"]["parts"], lambda p: p["text"]), lambda t: F.length(t) > 0)
    role = lambda c: F.when(b.s(c["role"]) == "", "user").when(c["role"] == "model", "assistant").otherwise(c["role"])
    turns = F.transform(r["contents"], lambda c: F.struct(role(c).alias("role"), blocks_of(c["parts"]).alias("blocks")))
    declared = F.flatten(F.filter(F.transform(r["tools"], lambda t: t["functionDeclarations"]), lambda d: d.isNotNull()))
    tools = F.transform(declared, lambda d: b.tool(d["name"], d["description"], d["parameters"]))
    return F.when(F.size(turns) > 0, F.struct(F.coalesce(F.array_join(texts, "\n\n"), F.lit("")).alias("system"), tools.alias("tools"), turns.alias("turns")))


def _firsts(chunks: Column) -> Column:
    """The first candidates of the chunks that have any."""
    return F.transform(F.filter(chunks, lambda c: F.size(c["candidates"]) > 0), lambda c: c["candidates"][0])


def reply(body: Column) -> Column:
    """struct<role, blocks> of a reply; null without blocks."""
    chunks, whole = b.array_of(body, CHUNKS), F.get(b.object_of(body, REPLY)["candidates"], F.lit(0))
    parts = F.flatten(F.filter(F.transform(_firsts(chunks), lambda c: c["content"]["parts"]), lambda p: p.isNotNull()))
    blocks = F.when(chunks.isNotNull(), blocks_of(parts)).when(whole.isNotNull(), blocks_of(whole["content"]["parts"]))
    return F.when(F.size(blocks) > 0, F.struct(F.lit("assistant").alias("role"), blocks.alias("blocks")))


def metrics(body: Column) -> Column:
    """Of a streamed reply, the last finish reason and usage; of a whole one without a candidate, nothing."""
    chunks, whole, zero = b.array_of(body, CHUNKS), b.object_of(body, REPLY), F.lit(0)
    last = lambda xs: F.get(F.reverse(xs), F.lit(0))
    first = F.get(whole["candidates"], F.lit(0))
    stop = F.when(chunks.isNotNull(), last(F.filter(F.transform(_firsts(chunks), lambda c: b.s(c["finishReason"])), lambda x: x != ""))).otherwise(first["finishReason"])
    usage = F.when(chunks.isNotNull(), last(F.filter(F.transform(chunks, lambda c: c["usageMetadata"]), lambda u: u.isNotNull()))).when(first.isNotNull(), whole["usageMetadata"])
    return b.metrics(stop, zero, zero, usage["cachedContentTokenCount"], zero, usage["promptTokenCount"], usage["candidatesTokenCount"])
