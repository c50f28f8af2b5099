"""Content blocks, the parts of turns that all kinds of bodies are taken apart into."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.envelopes import valid_json

BLOCK = "struct<type: string, text: string, tool_id: string, tool_name: string, tool_input: string, is_error: boolean, result_content: string, mime_type: string, file_uri: string, inline: boolean, byte_size: bigint>"
MEMBERS = {"text": "string", "tool_id": "string", "tool_name": "string", "tool_input": "string", "is_error": "boolean", "result_content": "string", "mime_type": "string", "file_uri": "string", "inline": "boolean", "byte_size": "bigint"}
PARSED = {"columnNameOfCorruptRecord": "broken"}
NONE = f"array<{BLOCK}>"


def s(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def kind_of(v: Column) -> Column:
    """STRING, VOID, ARRAY<...>, OBJECT<...> or another type name; null for an absent member."""
    return F.schema_of_variant(v)


def block(kind: Column | str, **members: Column) -> Column:
    """A BLOCK with the members given; empty and false ones are null, so JSON text leaves them out."""
    set_ = {m: F.nullif(x, F.lit("")) if MEMBERS[m] == "string" else x for m, x in members.items()}
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), *(set_.get(m, F.lit(None)).cast(t).alias(m) for m, t in MEMBERS.items()))


def true(x: Column) -> Column:
    return F.when(x, F.lit(True))


def object_of(body: Column, schema: str) -> Column:
    """The fields of schema (which ends in broken string) of a JSON object's text; null for anything else."""
    read = F.from_json(body, schema, PARSED)
    return F.when(F.ltrim(body).startswith("{"), F.when(read["broken"].isNull(), read))


def array_of(body: Column, schema: str) -> Column:
    """The elements of a JSON array's text; null for anything else and for an empty array."""
    read = F.from_json(body, schema)
    return F.when(F.ltrim(body).startswith("["), F.when(F.size(read) > 0, read))


def arguments(text: Column) -> Column:
    """JSON arguments with sorted keys; what is no JSON as it came."""
    return F.when(valid_json(text), F.to_json(F.try_parse_json(text))).otherwise(text)


def json_text(v: Column) -> Column:
    return F.when(v.isNotNull(), F.to_json(v))


def none() -> Column:
    return F.array().cast(NONE)


def tool(name: Column, description: Column, schema: Column) -> Column:
    return F.struct(s(name).alias("name"), s(description).alias("description"), json_text(schema).alias("input_schema"))


def metrics(stop: Column, latency: Column, first: Column, read: Column, written: Column, asked: Column | None = None, answered: Column | None = None) -> Column:
    """What a reply tells about its invocation; zeros and empty strings leave the invocation's own values."""
    count = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    return F.struct(s(stop).alias("stop"), count(latency).alias("latency"), count(first).alias("first"), count(read).alias("read"), count(written).alias("written"), (zero if asked is None else count(asked)).alias("asked"), (zero if answered is None else count(answered)).alias("answered"))
