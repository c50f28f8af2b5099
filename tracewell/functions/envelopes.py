"""The families of request and response bodies, and what all of them tell about an invocation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions import text


def family(provider: Column, model: Column) -> Column:
    """Which envelope an invocation's bodies have: openai, gemini, deferred (not taken apart) or anthropic."""
    return F.when(provider == "azure", "openai").when((provider == "vertex") & F.lower(model).startswith("gemini"), "gemini").when(provider == "vertex", "deferred").otherwise("anthropic")


def session_of(kind: Column, body: Column) -> Column:
    """The session id in a request body: of a user id, or of the first system part of a Gemini request with the marker."""
    user = text.session_from_id(F.get_json_object(body, "$.metadata.user_id"))
    named = F.coalesce(F.nullif(text.session_from_id(F.get_json_object(body, "$.user")), F.lit("")), user)
    parts = F.from_json(F.get_json_object(body, "$.systemInstruction.parts"), "array<struct<text: string>>")
    marked = F.filter(F.transform(parts, lambda p: text.session_suffix(p["text"])), lambda s: s != "")
    return F.coalesce(F.when(kind == "openai", named).when(kind == "gemini", F.get(marked, F.lit(0))).otherwise(user), F.lit(""))


def valid_json(x: Column) -> Column:
    """Whether x is one JSON value and nothing more. The parser ignores what follows a value, so x is tried inside an array and inside an object: what ends the one early breaks the other."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))), "$", "array<variant>")
    return F.coalesce((F.size(listed) == 1) & F.try_parse_json(F.concat(F.lit('{"v":'), x, F.lit("}"))).isNotNull(), F.lit(False))
