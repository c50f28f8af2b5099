"""Vertex request-response logging: rows of the exported table, with payloads in pieces."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.functions.envelopes import family, session_of, valid_json
from tracewell.sources.dates import window

USAGE = "struct<usageMetadata: struct<promptTokenCount: bigint, candidatesTokenCount: bigint, cachedContentTokenCount: bigint>>"
ERROR = "struct<error: struct<code: bigint, status: string>>"


def identifiers(*names: str, count: int | None = None) -> tuple[str, ...]:
    """names; ValueError if one has other characters than letters, digits and _-.: or is empty, or if there are not count of them."""
    for name in names:
        if not re.fullmatch(r"[A-Za-z0-9_\-.:]+", name):
            raise ValueError(f"not an identifier: {name!r}")
    if count is not None and len(names) != count:
        raise ValueError(f"not {count} identifiers: {'.'.join(names)!r}")
    return names


def table(spark: SparkSession, *names: str) -> DataFrame:
    """spark.table of names joined by dots; ValueError if one is no identifier."""
    return spark.table(".".join(f"`{n}`" for n in identifiers(*names)))


def request_body(pieces: Column) -> Column:
    """The pieces as one JSON text: joined if that is valid, else the first valid piece, else the first; empty without any."""
    joined = F.array_join(pieces, "")
    return F.coalesce(F.when(F.size(pieces) <= 1, joined).when(valid_json(joined), joined), F.get(F.filter(pieces, valid_json), F.lit(0)), F.get(pieces, F.lit(0)), F.lit(""))


def response_body(pieces: Column) -> Column:
    """One piece as it is; several as a JSON array of the valid ones, or the first if none is."""
    valid = F.filter(pieces, valid_json)
    many = F.when(F.size(valid) > 0, F.concat(F.lit("["), F.array_join(valid, ","), F.lit("]"))).otherwise(F.get(pieces, F.lit(0)))
    return F.coalesce(F.when(F.size(pieces) > 1, many).otherwise(F.get(pieces, F.lit(0))), F.lit(""))


def _usage(body: Column) -> Column:
    """The usage of an object, or of the last element of an array that has any; null if all counts are zero."""
    several = F.when(F.ltrim(body).startswith("["), F.from_json(body, f"array<{USAGE}>"))
    each = F.transform(F.coalesce(several, F.array(F.from_json(body, USAGE))), lambda c: c["usageMetadata"])
    some = F.filter(each, lambda u: F.coalesce(u["promptTokenCount"], F.lit(0)) + F.coalesce(u["candidatesTokenCount"], F.lit(0)) + F.coalesce(u["cachedContentTokenCount"], F.lit(0)) > 0)
    return F.get(some, F.size(some) - 1)


def error_code(body: Column) -> Column:
    """error.status, else HTTP and error.code, of an object or an array's first element; else empty."""
    several = F.when(F.ltrim(body).startswith("["), F.get(F.from_json(body, f"array<{ERROR}>"), F.lit(0)))
    e = F.when(F.ltrim(body).startswith("["), several).otherwise(F.from_json(body, ERROR))["error"]
    return F.coalesce(F.nullif(e["status"], F.lit("")), F.when(e["code"] != 0, F.concat(F.lit("HTTP "), e["code"].cast("string"))), F.lit(""))


def records(rows: DataFrame, start: str = "", end: str = "") -> DataFrame:
    """Invocations of rows (endpoint, deployed_model_id, logging_time, request_id, request_payload, response_payload: arrays).

    start and end (YYYY-MM-DD, both included) bound logging_time, so they reach the scan. Rows without time, id and bodies
    are dropped. Null strings are empty; a missing or zero id is made of model and time (microseconds).
    """
    first, last = window(start, end)
    at = F.col("logging_time")
    rows = rows.where(F.lit(True) if first is None else at >= F.lit(first)).where(F.lit(True) if last is None else at < F.lit(last))
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    model = F.coalesce(F.nullif(text.path_segment(s("endpoint"), "models"), F.lit("")), s("deployed_model_id"))
    rows = rows.select(at.cast("timestamp").alias("at"), s("endpoint").alias("endpoint"), s("request_id").alias("id"), model.alias("model_id"), request_body(F.col("request_payload")).alias("input_body"), response_body(F.col("response_payload")).alias("output_body"), (F.size("response_payload") > 1).alias("streamed"))
    rows = rows.where("at is not null or id <> '' or input_body <> '' or output_body <> ''").withColumn("u", _usage(F.col("output_body")))
    made = F.concat(F.coalesce(F.nullif("model_id", F.lit("")), F.lit("vertex")), F.lit("-"), F.date_format("at", "yyyyMMdd'T'HHmmss.SSSSSS"), F.lit("000Z"))
    extra = F.create_map(F.lit("endpoint"), F.col("endpoint"), F.lit("project"), text.path_segment(F.col("endpoint"), "projects"), F.lit("location"), text.path_segment(F.col("endpoint"), "locations"))
    count = lambda c: F.coalesce(F.col(f"u.{c}"), F.lit(0)).cast("long")
    provider = F.lit("vertex")
    return rows.select(
        F.unix_micros("at").alias("ts"), F.coalesce(F.date_format("at", "yyyyMMdd"), F.lit("")).alias("day"), F.xxhash64("id", "at", "input_body").alias("n"), provider.alias("provider"), F.when(F.col("id").isin("", "0"), F.coalesce(made, F.lit(""))).otherwise(F.col("id")).alias("request_id"), F.lit("").alias("principal"),
        F.when(F.col("streamed"), "streamGenerateContent").otherwise("generateContent").alias("operation"), "model_id", F.lit("").alias("status"), error_code(F.col("output_body")).alias("error_code"), F.map_filter(extra, lambda k, v: v != "").alias("extra"),
        count("promptTokenCount").alias("input_tokens"), count("candidatesTokenCount").alias("output_tokens"), count("cachedContentTokenCount").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_write_tokens"), "input_body", "output_body", session_of(family(provider, F.col("model_id")), F.col("input_body")).alias("session_id"),
    )


def missing_usage(records: DataFrame) -> DataFrame:
    """(missing): responses without any token count."""
    return records.agg(F.count_if((F.col("output_body") != "") & (F.col("input_tokens") == 0) & (F.col("output_tokens") == 0)).alias("missing"))
