"""Capture folders: <uuid>.request.json and <request id>.response.json files, dated by modification time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import pairing
from tracewell.sources import bodies as body_files
from tracewell.sources import listing
from tracewell.sources.dates import window

REQUEST = "model string, metadata struct<user_id: string>, diagnostics struct<previous_message_id: string>, messages array<variant>, broken string"
RESPONSE = "id string, model string, stop_reason string, usage struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>, broken string"
#: Responses are looked for this long before and after the window of the requests.
SLACK = dt.timedelta(minutes=10)


def _files(spark: SparkSession, folder: str, suffix: str, first: dt.datetime | None, last: dt.datetime | None) -> DataFrame:
    """(value, name without suffix, mtime in microseconds, path) of the files of folder, not of folders in it."""
    changed = F.col("_metadata.file_modification_time")
    files = spark.read.option("wholetext", True).option("pathGlobFilter", f"*{suffix}").option("ignoreMissingFiles", True).text(folder)
    files = files.where(F.lit(True) if first is None else changed >= F.lit(first)).where(F.lit(True) if last is None else changed < F.lit(last))
    return files.select("value", F.regexp_replace("_metadata.file_name", f"{suffix.replace('.', chr(92) + '.')}$", "").alias("name"), F.unix_micros(changed).alias("mtime"), body_files.address().alias("path"))


def _s(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


#: Why requests are skipped.
SKIPPED = ("malformed", "no_messages")


def requests(spark: SparkSession, folder: str, start: str = "", end: str = "", skipped: Observation | None = None) -> DataFrame:
    """(uuid, mtime, model, session_id, prev_id, chain, num_messages, principal, device_id, request_path) of requests with a message; others are skipped.

    skipped gets the number of request files ("lines") and of those skipped (SKIPPED) from the job that reads them.

    chain is a hash of the first message with sorted keys, which stays as a thread grows.
    """
    files = _files(spark, folder, ".request.json", *window(start, end))
    files = files.withColumn("r", F.from_json("value", REQUEST, {"columnNameOfCorruptRecord": "broken"}))
    why = listing.reason(("malformed", F.col("r.broken").isNotNull() | ~F.ltrim("value").startswith("{")), ("no_messages", ~F.coalesce(F.size("r.messages") > 0, F.lit(False))))
    files = listing.counted(files.withColumn("reason", why), SKIPPED, skipped)
    user = F.col("r.metadata.user_id")
    blob = lambda k: F.coalesce(F.when(F.ltrim(user).startswith("{"), F.get_json_object(user, f"$.{k}")), F.lit(""))
    return files.select(
        F.col("name").alias("uuid"), "mtime", _s("r.model").alias("model"), F.coalesce(text.session_from_id(user), F.lit("")).alias("session_id"), _s("r.diagnostics.previous_message_id").alias("prev_id"),
        F.sha2(F.to_json(F.col("r.messages")[0]), 256).alias("chain"), F.size("r.messages").alias("num_messages"), blob("account_uuid").alias("principal"), blob("device_id").alias("device_id"), F.col("path").alias("request_path"),
    )


def responses(spark: SparkSession, folder: str, start: str = "", end: str = "") -> DataFrame:
    """(message_id, request_id, mtime, model, stop_reason, token counts) of responses with an id; of equal ids, the earliest file."""
    first, last = window(start, end)
    files = _files(spark, folder, ".response.json", first and first - SLACK, last and last + SLACK)
    files = files.withColumn("r", F.from_json("value", RESPONSE, {"columnNameOfCorruptRecord": "broken"})).where("r.broken is null and r.id <> '' and ltrim(value) like '{%'")
    count = lambda c: F.coalesce(F.col(f"r.usage.{c}"), F.lit(0))
    rows = files.select(F.col("r.id").alias("message_id"), F.col("name").alias("request_id"), F.col("path").alias("response_path"), "mtime", _s("r.model").alias("model"), _s("r.stop_reason").alias("stop_reason"), count("input_tokens").alias("input_tokens"), count("output_tokens").alias("output_tokens"), count("cache_read_input_tokens").alias("cache_read_tokens"), count("cache_creation_input_tokens").alias("cache_write_tokens"))
    kept = F.min_by(F.struct(*(c for c in rows.columns if c != "message_id")), F.struct("mtime", "request_id")).alias("kept")
    return rows.groupBy("message_id").agg(kept).select("message_id", "kept.*")


def read(spark: SparkSession, folder: str, start: str = "", end: str = "", bodies: bool = False, skipped: Observation | None = None) -> DataFrame:
    """Invocations of a capture folder: requests of the days start to end with their responses (pairing.threaded).

    A paired request has status 200 and the response's request id, tokens and stop reason; others keep their own id, an
    empty status and zero counts. thread_id is the first request of the thread. extra holds session and device ids. With
    bodies, the files of the requests and responses that are left are opened when pairing is done, by the tasks that have their rows
    (sources/bodies.py); a file that is gone is null.
    Columns include those that sessionization and reconstruction take.
    """
    made = pairing.threaded(requests(spark, folder, start, end, skipped), responses(spark, folder, start, end))
    paired = F.col("message_id") != ""
    extra = F.map_filter(F.create_map(F.lit("device_id"), F.col("device_id"), F.lit("session_id"), F.col("session_id")), lambda k, v: v != "")
    rows = made.select(
        F.col("mtime").alias("ts"), F.date_format(F.timestamp_micros("mtime"), "yyyyMMdd").alias("day"), F.xxhash64("uuid").alias("n"), F.lit("claude").alias("provider"), F.when(paired, F.col("request_id")).otherwise(F.col("uuid")).alias("request_id"), F.col("uuid").alias("request_uuid"), "principal", F.lit("messages").alias("operation"),
        F.col("model").alias("model_id"), F.when(paired, "200").otherwise("").alias("status"), F.lit("").alias("error_code"), "session_id", "thread_id", "num_messages", "message_id", "prev_id", _s("stop_reason").alias("stop_reason"), extra.alias("extra"), "request_path", F.when(paired, F.col("response_path")).alias("response_path"),
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")),
    )
    return body_files.fetched(rows, {"input_body": "request_path", "output_body": "response_path"}) if bodies else rows.drop("request_path", "response_path")
