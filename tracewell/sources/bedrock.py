"""Bedrock invocation logs: gzipped JSON lines in a bucket, with large bodies in objects of their own.

Files are chosen by day before any is opened, log files and overflow objects alike. Only lines that name an overflow object
are joined with the objects, by key; the others pass by without a shuffle.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.sources import listing
from tracewell.sources.dates import window

#: The fields read from a log line; bodies stay JSON text.
LINE = """timestamp string, accountId string, region string, requestId string, operation string, modelId string, status string, errorCode string, identity struct<arn: string>,
 input struct<inputBodyJson: string, inputBodyS3Path: string, inputTokenCount: bigint, cacheReadInputTokenCount: bigint, cacheWriteInputTokenCount: bigint>,
 output struct<outputBodyJson: string, outputBodyS3Path: string, outputTokenCount: bigint>, broken string"""
#: Longer lines are skipped.
LONGEST_LINE = 10 << 20


def path_day(path: Column) -> Column:
    """The date of the first /YYYY/MM/DD/ that two or more segments follow; null without one."""
    part = lambda i: F.regexp_extract(path, r"/(\d{4})/(\d{2})/(\d{2})/[^/]+/.", i)
    return F.try_to_timestamp(F.nullif(F.concat_ws("-", part(1), part(2), part(3)), F.lit("--")), F.lit("yyyy-MM-dd")).cast("date")


def bucket_of(uri: Column) -> Column:
    return F.regexp_extract(uri, "^s3://([^/]+)/(.*)$", 1)


def key_of(uri: Column) -> Column:
    return F.regexp_extract(uri, "^s3://([^/]+)/(.*)$", 2)


def _key_in(root: str) -> Column:
    """A file's key: its path under root, which ends where the bucket begins."""
    under = re.sub("^[a-z0-9]+:/*", "/", root).rstrip("/")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.substring_index(path, f"{under}/", -1)


def _in_window(rows: DataFrame, start: str, end: str, slack: int = 0) -> DataFrame:
    """Rows of files whose path's day is in the window, or up to slack days beside it, or that have none."""
    (first, last), more = window(start, end), dt.timedelta(days=slack)
    day = path_day(F.col("_metadata.file_path"))
    if first:
        rows = rows.where(day.isNull() | (day >= F.lit((first - more).date())))
    if last:
        rows = rows.where(day.isNull() | (day < F.lit((last + more).date())))
    return rows


def log_lines(spark: SparkSession, root: str, start: str = "", end: str = "") -> DataFrame:
    """(line, n) of the log files under root whose path's day is in the window; paths without a day are read as well.

    Folders of other days are not listed (see listing).
    """
    path = F.col("_metadata.file_path")
    lines = listing.texts(spark, listing.paths(spark, root, listing.DAYS, *window(start, end)), pathGlobFilter="*.json.gz")
    lines = _in_window(lines.where(~F.contains(path, F.lit("/data/"))), start, end)
    return lines.select(F.col("value").alias("line"), F.xxhash64(path, "value").alias("n"))


def _resolved(rows: DataFrame, objects: DataFrame, body: str, uri: str, bucket: str) -> DataFrame:
    """rows with an empty body replaced by the object at uri, if that lies in bucket; a missing object leaves it empty."""
    wanted = F.coalesce((F.col(body) == "") & (bucket_of(F.col(uri)) == bucket) & (key_of(F.col(uri)) != ""), F.lit(False))
    asking = rows.where(wanted).withColumn("key", key_of(F.col(uri)))
    found = asking.join(objects, "key", "left").withColumn(body, F.coalesce("content", F.lit(""))).select(rows.columns)
    return rows.where(~wanted).unionByName(found)


#: Why lines are skipped, in the order in which it is looked for.
SKIPPED = ("blank", "too_long", "malformed", "bad_time")


def read(spark: SparkSession, root: str, bucket: str, start: str = "", end: str = "", skipped: Observation | None = None) -> DataFrame:
    """Invocations of the logs in bucket, whose copy or address is root; start and end (YYYY-MM-DD, both included) choose files by day.

    Blank and malformed lines are skipped, also those whose timestamp is no time; a line without one has a null ts. skipped
    gets the number of lines and of those skipped (SKIPPED) from the job that reads the records. Records
    are not filtered by their own time. Objects outside bucket are not read. Absent strings are empty and absent counts
    zero. Objects lie under the day of their line or the next one, so those of other days are not opened. Columns are those that the operators take (ts in microseconds, day, n, ...) besides bodies and identity.
    """
    long = F.octet_length("line") > LONGEST_LINE
    known = F.when(~long, F.from_json("line", LINE, {"columnNameOfCorruptRecord": "broken"}))
    lines = log_lines(spark, root, start, end).withColumn("r", known).withColumn("ts", F.try_to_timestamp(F.col("r.timestamp")))
    malformed = F.col("r.broken").isNotNull() | ~F.ltrim("line").startswith("{")
    why = listing.reason(("blank", F.trim("line") == ""), ("too_long", long), ("malformed", malformed), ("bad_time", F.col("r.timestamp").isNotNull() & F.col("ts").isNull()))
    rows = listing.counted(lines.withColumn("reason", why), SKIPPED, skipped)
    ts = F.col("ts")
    s = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(""))
    count = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("long")
    extra = F.map_filter(F.create_map(F.lit("accountId"), s("accountId"), F.lit("region"), s("region")), lambda k, v: v != "")
    rows = rows.select(
        F.unix_micros(ts).alias("ts"), F.coalesce(F.date_format(ts, "yyyyMMdd"), F.lit("")).alias("day"), "n", F.lit("bedrock").alias("provider"), s("requestId").alias("request_id"), s("identity.arn").alias("principal"), s("operation").alias("operation"), s("modelId").alias("model_id"),
        s("status").alias("status"), s("errorCode").alias("error_code"), extra.alias("extra"), count("input.inputTokenCount").alias("input_tokens"), count("output.outputTokenCount").alias("output_tokens"),
        count("input.cacheReadInputTokenCount").alias("cache_read_tokens"), count("input.cacheWriteInputTokenCount").alias("cache_write_tokens"), s("input.inputBodyJson").alias("input_body"), s("output.outputBodyJson").alias("output_body"), s("input.inputBodyS3Path").alias("input_uri"), s("output.outputBodyS3Path").alias("output_uri"),
    )
    (first, last), day = window(start, end), dt.timedelta(days=1)
    found = listing.paths(spark, root, listing.DAYS, first and first - day, last and last + day)
    objects = listing.texts(spark, found, wholetext=True, pathGlobFilter="*.json*")
    objects = _in_window(objects.where(F.contains("_metadata.file_path", F.lit("/data/"))), start, end, 1).select(_key_in(root).alias("key"), F.col("value").alias("content"))
    for body, uri in (("input_body", "input_uri"), ("output_body", "output_uri")):
        rows = _resolved(rows, objects, body, uri, bucket)
    session = text.session_from_id(F.get_json_object("input_body", "$.metadata.user_id"))
    return rows.withColumn("session_id", F.coalesce(session, F.lit(""))).drop("input_uri", "output_uri")
