"""Day totals and gap sessions of a stream of invocations.

Streams have the columns of the readers; any of the file readers' folders can be followed with Spark's file source. Late
records count as long as the watermark lets them; then a day's or session's row is final and its state is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.sessionize import GAP, SCOPE

LATE = "1 hour"


def _timed(records: DataFrame, late: str) -> DataFrame:
    return records.withColumn("at", F.timestamp_micros("ts")).withWatermark("at", late)


def _sums() -> list:
    return [F.count("*").alias("invocations"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cache_read_tokens").alias("cache_read_tokens"), F.count_if(F.col("error_code") != "").alias("errors")]


def day_stats(records: DataFrame, late: str = LATE) -> DataFrame:
    """(day, invocations, token sums, errors) of every UTC day; records without a time are left out."""
    days = _timed(records.where("ts is not null"), late).groupBy(F.window("at", "1 day").alias("w")).agg(*_sums())
    return days.select(F.date_format("w.start", "yyyyMMdd").alias("day"), *(c for c in days.columns if c != "w"))


def gap_sessions(records: DataFrame, gap: int = GAP, late: str = LATE) -> DataFrame:
    """(day, provider, model_id, principal, start_ts, end_ts, sums) of the records without a session id, cut as sessionize cuts them.

    A pause of more than gap microseconds starts a session; Spark's session windows end at the gap, hence one microsecond more.
    """
    plain = records.where("ts is not null and session_id = ''")
    found = _timed(plain, late).groupBy(F.session_window("at", f"{gap + 1} microseconds").alias("w"), *SCOPE).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), *_sums())
    return found.drop("w")
