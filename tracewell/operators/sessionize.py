"""Conversations from invocations: by session id within a UTC day, else by gaps of one principal's calls of one model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracewell.functions.text import stable_id

#: A gap of more than this many microseconds starts a new conversation.
GAP = 5 * 60 * 1_000_000
SCOPE = ("day", "provider", "model_id", "principal")


def _opened(facts: DataFrame, gap: int) -> tuple[DataFrame, Column, WindowSpec]:
    """facts with opened, 1 where a gap precedes; gap_seq of these; and the window of all rows of a scope, in order."""
    by = Window.partitionBy(*SCOPE).orderBy("ts", "n")
    opened = F.when(F.col("ts") - F.lag("ts").over(by) > gap, 1).otherwise(0)
    return facts.withColumn("opened", opened), F.sum("opened").over(by.rowsBetween(Window.unboundedPreceding, 0)), by


def gap_sequence(facts: DataFrame, gap: int = GAP) -> DataFrame:
    """facts with gap_seq, 0 upwards within day, provider, model and principal. One shuffle, on the scope."""
    rows, seq, _ = _opened(facts, gap)
    return rows.withColumn("gap_seq", seq).drop("opened")


def keyed(facts: DataFrame, gap: int = GAP) -> DataFrame:
    """facts with the conversation's key columns is_gap, k1, k2, k3, seq, and started, when one without a session id began (else null)."""
    plain = F.col("session_id") == ""
    rows, seq, by = _opened(facts.where(plain), gap)
    # the last row up to here that a gap precedes, else the scope's first; in the order that rows have already
    last = F.max(F.when(F.col("opened") == 1, F.col("ts"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    started = F.coalesce(last, F.min("ts").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    scoped = rows.select("*", F.lit(1).alias("is_gap"), F.col("model_id").alias("k1"), F.col("principal").alias("k2"), seq.cast("long").alias("seq"), started.alias("started")).drop("opened")
    named = facts.where(~plain).select("*", F.lit(0).alias("is_gap"), F.col("session_id").alias("k1"), F.lit("").alias("k2"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("long").alias("started"))
    return scoped.unionByName(named)


KEY = ("day", "is_gap", "provider", "k1", "k2", "seq")


def conversations(facts: DataFrame, gap: int = GAP) -> DataFrame:
    """A row per conversation: counts, token sums, errors, span, and the first call's model and principal."""
    return gathered(keyed(facts, gap))


def gathered(keyed: DataFrame) -> DataFrame:
    """conversations of keyed facts."""
    made = keyed.groupBy(*KEY).agg(
        F.count("*").alias("invocations"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cache_read_tokens").alias("cache_read_tokens"), F.sum("cache_write_tokens").alias("cache_write_tokens"), F.count_if(F.col("error_code") != "").alias("errors"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.min_by(F.struct("session_id", "model_id", "principal"), F.struct("ts", "n")).alias("first"),
    )
    return made.select(*(c for c in made.columns if c != "first"), "first.*")


def conversation_id(start) -> Column:
    """The session id, else a hash of what the conversation is of and when it began."""
    at = F.date_format(F.timestamp_micros(start), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return stable_id(F.col("session_id"), F.col("provider"), F.col("model_id"), F.col("principal"), at).alias("conversation_id")


def with_ids(convs: DataFrame) -> DataFrame:
    """conversations with display_id (numbered over all days, sessions before gap groups) and conversation_id.

    Numbers are a day's offset plus the rank in the day, so no task orders more than a day; the offsets' window has a row per day.
    """
    days = convs.groupBy("day").agg(F.count("*").alias("in_day"))
    days = days.select("day", (F.sum("in_day").over(Window.orderBy("day")) - F.col("in_day")).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(*KEY[1:]))
    numbered = convs.withColumn("rank", rank).join(days, "day")
    return numbered.select("*", F.concat_ws("-", F.lit("conv"), "day", (F.col("offset") + F.col("rank") - 1).cast("string")).alias("display_id"), conversation_id("start_ts")).drop("rank", "offset")
