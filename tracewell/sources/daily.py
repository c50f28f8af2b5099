"""Exports that grow by days: tables in a folder per day, and partial aggregates per day that are merged when they are read.

update() replaces the days that its records have and leaves all others alone, so a day can be exported again, and days can
come one by one or many at once with the same result. Sums of a day are small; what can't be summed (how many sessions and
threads, how long outputs are) is kept as mergeable sketches: HyperLogLog and KLL. So totals over any days, and over several
exports, read the days table alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.envelopes import family
from tracewell.operators import reconstruct, sessionize
from tracewell.sources import export
from tracewell.sources.scratch import written

TABLES = ("facts", "conversations", "turns", "days")
#: Size of the sketches: HyperLogLog of 2**LG_K registers (relative error 1.04 / sqrt(2**LG_K), 0.8 %, at one deviation), KLL of K (rank error some 1.3 / K, 0.33 %).
LG_K, K = 14, 400
BREAKDOWNS = ("model_id", "operation")


def partials(records: DataFrame) -> DataFrame:
    """A row per day of completed records: sums, counts by model and operation, and the sketches."""
    key = F.concat_ws("\0", "provider", "session_id")
    sums = records.groupBy("day").agg(
        F.count("*").alias("invocations"), *(F.sum(c).alias(c) for c in export.SUMS if c not in ("invocations", "errors")), F.count_if(F.col("error_code") != "").alias("errors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.hll_sketch_agg(F.when(F.col("session_id") != "", key), LG_K).alias("sessions"), F.hll_sketch_agg(F.when(F.col("session_id") != "", F.concat_ws("\0", key, "thread_id")), LG_K).alias("threads"), F.kll_sketch_agg_bigint("output_tokens", K).alias("outputs"),
    )
    for c in BREAKDOWNS:
        each = records.groupBy("day", F.coalesce(c, F.lit("")).alias("name")).agg(F.count("*").alias("n"))
        sums = sums.join(each.groupBy("day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias(f"by_{c}")), "day")
    return sums


def update(records: DataFrame, path: str) -> None:
    """Writes the days of records (columns of the readers) to the export at path, in place of what it has of these days.

    records must hold a day whole. facts and conversations are those of export.write, without file names and display
    ids, which count over a whole run; turns are written if records have bodies. records are read once; those without a day
    are left out.
    """
    records = written(export._completed(records), "records")
    names = [c for c in export.FACTS if c != "conversation_id"]
    keyed = written(sessionize.keyed(records.where("day is not null").select(*dict.fromkeys(("day", "ts", "n", *names)))), "keyed")
    convs = written(sessionize.gathered(keyed).select("*", sessionize.conversation_id("start_ts")), "conversations")
    # the option holds for this write alone
    save = lambda df, name, *order, last=lambda x: x: last(df.repartitionByRange("day", *order).sortWithinPartitions("day", *order)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("day").parquet(f"{path}/{name}.parquet")
    # a record names its conversation by itself, without a join, after it is dealt: what deals them reads records twice
    named = lambda df: df.select("day", sessionize.conversation_id("started"), *names)
    save(keyed.select("day", "started", *names), "facts", "timestamp", "request_id", "request_uuid", last=named)
    save(convs.select("day", "conversation_id", "provider", "model_id", "session_id", "principal", "start_ts", "end_ts", *export.SUMS), "conversations", "start_ts", "conversation_id")
    if {"input_body", "output_body"} <= set(records.columns):
        kinds = tuple(r[0] for r in records.select(family(F.col("provider"), F.col("model_id"))).distinct().collect() if r[0] in reconstruct.ENVELOPES)
        save(reconstruct.turns(records, kinds or ("anthropic",)), "turns", "provider", "session_id", "thread_id", "turn_index")
    counts = convs.groupBy("day").agg(F.count("*").alias("conversations"))
    save(partials(records).join(counts, "day"), "days")


def read(spark: SparkSession, path: str, table: str = "facts") -> DataFrame:
    """A table of an export, or of all exports that a pattern names."""
    if table not in TABLES:
        raise ValueError(f"no table {table!r}")
    # a day is text, though it looks like a number
    return spark.read.option("basePath", path if "*" not in path else path.split("*")[0]).parquet(f"{path}/{table}.parquet").withColumn("day", F.col("day").cast("string"))


def totals(days: DataFrame) -> DataFrame:
    """One row of days (a days table, or any part or union of such): sums, breakdowns, estimates of distinct sessions and threads, and p50, p90, p99 of output tokens.

    The estimates have the error of the sketches, whatever the number of days.
    """
    share = lambda p: F.kll_sketch_get_quantile_bigint("outputs", F.lit(p))
    merged = days.agg(F.count_distinct("day").alias("days"), *(F.sum(c).alias(c) for c in ("conversations", *export.SUMS)), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), *(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("sessions", "threads")), F.kll_merge_agg_bigint("outputs", K).alias("outputs"))
    out = merged.select(*(c for c in merged.columns if c != "outputs"), *(share(p).alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.99)))
    for c in BREAKDOWNS:
        # models and operations are few
        each = days.select(F.explode(f"by_{c}").alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))
        out = out.crossJoin(each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias(f"by_{c}")))
    return out
