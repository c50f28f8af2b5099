"""Streams against the batch operators on the same invocations."""

from pyspark.sql import functions as F

from tracewell.operators import sessionize
from tracewell.plans.adapters import facts
from tracewell.streaming import sessions


def drained(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete" if name == "days" else "append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def test_streams_equal_batches(spark, tiny, tmp_path):
    known = facts(spark, tiny).orderBy("ts")
    path = f"{tmp_path}/in"
    # a last record closes all sessions before it
    last = known.limit(1).withColumn("ts", F.lit(2_000_000_000_000_000)).withColumn("day", F.lit("20330518"))
    known.coalesce(1).write.parquet(path)
    last.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    got = {r.day: (r.invocations, r.input_tokens, r.errors) for r in drained(sessions.day_stats(stream), "days").collect()}
    want = known.groupBy("day").agg(F.count("*"), F.sum("input_tokens"), F.count_if(F.col("error_code") != "")).collect()
    assert {k: v for k, v in got.items() if k != "20330518"} == {r[0]: tuple(r)[1:] for r in want}
    found = drained(sessions.gap_sessions(stream), "gaps").where("day <> '20330518'")
    batch = sessionize.conversations(known).where("is_gap = 1")
    columns = [*sessionize.SCOPE, "start_ts", "end_ts", "invocations", "output_tokens"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))
