"""Exports day by day against one batch, and merged sketches against exact numbers."""

import re

import pytest
from pyspark.sql import functions as F

from tracewell.operators import sessionize
from tracewell.plans.adapters import facts
from tracewell.sources import daily


@pytest.fixture(scope="module")
def records(spark, tiny):
    days = [r.day for r in facts(spark, tiny).select("day").distinct().orderBy("day").limit(4).collect()]
    return facts(spark, tiny).where(F.col("day").isin(days)).cache(), days


def content(spark, path, table, but=()):
    df = daily.read(spark, path, table)
    return sorted((str(tuple(r)) for r in df.select(*sorted(c for c in df.columns if c not in but)).collect()))


SKETCHES = ("sessions", "threads", "outputs")


def test_days_one_by_one_equal_one_batch(spark, records, tmp_path):
    rows, days = records
    one, many = f"{tmp_path}/one", f"{tmp_path}/many"
    daily.update(rows, one)
    daily.update(rows.where(F.col("day") == days[1]).withColumn("input_tokens", F.lit(10**9)), many)
    for day in (days[0], days[2], days[1]):
        daily.update(rows.where(F.col("day") == day), many)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob(f"many/facts.parquet/day={days[0]}/*.parquet")}
    daily.update(rows.where(F.col("day") == days[3]), many)
    assert before == {p: p.stat().st_mtime_ns for p in tmp_path.glob(f"many/facts.parquet/day={days[0]}/*.parquet")} and before
    for table in ("facts", "conversations", "days"):
        assert content(spark, one, table, SKETCHES) == content(spark, many, table, SKETCHES) != []
    exact = rows.agg(F.count("*").alias("n"), F.sum("input_tokens").alias("tokens"), F.count_distinct("day").alias("days")).first()
    got = daily.totals(daily.read(spark, many, "days")).first()
    assert (got.invocations, got.input_tokens, got.days) == (exact.n, exact.tokens, exact.days) and sum(got.by_operation.values()) == exact.n
    with pytest.raises(ValueError, match="no table"):
        daily.read(spark, many, "bodies")


def test_merged_sketches_are_within_their_bound(spark):
    n = 60_000
    rows = spark.range(n).select(
        F.concat(F.lit("2024010"), (F.col("id") % 7 + 1).cast("string")).alias("day"), F.col("id").alias("ts"), F.lit("p").alias("provider"), F.lit("m").alias("model_id"), F.lit("o").alias("operation"), F.lit("").alias("error_code"),
        (F.col("id") % 20_000).cast("string").alias("session_id"), (F.col("id") % 3).cast("string").alias("thread_id"), F.lit(1).alias("input_tokens"), (F.pmod(F.xxhash64("id"), F.lit(10_000))).alias("output_tokens"), F.lit(0).alias("cache_read_tokens"), F.lit(0).alias("cache_write_tokens"),
    )
    days = daily.partials(rows).withColumn("conversations", F.lit(0))
    got = daily.totals(days.where("day < '20240104'").unionByName(days.where("day >= '20240104'"))).first()
    # five deviations
    bound = 5 * 1.04 / 2 ** (daily.LG_K / 2)
    assert abs(got.sessions - 20_000) <= bound * 20_000 and abs(got.threads - n) <= bound * n
    for p, found in ((0.5, got.p50), (0.9, got.p90), (0.99, got.p99)):
        assert abs(rows.where(F.col("output_tokens") <= found).count() / n - p) <= 0.01


def test_records_are_keyed_once_and_name_their_conversations(spark, records, tmp_path, monkeypatch):
    """One window over records an update; each names the conversation that a join on keys finds."""
    calls, keyed = [], sessionize.keyed
    monkeypatch.setattr(sessionize, "keyed", lambda *args: calls.append(1) or keyed(*args))
    daily.update(records[0], f"{tmp_path}/e")
    assert len(calls) == 1
    ids = sessionize.with_ids(sessionize.conversations(records[0])).select(*sessionize.KEY, "conversation_id")
    want = keyed(records[0]).join(ids, list(sessionize.KEY)).select("day", "request_id", "conversation_id").collect()
    got = daily.read(spark, f"{tmp_path}/e").select("day", "request_id", "conversation_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == records[0].count()
    assert {(r[0], r[2]) for r in got} == {tuple(r) for r in daily.read(spark, f"{tmp_path}/e", "conversations").select("day", "conversation_id").collect()}


def test_a_scope_is_sorted_once_and_json_is_parsed_once(spark, tiny):
    """Gaps and the times at which conversations began come from one order of rows, also where a time is missing."""
    minute = 60_000_000
    times = [(None, 0), (5 * minute, 1), (9 * minute, 2), (9 * minute, 3), (15 * minute, 4), (15 * minute + 1, 5), (40 * minute, 6)]
    rows = spark.createDataFrame([("d", "p", "m", who, t, n, "") for who in ("a", "b") for t, n in times[who == "b" :]] + [("d", "p", "m", "a", 7, 9, "s")], "day string, provider string, model_id string, principal string, ts long, n long, session_id string")
    keyed = sessionize.keyed(rows)
    assert len(re.findall(r"\bSort \[", keyed._jdf.queryExecution().executedPlan().toString())) == 1
    got = keyed.select("is_gap", "k1", "k2", "seq", "ts", "started").collect()
    first = {}
    for r in got:
        if r.ts is not None:
            first[r[:4]] = min(first.get(r[:4], r.ts), r.ts)
    assert len(got) == 14 and all(r.started == (first[r[:4]] if r.is_gap else None) for r in got)
    assert sorted((r.seq, r.ts // minute) for r in got if r.k2 == "b") == [(0, 5), (0, 9), (0, 9), (1, 15), (1, 15), (2, 40)]
    assert facts(spark, tiny).select("session_id")._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 1
