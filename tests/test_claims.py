"""Claims by time against one walk over all rows, with small blocks, at several rates."""

import random

import pandas as pd
import pytest

from tracewell.operators import claims, pairing

MINUTE = 60_000_000


def frames(spark, asked, given):
    columns = "mtime long, model string, {} string"
    return spark.createDataFrame(asked, columns.format("uuid")), spark.createDataFrame(given, columns.format("message_id"))


def walked(asked, given):
    rows = [(t, m, u, None) for t, m, u in asked] + [(t, m, None, r) for t, m, r in given]
    return sorted(map(tuple, pairing._claim(pd.DataFrame(rows, columns=["mtime", "model", "uuid", "message_id"])).values.tolist()))


def traffic(rng, requests, responses, minutes, models):
    at = lambda: rng.randrange(minutes * MINUTE) // 1000 * 1000
    return [(at(), rng.choice(models), f"u{i:05}") for i in range(requests)], [(at(), rng.choice(models), f"r{i:05}") for i in range(responses)]


@pytest.mark.parametrize(("requests", "responses", "minutes"), [(400, 400, 3000), (400, 400, 300), (900, 300, 60), (300, 900, 60), (500, 500, 12), (50, 0, 5)])
def test_equals_one_walk(spark, monkeypatch, requests, responses, minutes):
    monkeypatch.setattr(claims, "BLOCK", 7)
    monkeypatch.setattr(claims, "SUPER", 3)
    asked, given = traffic(random.Random(requests + minutes), requests, responses, minutes, ("m", "n"))
    # a backlog that never clears: as many responses as requests, all of them late
    asked += [(k * MINUTE, "steady", f"s{k:05}") for k in range(minutes)]
    given += [(k * MINUTE + 9 * MINUTE, "steady", f"t{k:05}") for k in range(minutes)]
    assert sorted(map(tuple, pairing.by_time(*frames(spark, asked, given)).collect())) == walked(asked, given)


def test_unknown_models_fit_any(spark):
    asked, given = traffic(random.Random(7), 200, 200, 600, ("m", "n", ""))
    asked += [(10**12 + k * MINUTE, "m", f"v{k}") for k in range(20)]
    given += [(10**12 + k * MINUTE, "m", f"w{k}") for k in range(20)]
    assert sorted(map(tuple, pairing.by_time(*frames(spark, asked, given)).collect())) == walked(asked, given)


def test_ties_and_the_ends_of_the_window(spark):
    asked = [(0, "m", "a"), (0, "m", "b"), (5, "m", "c")]
    for given in ([(0, "m", "x")], [(0, "m", "y"), (0, "m", "x")], [(pairing.WINDOW, "m", "x"), (pairing.WINDOW + 1, "m", "y"), (pairing.WINDOW + 5, "m", "z")], [(4, "m", "x"), (5, "m", "y"), (5, "o", "z")]):
        assert sorted(map(tuple, pairing.by_time(*frames(spark, asked, given)).collect())) == walked(asked, given)


def test_groups_are_bounded(spark, monkeypatch):
    """A dense stretch of one model: no group of requests is over a block."""
    monkeypatch.setattr(claims, "BLOCK", 50)
    asked, given = frames(spark, *traffic(random.Random(1), 3_000, 3_000, 30, ("m",)))
    numbered, _ = claims._numbered(asked.withColumnRenamed("model", "kind"), given.withColumnRenamed("model", "kind"), pairing.WINDOW)
    sizes = [r["count"] for r in numbered.selectExpr(f"floor(k / {claims.BLOCK}) AS block").groupBy("block").count().collect()]
    assert max(sizes) <= 50 and sum(sizes) == 3_000


def test_functions_compose():
    rng = random.Random(3)

    def direct(u, requests):
        for low, high in requests:
            u = max(u + 1, low) if low <= high and max(u + 1, low) <= high else u
        return u

    def function(requests):
        f = [(requests[0][0] - 1, requests[0][0] - 1, 1)]
        for low, high in requests:
            f = claims.claimed(f, low, high)
        return f

    for _ in range(500):
        low, high, requests = 0, 0, []
        for _ in range(rng.randrange(2, 12)):
            low += rng.randrange(3)
            high = max(high, low - 1 + rng.randrange(5))
            requests.append((low, high))
        cut = rng.randrange(1, len(requests))
        f = claims.composed(function(requests[:cut]), function(requests[cut:]))
        for u in range(-1, requests[0][1] + 1):
            first = direct(max(u, requests[0][0] - 1), requests[:cut])
            assert claims.value_at(f, u) == direct(max(first, requests[cut][0] - 1), requests[cut:])


def test_empty(spark):
    assert pairing.by_time(*frames(spark, [], [])).collect() == []


def test_functions_of_dense_blocks_have_three_pieces():
    """Windows of hundreds of responses, as many asked for as given: a block's function and a composition stay small."""
    rng, low, high, blocks = random.Random(11), 0, 400, []
    for _ in range(6):
        requests = []
        for _ in range(800):
            low += rng.randrange(3)
            high = max(high, low - 1) + rng.randrange(3)
            requests.append((low, high))
        f = [(requests[0][0] - 1, requests[0][0] - 1, 1)]
        for at in requests:
            f = claims.claimed(f, *at)
        assert len(f) <= 3
        blocks.append((requests, f))
    for start in (-1, 5, 250, 400):
        u, whole = start, blocks[0][1]
        for requests, f in blocks:
            whole = whole if f is blocks[0][1] else claims.composed(whole, f)
            for first, last in requests:
                u = max(u + 1, first) if first <= last and max(u + 1, first) <= last else u
            assert len(whole) <= 3 and claims.value_at(whole, start) == u


@pytest.mark.parametrize("models", [("m",), ("m", "n")])
def test_dense_traffic_equals_one_walk(spark, monkeypatch, models):
    """Windows hold many times a block, for one model and for two."""
    monkeypatch.setattr(claims, "BLOCK", 40)
    monkeypatch.setattr(claims, "SUPER", 4)
    asked, given = traffic(random.Random(len(models)), 3_000, 3_000, 45, models)
    assert sorted(map(tuple, pairing.by_time(*frames(spark, asked, given)).collect())) == walked(asked, given)
    numbered, _ = claims._numbered(*(x.withColumnRenamed("model", "kind") for x in frames(spark, asked, given)), pairing.WINDOW)
    for _, rows in numbered.toPandas().assign(block=lambda x: x["k"] // 40).groupby(["kind", "block"]):
        assert len(claims._function(rows)["f"].iloc[0]) <= 3


def most_read(spark, run):
    """run's result, and the most rows that one task of it read from a shuffle."""
    sc = spark.sparkContext
    sc.setJobGroup("most_read", "")
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store, tracker, most = sc._jsc.sc().statusStore(), sc.statusTracker(), 0
    for stage in {s for job in tracker.getJobIdsForGroup("most_read") for s in tracker.getJobInfo(job).stageIds}:
        tasks = store.taskList(stage, 0, 1_000)
        metrics = [tasks.apply(i).taskMetrics() for i in range(tasks.size())]
        most = max([most, *(m.get().shuffleReadMetrics().recordsRead() for m in metrics if m.isDefined())])
    return out, most


@pytest.mark.parametrize("unknown", [0, 1])
def test_no_task_sees_all_slots(spark, monkeypatch, unknown):
    """A long time with few rows a slot: no task reads even half of its slots, also where a model is unknown."""
    for name, value in (("SPAN", 64), ("BLOCK", 50), ("SUPER", 4)):
        monkeypatch.setattr(claims, name, value, raising=False)
    asked = [(k * 20 * MINUTE, "m", f"u{k:05}") for k in range(6_000)]
    given = [(k * 20 * MINUTE + MINUTE, "m", f"r{k:05}") for k in range(0, 6_000, 2)]
    given += [(7 * MINUTE + k * 20 * MINUTE, "", f"x{k:05}") for k in range(4_001, 4_001 + unknown)]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs, most = most_read(spark, lambda: pairing.by_time(*frames(spark, asked, given)).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sorted(map(tuple, pairs)) == walked(asked, given)
    slots = len({t // claims.SLOT for t, _, _ in [*asked, *given, *((t + pairing.WINDOW, "", "") for t, _, _ in asked)]})
    assert 0 < most < slots / 2
