import json
import tempfile

import pytest
from pyspark.sql import functions as F

from tracewell.operators import reconstruct
from tracewell.plans import adapters

COLUMNS = "day string, provider string, session_id string, thread_id string, ts long, n long, request_id string, model_id string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, input_body string, output_body string"


def message(role, content):
    return {"role": role, "content": content}


def body(*messages, **more):
    return json.dumps({"messages": list(messages)} | more)


ASK = message("user", "hi")
CALL = message("assistant", [{"type": "text", "text": "look"}, {"type": "tool_use", "id": "t1", "name": "read", "input": {"b": 1.5, "a": [2]}}])
RESULT = message("user", [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}, {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "dHJhY2U="}}, {"type": "odd", "content": {"k": 1}}])
STREAM = [
    {"type": "message_start", "message": {"usage": {"cache_read_input_tokens": 7}}},
    {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "lost"}},
    {"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "id": "t2", "name": "run"}},
    {"type": "content_block_start", "index": 0, "content_block": {"type": "text"}},
    {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "do"}},
    {"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": "{\"z\":1,"}},
    {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "ne"}},
    {"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": "\"a\":2}"}},
    {"type": "message_delta", "delta": {"stop_reason": "tool_use"}},
    {"type": "message_stop", "amazon-bedrock-invocationMetrics": {"invocationLatency": 900, "firstByteLatency": 100, "cacheReadInputTokenCount": 0, "cacheWriteInputTokenCount": 3}},
]
PLAIN = json.dumps({"role": "assistant", "content": [{"type": "text", "text": "ok"}], "stop_reason": "end_turn", "usage": {"cache_read_input_tokens": 4}})


@pytest.fixture
def turns(spark):
    row = lambda n, thread, asked, answered, session="s", provider="bedrock": ("20240115", provider, session, thread, n * 1000, n, f"r{n}", "m", 10 + n, 5, 1, 2, asked, answered)
    rows = [
        row(1, "a", body(ASK), PLAIN),
        row(2, "a", body(ASK, CALL, RESULT, system=[{"type": "text", "text": "be"}, {"type": "text", "text": "kind"}], tools=[{"name": "read", "input_schema": {"q": 1, "p": 2}}]), json.dumps(STREAM)),
        row(3, "a", body(ASK, CALL, RESULT), None),
        row(4, "a", '{"messages": "no"}', "junk"),
        row(5, "b", body(message("user", None), {"role": "assistant"}, message("user", "")), "[]"),
        row(6, None, "", "", "broken"), row(7, "x", body(ASK), PLAIN, "broken"), row(8, "", body(ASK), PLAIN, ""), row(9, "", body(ASK), PLAIN, "o", "azure"), row(10, "", body(ASK), None, "null answer"),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    return df, {(r.session_id, r.thread_id, r.turn_index): r for r in reconstruct.turns(df).collect()}


def test_turns(turns):
    _, got = turns
    assert set(got) == {("s", "", i) for i in range(4)} | {("s", "b", i) for i in range(3)} | {("null answer", "", 0), ("o", "", 0)}
    roles = [got["s", "", i].role for i in range(4)]
    assert roles == ["user", "assistant", "user", "assistant"] and got["s", "", 1].text == "look"
    assert json.loads(got["s", "", 1].blocks)[1] == {"type": "tool_use", "tool_id": "t1", "tool_name": "read", "tool_input": '{"a":[2],"b":1.5}'}
    assert json.loads(got["s", "", 2].blocks) == [{"type": "tool_result", "tool_id": "t1", "is_error": True, "result_content": "x\ny"}, {"type": "media", "mime_type": "image/png", "inline": True, "byte_size": 5}, {"type": "odd", "text": '{"k":1}'}]
    assert json.loads(got["s", "", 3].blocks) == [{"type": "text", "text": "done"}, {"type": "tool_use", "tool_id": "t2", "tool_name": "run", "tool_input": '{"a":2,"z":1}'}]
    assert [json.loads(got["s", "b", i].blocks) for i in range(3)] == [[], [{"type": "text"}], []]


def test_metrics(turns):
    _, got = turns
    last, first = got["s", "", 3], got["s", "", 1]
    assert (last.request_id, last.latency_ms, last.first_byte_ms, last.cache_read_tokens, last.cache_write_tokens, last.stop_reason) == ("r2", 900, 100, 1, 3, "tool_use")
    assert (first.request_id, first.input_tokens, first.cache_read_tokens, first.stop_reason, first.ts) == ("r1", 11, 4, "end_turn", 1000)
    assert not got["s", "", 0].has_metrics and got["s", "", 0].ts == 0 and not got["s", "b", 1].has_metrics


def test_threads(turns):
    df, _ = turns
    main = reconstruct.threads(df).where("session_id = 's' and is_main").first()
    assert main.system_prompt == "be\n\nkind" and main.tools[0].asDict() == {"name": "read", "description": "", "input_schema": '{"p":2,"q":1}'}


def test_no_records(spark):
    assert reconstruct.turns(spark.createDataFrame([], COLUMNS).withColumn("extra", F.lit(1))).collect() == []


def test_tool_calls_make_turns_once(spark, tiny):
    """Calls and results are read from one table, so the turns' bodies stand in neither's plan."""
    from tracewell.plans import catalog

    plan = catalog.tool_results(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "customer" not in plan and "c_custkey" not in plan and plan.count("from_json") == 0


def test_no_side_that_grows_is_gathered_on_the_driver(spark, monkeypatch):
    """Tool calls of many conversations, whose tables are small as files: neither what is written nor the result broadcasts."""
    customers = spark.range(3000).select(F.col("id").alias("c_custkey"), F.lit("T").alias("c_mktsegment"), F.lit(1).alias("c_nationkey"), F.lit("n").alias("c_name"))
    plans = []

    def written(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, label)

    kept = reconstruct.written
    monkeypatch.setattr(reconstruct, "written", written)
    with tempfile.TemporaryDirectory() as place:
        customers.write.parquet(f"{place}/customer.parquet")
        calls = reconstruct.tool_calls(reconstruct.turns(adapters.tool_bodies(spark, place), ("openai",)))
        plans.append(calls._jdf.queryExecution().executedPlan().toString())
        assert calls.count() == 3000 and calls.where("answered_at = 2").count() == 3000 - 429
    assert len(plans) == 3 and not any("BroadcastExchange" in p for p in plans)
