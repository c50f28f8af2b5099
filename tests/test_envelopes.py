"""Chat completion and generate-content conversations, taken apart and measured."""

import json

import pytest

from tests.test_reconstruct import COLUMNS
from tracewell.operators import reconstruct


def records(spark, rows, provider, model):
    made = [("20240301", provider, "s", None, i * 1000, i, f"r{i}", model, 100 + i, 50, 1, 2, json.dumps(asked), json.dumps(answered) if answered is not None else None, 70 + i) for i, (asked, answered) in enumerate(rows, 1)]
    return spark.createDataFrame(made, COLUMNS + ", latency_ms long")


def by_index(df):
    return {r.turn_index: r for r in reconstruct.turns(df).collect()}


CHAT = [
    {"role": "system", "content": "be brief"},
    {"role": "developer", "content": [{"type": "text", "text": "and kind"}]},
    {"role": "user", "content": [{"type": "text", "text": "what is it"}, {"type": "image_url", "image_url": {"url": "data:image/gif;base64,QUJDRA=="}}, {"type": "image_url", "image_url": {"url": "https://x.test/p.png"}}]},
    {"role": "assistant", "content": "let me look", "tool_calls": [{"id": "c1", "type": "function", "function": {"name": "find", "arguments": '{"z": 1, "a": [2]}'}}]},
    {"role": "tool", "tool_call_id": "c1", "content": [{"type": "text", "text": "one"}, {"type": "image_url", "image_url": {"url": "u"}}]},
    {"role": "assistant", "content": None},
]


def test_chat_completions(spark):
    tools = [{"type": "function", "function": {"name": "find", "description": "d", "parameters": {"y": 1, "b": 2}}}]
    first = {"choices": [{"message": {"role": "assistant", "content": "let me look"}, "finish_reason": "tool_calls"}], "usage": {"prompt_tokens": 9, "completion_tokens": 0, "prompt_tokens_details": {"cached_tokens": 4}}}
    call = {"choices": [{"message": {"content": "a cat", "function_call": {"name": "old", "arguments": "not json"}}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 30, "completion_tokens": 6}}
    df = records(spark, [({"messages": CHAT[:3]}, first), ({"messages": CHAT, "tools": tools}, call), ({"messages": []}, first)], "azure", "gpt")
    main = reconstruct.threads(df).first()
    assert main.system_prompt == "be brief\n\nand kind" and [t.asDict() for t in main.tools] == [{"name": "find", "description": "d", "input_schema": '{"b":2,"y":1}'}]
    got = by_index(df)
    assert [(i, got[i].role) for i in sorted(got)] == [(0, "user"), (1, "assistant"), (2, "user"), (3, "assistant")]
    assert json.loads(got[0].blocks) == [{"type": "text", "text": "what is it"}, {"type": "media", "mime_type": "image/gif", "inline": True, "byte_size": 4}, {"type": "media", "file_uri": "https://x.test/p.png"}]
    assert json.loads(got[1].blocks) == [{"type": "text", "text": "let me look"}, {"type": "tool_use", "tool_id": "c1", "tool_name": "find", "tool_input": '{"a":[2],"z":1}'}]
    assert json.loads(got[2].blocks) == [{"type": "tool_result", "tool_id": "c1", "result_content": "one\n[image]"}]
    assert json.loads(got[3].blocks) == [{"type": "text", "text": "a cat"}, {"type": "tool_use", "tool_name": "old", "tool_input": "not json"}]
    assert (got[1].request_id, got[1].input_tokens, got[1].output_tokens, got[1].cache_read_tokens, got[1].latency_ms, got[1].stop_reason) == ("r1", 9, 50, 4, 71, "tool_calls")
    assert (got[3].request_id, got[3].input_tokens, got[3].output_tokens, got[3].cache_read_tokens, got[3].stop_reason) == ("r2", 30, 6, 1, "stop")
    calls = reconstruct.tool_calls(reconstruct.turns(df)).where("tool_id <> ''").collect()
    assert [(c.tool_name, c.called_at, c.answered_at, c.result, c.is_error) for c in calls] == [("find", 1, 2, "one\n[image]", False)]


def test_streamed_chat_completions(spark):
    delta = lambda **d: {"choices": [{"delta": d}]}
    chunks = [{"choices": []}, delta(content="he"), delta(tool_calls=[{"index": 2, "id": "y", "function": {"name": "late", "arguments": "[1,"}}]), delta(content="llo"), delta(tool_calls=[{"id": "x", "function": {"name": "early", "arguments": ""}}, {"index": 2, "function": {"arguments": "2]"}}]), {"choices": [{"delta": {}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 5}}]
    got = by_index(records(spark, [({"messages": CHAT[2:3]}, chunks)], "azure", "gpt"))
    assert json.loads(got[1].blocks) == [{"type": "text", "text": "hello"}, {"type": "tool_use", "tool_id": "x", "tool_name": "early"}, {"type": "tool_use", "tool_id": "y", "tool_name": "late", "tool_input": "[1,2]"}]
    assert (got[1].input_tokens, got[1].stop_reason) == (101, "")
    assert set(by_index(records(spark, [({"messages": CHAT[2:3]}, [{"choices": []}])], "azure", "gpt"))) == {0}


CONTENTS = [
    {"role": "user", "parts": [{"text": "see "}, {"text": "this"}, {"inlineData": {"mimeType": "image/png", "data": "QUJD"}}, {"text": "and"}, {"fileData": {"mimeType": "video/mp4", "fileUri": "gs://b/v"}}]},
    {"role": "model", "parts": [{"text": "hm ", "thought": True}, {"text": ""}, {"text": "so", "thought": True}, {"text": "calling"}, {"functionCall": {"name": "f", "args": {"q": 1, "c": 2}}}]},
    {"parts": [{"functionResponse": {"name": "f", "response": {"ok": True}}}]},
]


@pytest.mark.parametrize("streamed", [False, True])
def test_generate_content(spark, streamed):
    part = lambda *p: {"content": {"parts": list(p)}}
    usage = {"promptTokenCount": 12, "candidatesTokenCount": 8, "cachedContentTokenCount": 3}
    whole = {"candidates": [part({"text": "all "}, {"text": "done"}) | {"finishReason": "STOP"}], "usageMetadata": usage}
    chunks = [{"candidates": [part({"text": "all "})], "usageMetadata": {"promptTokenCount": 1}}, {"candidates": []}, {"candidates": [part({"text": "done"}) | {"finishReason": "STOP"}], "usageMetadata": usage}]
    asked = {"contents": CONTENTS, "systemInstruction": {"parts": [{"text": "be"}, {"text": ""}, {"text": "quick"}]}, "tools": [{"functionDeclarations": [{"name": "f", "parameters": {"t": 1}}, {"name": "g"}]}]}
    df = records(spark, [({"contents": CONTENTS[:1]}, whole), (asked, chunks if streamed else whole)], "vertex", "gemini-pro")
    main = reconstruct.threads(df).first()
    assert main.system_prompt == "be\n\nquick" and [(t.name, t.input_schema) for t in main.tools] == [("f", '{"t":1}'), ("g", None)]
    got = by_index(df)
    assert [got[i].role for i in range(4)] == ["user", "assistant", "user", "assistant"]
    assert json.loads(got[0].blocks) == [{"type": "text", "text": "see this"}, {"type": "media", "mime_type": "image/png", "inline": True, "byte_size": 3}, {"type": "text", "text": "and"}, {"type": "media", "mime_type": "video/mp4", "file_uri": "gs://b/v"}]
    assert json.loads(got[1].blocks) == [{"type": "thinking", "text": "hm so"}, {"type": "text", "text": "calling"}, {"type": "tool_use", "tool_name": "f", "tool_input": '{"c":2,"q":1}'}]
    assert json.loads(got[2].blocks) == [{"type": "tool_result", "tool_id": "f", "result_content": '{"ok":true}'}]
    assert json.loads(got[3].blocks) == [{"type": "text", "text": "all done"}]
    assert (got[3].request_id, got[3].input_tokens, got[3].output_tokens, got[3].cache_read_tokens, got[3].latency_ms, got[3].stop_reason) == ("r2", 12, 8, 3, 72, "STOP")
    assert got[1].request_id == "r1" and got[1].has_metrics and not got[2].has_metrics


def test_deferred_and_empty(spark):
    df = records(spark, [({"contents": CONTENTS}, None)], "vertex", "claude-x")
    assert reconstruct.turns(df).collect() == []
    got = by_index(records(spark, [({"contents": CONTENTS}, {"candidates": []})], "vertex", "gemini-pro"))
    assert set(got) == {0, 1, 2}
