import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions.envelopes import valid_json
from tracewell.operators import sessionize
from tracewell.sources import azure, vertex

RESOURCE = "/SUBSCRIPTIONS/sub-1/resourceGroups/rg-1/providers/x"
ASKED = {"user": "u_session_s1", "messages": [{"role": "user", "content": "hi"}]}
ANSWER = {"usage": {"prompt_tokens": 20, "completion_tokens": 3, "prompt_tokens_details": {"cached_tokens": 5}}}


def line(request, time, properties, **more):
    return json.dumps({"time": time, "resourceId": RESOURCE, "operationName": "Chat", "category": "RequestResponse", "resultSignature": "200", "durationMs": 12.7, "correlationId": request, "callerIpAddress": "1.2.3.4", "properties": properties} | more)


@pytest.fixture
def logs(tmp_path):
    props = {"requestBody": json.dumps(ASKED), "RESPONSEBODY": ANSWER, "modelDeploymentName": "gpt", "oid": "caller"}
    files = {
        "y=2024/m=01/d=15/h=10/m=00/PT1H.json": [line("a", "2024-01-15T10:00:00Z", props), "", "junk", "[1]", line("other", "2024-01-15T10:00:00Z", {}, category="Audit"), line("timeless", None, {}), line("late", "2024-01-16T00:00:00Z", {})],
        "y=2024/m=01/d=17/h=00/m=00/PT1H.json": [line("pruned", "2024-01-15T11:00:00Z", {})],
        "loose.json": [line("b", "2024-01-15T12:00:00Z", json.dumps({"input": "no json", "response": {"error": {"code": "limit"}}}), resultSignature="429", durationMs=None), line("c", "2024-01-15T12:30:00Z", None, resultSignature="500", category="")],
    }
    for path, lines in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("\n".join(lines))
    return str(tmp_path)


def test_resource_logs(spark, logs):
    got = {r.request_id: r for r in azure.read_storage(spark, logs, "2024-01-15", "2024-01-15").collect()}
    assert set(got) == {"a", "b", "c"}
    a = got["a"]
    assert (a.session_id, a.input_tokens, a.output_tokens, a.cache_read_tokens, a.latency_ms, a.model_id, a.principal, a.error_code) == ("s1", 20, 3, 5, 12, "gpt", "caller", "")
    assert a.extra == {"subscription": "sub-1", "resourceGroup": "rg-1", "callerIp": "1.2.3.4"} and json.loads(a.input_body) == ASKED
    assert (got["b"].error_code, got["b"].latency_ms, got["b"].input_body, got["c"].error_code, got["c"].output_body) == ("limit", 0, '"no json"', "HTTP 500", "")


def test_log_table(spark):
    rows = [("2024-01-15T10:00:00.5Z", "q", "9", "429", "Fallback", json.dumps({"input": {"user": "x"}})), (None, "", None, None, None, None), (None, "kept", None, None, None, "[]")]
    df = spark.createDataFrame(rows, "TimeGenerated string, CorrelationId string, DurationMs string, ResultSignature string, ResourceGroup string, properties_s string")
    got = {r.request_id: r for r in azure.from_table(df).collect()}
    assert set(got) == {"q", "kept"} and got["q"].error_code == "HTTP 429" and got["q"].extra == {"resourceGroup": "Fallback"} and got["q"].latency_ms == 9 and got["kept"].ts is None
    assert azure.from_table(df, resource="nowhere").count() == 0 and azure.from_table(df, "2024-01-15").count() == 1


def test_vertex(spark):
    t = dt.datetime(2024, 1, 15, 10, 0, 0, 5)
    usage = lambda *n: json.dumps({"usageMetadata": dict(zip(("promptTokenCount", "candidatesTokenCount", "cachedContentTokenCount"), n, strict=True))})
    asked = json.dumps({"systemInstruction": {"parts": [{"text": "be kind"}, {"text": "id u_session_s9"}]}, "contents": []})
    rows = [
        ("projects/p/locations/l/models/gemini-x", None, t, "7", [asked[:20], asked[20:]], [usage(1, 2, 3), "junk", usage(4, 5, 6), usage(0, 0, 0)]),
        (None, "dep", t, "0", ["{}", "tail"], ['{"error": {"code": 429}}']), (None, None, None, None, None, None), (None, None, t, "", [], ["junk", "more"]), ("x", "claude", t, "e", [json.dumps({"metadata": {"user_id": "_session_q"}})], ['[{"error": {"status": "BUSY", "code": 1}}]']),
    ]
    df = spark.createDataFrame(rows, "endpoint string, deployed_model_id string, logging_time timestamp, request_id string, request_payload array<string>, response_payload array<string>")
    got = {r.request_id: r for r in vertex.records(df).collect()}
    a = got["7"]
    assert (a.model_id, a.session_id, a.input_tokens, a.output_tokens, a.cache_read_tokens, a.operation, a.extra["project"], a.extra["location"]) == ("gemini-x", "s9", 4, 5, 6, "streamGenerateContent", "p", "l")
    assert json.loads(a.output_body)[1] == json.loads(usage(4, 5, 6)) and a.input_body == asked
    b = got["dep-20240115T100000.000005000Z"]
    assert (b.error_code, b.input_body, b.operation) == ("HTTP 429", "{}", "generateContent")
    assert got["vertex-20240115T100000.000005000Z"].output_body == "junk" and got["e"].error_code == "BUSY" and got["e"].session_id == "q" and len(got) == 4
    assert vertex.missing_usage(vertex.records(df)).first()[0] == 3 and vertex.records(df, "2024-01-16").count() == 0
    assert {r.session_id for r in sessionize.conversations(vertex.records(df)).collect()} == {"s9", "q", ""}


def test_identifiers(spark):
    with pytest.raises(ValueError):
        vertex.table(spark, "a", "b`; drop")


def test_json_validity(spark):
    cases = {"{}": True, " [1] ": True, "null": True, '"x"': True, "{}tail": False, "{}{}": False, "1,2": False, '1,"w":2': False, "1],[2": False, "": False, None: False}
    got = spark.createDataFrame([(c,) for c in cases], "x string").select("x", valid_json(F.col("x"))).collect()
    assert dict(map(tuple, got)) == cases


def test_property_bags_are_parsed_once(spark, tiny):
    """The filter on bodies names them, and does not stand in the plan with their making written out."""
    from tracewell.plans import readers

    made = readers.azure_table_records(spark, tiny)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("JsonToStructs") <= 4


def test_names_equal_but_for_case_and_other_bags(spark):
    from tracewell.sources import azure

    texts = ['{"b": 1, "A": "x", "a": "y"}', ' {"k": {"z": 1, "a": null}}', "{}", "", "[1]", '"s"', None, "{broken"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(azure.bag(F.col("t"))).collect()
    assert [r[0] for r in got] == [{"a": '"x"', "b": "1"}, {"k": '{"a":null,"z":1}'}, {}, {}, {}, {}, {}, {}]
