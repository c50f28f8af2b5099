"""Log services, held against a stub that answers over HTTP and notes what it was asked."""

import datetime as dt
import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tracewell.sources import contract, services

DAY = dt.datetime(2024, 1, 15, tzinfo=dt.UTC)
#: A row every 20 minutes of two days.
TIMES = [DAY + dt.timedelta(minutes=20 * i) for i in range(144)]


def _within(times, body):
    """Times in the bounds that a question names."""
    found = re.findall(r"(>=|<) datetime\(([^)]*)\)", body["query"]) or [(">=" if p["name"] == "start" else "<", p["parameterValue"]["value"]) for p in body.get("queryParameters", ())]
    bounds = {sign: dt.datetime.fromisoformat(x) for sign, x in found}
    return [i for i, t in enumerate(times) if bounds.get(">=", t) <= t and ("<" not in bounds or t < bounds["<"])]


@pytest.fixture
def stub():
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, body):
            server = self.server
            server.asked.append((self.path, body, self.headers.get("Authorization")))
            code, answer = server.answer(self.path, body)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def do_POST(self):
            self._answer(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))

        def do_GET(self):
            self._answer(None)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.asked, server.url = [], f"http://127.0.0.1:{server.server_address[1]}"
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()
    server.server_close()


def _logs(most=10**9):
    columns = [{"name": c} for c in ("TimeGenerated", "CorrelationId", "DurationMs", "ResultSignature", "_ResourceId", "Category", "properties_s")]

    def answer(path, body):
        at = _within(TIMES, body)
        if len(at) > most:
            return 200, {"tables": [], "error": {"code": "PartialError", "message": "too many rows"}}
        rows = [[TIMES[i].strftime("%Y-%m-%dT%H:%M:%S.0000000Z"), f"q{i}", 12.5, "200", "/subscriptions/s1/resourceGroups/g", "RequestResponse", json.dumps({"model": "m", "requestBody": {"user": "x"}})] for i in at]
        return 200, {"tables": [{"name": "PrimaryResult", "columns": columns, "rows": rows}]}

    return answer


def test_slices_cover_the_window():
    got = services.slices(DAY, DAY + dt.timedelta(hours=50), 24)
    assert [(s.last - s.first).total_seconds() / 3600 for s in got] == [24, 24, 2] and got[0].last == got[1].first
    assert services.slices(DAY, DAY, 1) == [] and services.slices(None, DAY, 1) == [services.Slice(None, DAY)]
    assert services.Slice(DAY, DAY + dt.timedelta(seconds=1)).halves() == [] and len(services.Slice(DAY, TIMES[1]).halves()) == 2


def test_log_service(spark, stub):
    stub.answer = _logs()
    url = f"{stub.url}/v1/workspaces/w"
    made = contract.read(spark, "azure-service", url, "2024-01-15", "2024-01-16", token="t0", resource="it's", subscription="s1", hours="12").collect()
    assert sorted(r.request_id for r in made) == sorted(f"q{i}" for i in range(144)) and {(r.model_id, r.latency_ms, r.provider) for r in made} == {("m", 12, "azure")}
    assert len(stub.asked) == 4 and {(p, a) for p, _, a in stub.asked} == {("/v1/workspaces/w/query", "Bearer t0")}
    query = stub.asked[0][1]["query"]
    assert "_ResourceId contains 'it\\'s'" in query and "SubscriptionId == 's1'" in query and "Category == 'RequestResponse'" in query
    assert all("timespan" in body for _, body, _ in stub.asked)


def test_filters_reach_the_service(spark, stub):
    stub.answer = _logs()
    rows = services.log_rows(spark, stub.url, hours="1").where((F.col("TimeGenerated") >= F.lit(TIMES[3])) & (F.col("TimeGenerated") < F.lit(TIMES[9])) & (F.col("CorrelationId") == "q4"))
    assert rows.rdd.getNumPartitions() == 2
    assert [r.CorrelationId for r in rows.select("CorrelationId").collect()] == ["q4"]
    assert len(stub.asked) == 2 and all("CorrelationId == 'q4'" in body["query"] for _, body, _ in stub.asked)
    assert sorted(body["timespan"] for _, body, _ in stub.asked) == ["2024-01-15T01:00:00.000000Z/2024-01-15T02:00:00.000000Z", "2024-01-15T02:00:00.000000Z/2024-01-15T03:00:00.000000Z"]
    stub.asked.clear()
    # with one bound there is one slice and no timespan; a window that is empty asks nothing
    assert services.log_rows(spark, stub.url, "2024-01-16").count() == 72 and "timespan" not in stub.asked[0][1] and len(stub.asked) == 1
    assert services.log_rows(spark, stub.url, "2024-01-16", "2024-01-16").where(F.col("TimeGenerated") < F.lit(DAY)).count() == 0 and len(stub.asked) == 1


def test_cut_answers_are_asked_again_by_halves(spark, stub):
    stub.answer = _logs(most=20)
    got = services.log_rows(spark, stub.url, "2024-01-15", "2024-01-16").select("CorrelationId").collect()
    assert sorted(r.CorrelationId for r in got) == sorted(f"q{i}" for i in range(144)) and len(stub.asked) == 2 * 7


@pytest.mark.parametrize("answer", [(200, {"error": {"code": "BadQuery", "message": "no"}}), (403, {"error": {"code": "Forbidden"}})])
def test_errors_are_raised(spark, stub, answer):
    stub.answer = lambda path, body: answer
    with pytest.raises(Exception, match="BadQuery|403"):
        services.log_rows(spark, stub.url, "2024-01-15", "2024-01-15").collect()


def _table(path, body):
    """The first answer has no rows yet, the second the first page, the third the rest."""
    rows = lambda at: [{"f": [{"v": "projects/p/locations/l/models/gemini"}, {"v": ""}, {"v": str(int(TIMES[i].timestamp()) * 10**6 + 7)}, {"v": str(i + 1)}, {"v": [{"v": "{}"}]}, {"v": [{"v": '{"usageMetadata": {"promptTokenCount": 3}}'}]}]} for i in at]
    job = {"jobReference": {"jobId": "j", "location": "eu"}}
    if body is not None:
        return 200, job | {"jobComplete": False}
    return 200, job | ({"rows": rows(range(2, 3))} if "pageToken" in path else {"rows": rows(range(2)), "pageToken": "next"}) | {"jobComplete": True}


def test_table_service(spark, stub):
    stub.answer = _table
    made = contract.read(spark, "vertex-service", stub.url, "2024-01-15", "2024-01-15", table="p.d.t-1", location="eu").collect()
    assert [(r.request_id, r.model_id, r.input_tokens, r.ts % 10**6) for r in sorted(made, key=lambda r: r.request_id)] == [(str(i), "gemini", 3, 7) for i in (1, 2, 3)]
    assert [p for p, _, _ in stub.asked] == ["/projects/p/queries", "/projects/p/queries/j?maxResults=1000&location=eu", "/projects/p/queries/j?maxResults=1000&pageToken=next&location=eu"]
    body = stub.asked[0][1]
    assert "FROM `p.d.t-1` WHERE logging_time >= @start AND logging_time < @end" in body["query"] and body["location"] == "eu" and len(body["queryParameters"]) == 2
    stub.answer = lambda path, body: (200, {"errors": [{"reason": "invalid"}]})
    with pytest.raises(Exception, match="invalid"):
        services.table_rows(spark, stub.url, "p.d.t").collect()
    for name in ("p.d", "p.d.t`", "p..t"):
        with pytest.raises(ValueError, match="identifier"):
            services.table_rows(spark, stub.url, name)
