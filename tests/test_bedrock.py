import gzip
import json

import pytest

from tracewell.operators import sessionize
from tracewell.sources import bedrock, contract
from tracewell.sources.dates import window


def entry(request, ts, body=None, path=None, **more):
    given = {"inputTokenCount": 5, **({"inputBodyJson": body} if body is not None else {}), **({"inputBodyS3Path": path} if path else {})}
    return json.dumps({"timestamp": ts, "requestId": request, "modelId": "m", "identity": {"arn": "p"}, "accountId": "7", "input": given, "output": {"outputTokenCount": 2}} | more)


@pytest.fixture
def bucket(tmp_path):
    day = tmp_path / "AWSLogs" / "7" / "2024" / "01"
    files = {
        day / "15/10/a.json.gz": [entry("a", "2024-01-15T10:00:00Z", {"metadata": {"user_id": "u_session_s1"}}), "", "no json", "[1]", entry("bad", "yesterday"), entry("number", "2024-01-15T10:00:00Z", operation="x", input={"inputTokenCount": "many"}),
                                  entry("big", "2024-01-15T10:01:00Z", path="s3://logs/AWSLogs/7/2024/01/15/10/data/big in.json.gz"), entry("far", "2024-01-15T10:02:00Z", path="s3://other/AWSLogs/7/2024/01/15/10/data/big in.json.gz"), entry("gone", "2024-01-15T10:03:00Z", path="s3://logs/none")],
        day / "16/10/b.json.gz": [entry("b", "2024-01-17T00:00:00Z", {}, errorCode="Throttled"), json.dumps({"requestId": "bare"})],
        tmp_path / "loose.json.gz": [entry("loose", "2020-01-01T00:00:00Z")],
        day / "15/10/data/big in.json.gz": [json.dumps({"metadata": {"user_id": '{"session_id":"s2"}'}})],
    }
    for path, lines in files.items():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(gzip.compress("\n".join(lines).encode()))
    return str(tmp_path)


def test_reads_lines_objects_and_skips_the_malformed(spark, bucket):
    rows = {r["request_id"]: r for r in bedrock.read(spark, bucket, "logs").collect()}
    assert set(rows) == {"a", "big", "far", "gone", "b", "bare", "loose"}
    assert (rows["a"]["session_id"], rows["big"]["session_id"], rows["far"]["input_body"], rows["gone"]["input_body"]) == ("s1", "s2", "", "")
    assert rows["a"]["extra"] == {"accountId": "7"} and rows["a"]["input_tokens"] == 5 and rows["a"]["day"] == "20240115"
    assert rows["bare"]["ts"] is None and rows["bare"]["principal"] == "" and rows["b"]["error_code"] == "Throttled"


def test_days_choose_files_and_paths_without_a_day_stay(spark, bucket):
    ids = lambda *w: {r["request_id"] for r in bedrock.read(spark, bucket, "logs", *w).select("request_id").collect()}
    assert ids("2024-01-16") == {"b", "bare", "loose"}
    assert ids("", "2024-01-15") == {"a", "big", "far", "gone", "loose"}


def test_records_become_conversations(spark, bucket):
    found = sessionize.with_ids(sessionize.conversations(bedrock.read(spark, bucket, "logs", "2024-01-15", "2024-01-15").where("day = '20240115'"))).collect()
    assert sorted((r["conversation_id"] if not r["is_gap"] else "gap", r["invocations"]) for r in found) == [("gap", 2), ("s1", 1), ("s2", 1)]


def test_contract(spark, bucket):
    rows = contract.read(spark, "bedrock", bucket, "2024-01-15", "2024-01-15", bucket="logs")
    assert rows.columns == list(contract.RECORD) and rows.dtypes == [(c, k.replace("long", "bigint").replace(", ", ",")) for c, k in contract.RECORD.items()]
    one = rows.where("request_id = 'a'").first()
    assert (one.thread_id, one.num_messages, one.latency_ms, one.extra, one.stop_reason) == ("", 0, 0, {"accountId": "7"}, "")
    with pytest.raises(ValueError):
        contract.read(spark, "other", bucket)


def test_dates():
    assert [x.isoformat() for x in window("2024-01-15", "2024-01-15")] == ["2024-01-15T00:00:00+00:00", "2024-01-16T00:00:00+00:00"]
    assert window() == (None, None)
    with pytest.raises(ValueError):
        window("15.1.2024")
