import json

import pytest
from pyspark.sql import functions as F

from tests.test_reconstruct import ASK, CALL, COLUMNS, PLAIN, body
from tracewell.sources import export


@pytest.fixture
def records(spark):
    day = 1705312800_000000
    rows = [("20240115", "bedrock", s, t, day + n * 10**6, n, f"r{n}", "m", 10, 5, 1, 2, asked, PLAIN) for n, (s, t, asked) in enumerate([("s", "a", body(ASK)), ("s", "a", body(ASK, CALL, ASK)), ("s", "b", body(ASK)), ("", "", body(ASK)), ("broken", "", "x")])]
    more = {"principal": F.lit("p"), "error_code": F.when(F.col("n") == 1, "Throttled").otherwise(""), "extra": F.create_map(F.lit("region"), F.lit("r"), F.lit("session_id"), F.lit("s"))}
    return spark.createDataFrame(rows, COLUMNS).withColumns(more)


def test_export_and_reader(spark, records, tmp_path):
    path = f"{tmp_path}/out"
    export.write(records, path, "bedrock", embed=True)
    facts = export.read(spark, path)
    assert facts.columns == list(export.FACTS) and facts.count() == 5
    assert facts.where("extras = '{\"region\":\"r\"}' and num_messages = 0 and status = ''").count() == 5
    convs = {r.conversation_id: r for r in export.read(spark, path, "conversations").collect()}
    gap = next(k for k in convs if k not in ("s", "broken"))
    assert len(gap) == 16 and not convs[gap].reconstructed and not convs["broken"].reconstructed
    assert (convs["s"].invocations, convs["s"].errors, convs["s"].turn_count, convs["s"].reconstructed) == (3, 1, 6, True)
    joined = facts.join(export.read(spark, path, "turns"), ["conversation_id", "thread_id"])
    assert {r.thread_id for r in joined.select("thread_id").collect()} == {"b"}
    found = export.manifest(spark, path)
    totals = found["totals"]
    assert {k: totals[k] for k in ("conversations", "days", *export.SUMS)} == {"conversations": 3, "days": 1, "invocations": 5, "input_tokens": 50, "output_tokens": 25, "cache_read_tokens": 5, "cache_write_tokens": 10, "errors": 1} and found["raw_bodies"] == "embed"
    assert totals["by_model_id"] == {"m": 5} and found["tool"] == "tracewell"
    assert convs["s"].file == "conversations/s.json"
    assert export.read(spark, path, "bodies").count() == 5


def test_other_versions_are_refused(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"schema_version": "tracewell.export/2.0"}))
    with pytest.raises(ValueError):
        export.manifest(spark, str(tmp_path))


def test_empty_and_without_bodies(spark, records, tmp_path):
    export.write(records.drop("input_body", "output_body").limit(0), f"{tmp_path}/none")
    assert export.manifest(spark, f"{tmp_path}/none")["totals"]["conversations"] == 0 and export.read(spark, f"{tmp_path}/none", "conversations").count() == 0


def test_one_conversation_one_body_and_the_index(spark, records, tmp_path):
    path = f"{tmp_path}/out"
    export.write(records, path, "bedrock", embed=True)
    entry, turns = export.conversation(spark, path, "s")
    assert entry.first().invocations == 3 and [(r.thread_id, r.turn_index) for r in turns.collect()] == [("", 0), ("", 1), ("", 2), ("", 3), ("b", 0), ("b", 1)]
    assert [x.count() for x in export.conversation(spark, path, "none")] == [0, 0]
    docs = {r.file: json.loads(r.document) for r in export.documents(spark, path).collect()}
    one = docs["conversations/s.json"]
    assert len(docs) == 3 and [t["role"] for t in one["turns"]] == ["user", "assistant", "user", "assistant"] and one["turns"][3]["metrics"]["request_id"] == "r1" and "metrics" not in one["turns"][0]
    assert [(x["thread_id"], len(x["turns"])) for x in one["sidechains"]] == [("b", 2)] and "turns" not in docs["conversations/broken.json"] and one["invocations"] == 3
    shown = export.body(spark, path, "r1").first()
    assert shown.input_preview == shown.input_body and json.loads(shown.output_body)["role"] == "assistant"
    assert [(r.day, r.conversations, r.invocations, r.errors) for r in export.index(spark, path).collect()] == [("20240115", 3, 5, 1)]
    assert {"invocations=5", "input_tokens=50", "cache_read_tokens=5"} <= set(export.summary(spark, path))


def test_file_names_are_safe_and_differ(spark):
    ids = ["a/b", "a:b", "a_b", "a_b_2", "", "..", "."]
    convs = spark.createDataFrame([("d", 0, "p", x, "", 0, x) for x in ids], "day string, is_gap int, provider string, k1 string, k2 string, seq long, conversation_id string")
    got = {r.conversation_id: r.file for r in export.file_names(convs).collect()}
    assert len({*got.values()}) == len(ids) and all(f.count("/") == 1 and ".." not in f for f in got.values())
    assert got["a/b"] == "conversations/a_b.json" and got["a_b_2"] == "conversations/a_b_2.json" and got["a_b"] == "conversations/a_b_3.json" and got[".."] == "conversations/__.json"
    assert all(len(got[x]) == len("conversations/.json") + 16 for x in ("", "."))
