"""One file per conversation: layout, threads, bodies, commit and abort."""

import json
import os
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.test_export import records  # noqa: F401
from tracewell.sources import export, files


def pieces(spark, rows):
    return spark.createDataFrame(rows, files.PIECES)


def read(path):
    return {p.name: json.loads(p.read_text()) for p in Path(path).glob("*.json")}


def test_export_writes_a_file_per_conversation(spark, records, tmp_path):  # noqa: F811
    path = f"{tmp_path}/out"
    export.write(records, path, "bedrock", embed=True, as_files=True)
    found = read(f"{path}/conversations")
    entries = {Path(r.file).name: r for r in export.read(spark, path, "conversations").collect()}
    assert set(found) == set(entries) and os.listdir(f"{path}/conversations") and not [f for f in os.listdir(f"{path}/conversations") if f.startswith("_")]
    for name, doc in found.items():
        entry = entries[name]
        assert (doc["conversation_id"], doc["stats"]["invocations"], len(doc["invocations"])) == (entry.conversation_id, entry.invocations, entry.invocations)
        assert (doc.get("conversation") is not None) == entry.reconstructed
    doc = found["s.json"]
    assert [i["request_id"] for i in doc["invocations"]] == ["r0", "r1", "r2"] and isinstance(doc["invocations"][0]["input_body"], dict)
    turns = export.read(spark, path, "turns").where("thread_id = ''").orderBy("turn_index").collect()
    assert [t["role"] for t in doc["conversation"]["turns"]] == [t.role for t in turns] and "tools" in doc["conversation"] or doc["conversation"]["turns"]
    assert [s["id"] for s in doc["sidechains"]] == ["b"] and doc["sidechains"][0]["conversation"]["turns"]
    assert found["broken.json"]["invocations"][0]["input_body"] == "x" and found["broken.json"]["conversation"] is None
    back = {r.file: r for r in export.from_files(spark, path).collect()}
    assert len(back["conversations/s.json"].conversation.turns) == len(doc["conversation"]["turns"]) and back["conversations/s.json"].stats.invocations == 3


def test_layouts(spark, tmp_path):
    head = lambda f: (f, files.HEAD, "", 0, 0, f'{{"id":"{f}"}}')
    rows = [
        head("a"), ("a", files.INVOCATION, "", 0, 2, '{"n":2}'), ("a", files.INVOCATION, "", 0, 1, '{"n":1}'), ("a", files.MAIN, "", files.THREAD, 0, "{}"), ("a", files.MAIN, "", files.TURN, 0, '{"t":0}'), ("a", files.MAIN, "", files.TURN, 1, '{"t":1}'),
        ("a", files.SIDE, "y", files.THREAD, 0, '{"id":"y","conversation":{"s":"p"}}'), ("a", files.SIDE, "x", files.THREAD, 0, '{"id":"x","conversation":{}}'), ("a", files.SIDE, "x", files.TURN, 0, '{"t":9}'),
        head("b"), head("c"), ("c", files.INVOCATION, "", 0, 0, '{"n":0}'), head("d"), ("d", files.MAIN, "", files.THREAD, 0, '{"s":"é"}'), head("e"), ("e", files.SIDE, "z", files.THREAD, 0, '{"id":"z","conversation":{}}'),
    ]
    files.write(pieces(spark, [(f"conversations/{r[0]}.json", *r[1:]) for r in rows]).repartition(5), str(tmp_path))
    assert read(tmp_path) == {
        "a.json": {"id": "a", "invocations": [{"n": 1}, {"n": 2}], "conversation": {"turns": [{"t": 0}, {"t": 1}]}, "sidechains": [{"id": "x", "conversation": {"turns": [{"t": 9}]}}, {"id": "y", "conversation": {"s": "p", "turns": []}}]},
        "b.json": {"id": "b", "invocations": [], "conversation": None},
        "c.json": {"id": "c", "invocations": [{"n": 0}], "conversation": None},
        "d.json": {"id": "d", "invocations": [], "conversation": {"s": "é", "turns": []}},
        "e.json": {"id": "e", "invocations": [], "conversation": None, "sidechains": [{"id": "z", "conversation": {"turns": []}}]},
    }
    assert sorted(os.listdir(tmp_path)) == ["a.json", "b.json", "c.json", "d.json", "e.json"]
    files.write(pieces(spark, []), str(tmp_path))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = [(f"{i}.json", files.HEAD, "", 0, 0, '{"id":1}') for i in range(20)]
    bad = pieces(spark, rows).withColumn("json", F.when(F.col("file") == "7.json", F.raise_error(F.lit("half-way"))).otherwise(F.col("json")))
    with pytest.raises((PySparkException, Exception), match="half-way|abort|Writing|failed"):
        files.write(bad, str(tmp_path / "out"))
    left = [p for p in (tmp_path / "out").rglob("*") if p.is_file()] if (tmp_path / "out").exists() else []
    assert left == []


def test_a_task_that_fails_removes_its_files(tmp_path):
    import pyarrow as pa

    class Context:
        def partitionId(self):  # noqa: N802
            return 0

    def batches():
        yield pa.RecordBatch.from_pydict({"file": ["a", "b"], "part": [0, 0], "kind": [0, 0], "json": ["{}", "{}"]})
        assert len(list(Path(tmp_path).rglob("*"))) >= 3
        raise OSError("lost")

    writer = files._Writer(str(tmp_path))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(files.TaskContext, "get", lambda: Context())
        with pytest.raises(OSError, match="lost"):
            writer.write(batches())
    assert [p for p in Path(tmp_path).rglob("*") if p.is_file()] == []
    writer.abort([])
    assert list(Path(tmp_path).iterdir()) == []
