"""Labels, previews and the command line."""

import pytest
from pyspark.sql import functions as F

from tracewell.__main__ import main, parser, redacted
from tracewell.functions import text
from tracewell.sources import export


def one(spark, column, value, kind):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_labels(spark):
    assert [one(spark, text.duration_label, n, "long") for n in (0, 999, 1000, 1500, 61_000)] == ["0ms", "999ms", "1.0s", "1.5s", "61.0s"]
    for ms in (1050, 1250, 1350, 16650, 99950, 123450, 1234567850, 2**53 - 41):
        assert one(spark, text.duration_label, ms, "long") == f"{ms / 1000:.1f}s"
    assert [one(spark, lambda x: text.truncated(x, 3), s, "string") for s in ("", "abc", "abcd", None)] == ["", "abc", "abc...", ""]
    assert [one(spark, text.short_session, s, "string") for s in ("12345678-abc", "short", None)] == ["12345678", "short", ""]
    assert [one(spark, text.grouped_digits, n, "long") for n in (0, 999, 1000, -1234567)] == ["0", "999", "1,000", "-1,234,567"]


def test_previews_end_between_characters(spark):
    for body in ("", "short", "x" * 32, "é" * 16, "x" + "é" * 16, "🙂" * 9, "xx" + "🙂" * 9):
        got = one(spark, lambda x: text.preview(x, 32), body, "string")
        raw = body.encode()
        if len(raw) <= 32:
            assert got == body
        else:
            kept = raw[:32].decode(errors="ignore")
            assert got == f"{kept}\n\n[first {len(kept.encode())} bytes of {len(raw)}]"


def test_sensitive_values_are_left_out():
    assert redacted(["tracewell", "azure", "t", "--subscription", "abc", "--start=2024-01-01", "--subscription=x=y"]) == "tracewell azure t --subscription <redacted> --start=2024-01-01 --subscription=<redacted>"
    assert redacted(["--subscription"]) == "--subscription"
    with pytest.raises(SystemExit):
        parser().parse_args(["bedrock", "root"])


def test_command_line_exports_captures(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.request.json").write_text('{"model": "m", "messages": [{"role": "user", "content": "hi"}], "metadata": {"user_id": "u_session_s1"}}')
    (folder / "b.response.json").write_text('{"id": "msg_1", "model": "m", "role": "assistant", "content": "yo", "stop_reason": "end_turn", "usage": {"input_tokens": 3, "output_tokens": 1}}')
    (folder / "c.request.json").write_text("{")
    main(["claude", str(folder), "--out", f"{tmp_path}/out"])
    said = capsys.readouterr().out.split("\n")
    assert {"invocations=1", "skipped_lines=2", "skipped_malformed=1", "skipped_no_messages=0"} <= set(said)
    assert [(r.role, r.text) for r in export.read(spark, f"{tmp_path}/out", "turns").orderBy("turn_index").collect()] == [("user", "hi"), ("assistant", "yo")]
    assert export.manifest(spark, f"{tmp_path}/out")["source"] == f"tracewell claude {folder} --out {tmp_path}/out"
