"""Folders outside a window are not listed; what is skipped is counted by the reading itself."""

import datetime as dt
import json

import pytest
from pyspark.sql import Observation

from tests.test_bedrock import bucket, entry  # noqa: F401
from tracewell.sources import azure, bedrock, listing


@pytest.fixture
def listed(monkeypatch):
    """Names of the folders that were listed."""
    seen, real = [], listing._entries

    def entries(spark, path):
        seen.append(path.removeprefix("file:"))
        return real(spark, path)

    monkeypatch.setattr(listing, "_entries", entries)
    return seen


def put(root, *names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x\n")


def day(y, m, d, h=0):
    return dt.datetime(y, m, d, h, tzinfo=dt.UTC)


def found(spark, root, *window, layout=listing.DAYS):
    return sorted(p.removeprefix("file:").removeprefix(f"{root}/") for p in listing.paths(spark, str(root), layout, *window))


def test_only_folders_of_the_window_are_walked(spark, tmp_path, listed):
    put(tmp_path, "a/2023/12/31/10/f", "a/2024/01/15/10/f", "a/2024/01/16/00/f", "a/2024/02/01/10/f", "b/2024/13/45/1/f", "b/2024/notes/f", "loose", "c/12/2024/01/15/f", "_hidden/f", ".h", "d/we[i]rd/2024/01/15/1/f")
    assert found(spark, tmp_path, day(2024, 1, 15), day(2024, 1, 16)) == ["a/2024/01/15", "b/2024/13/45/1/f", "b/2024/notes/f", "c/12/2024/01/15", "d/we\\[i\\]rd/2024/01/15", "loose"]
    inside = {p.removeprefix(f"{tmp_path}/") for p in listed}
    assert not inside & {"a/2023", "a/2024/02", "a/2024/01/16", "a/2024/01/15", "a/2023/12"} and {"a/2024", "a/2024/01", "b/2024/13"} <= inside
    listed.clear()
    assert found(spark, tmp_path, None, None) == [str(tmp_path)] and listed == []
    assert found(spark, tmp_path, None, day(2024, 1, 1)) == ["a/2023/12/31", "loose"]


def test_open_windows_and_hours(spark, tmp_path):
    put(tmp_path, "s/y=2024/m=01/d=15/h=09/m=00/f.json", "s/y=2024/m=1/d=15/h=10/m=00/f.json", "s/y=2025/m=01/d=01/h=00/m=00/f.json")
    assert found(spark, tmp_path, day(2024, 1, 15, 10), None, layout=listing.HOURS) == ["s/y=2024/m=1/d=15/h=10", "s/y=2025/m=01/d=01/h=00"]
    assert found(spark, tmp_path, None, day(2024, 1, 15, 10), layout=listing.HOURS) == ["s/y=2024/m=01/d=15/h=09"]


def test_reader_lists_its_days_and_counts_what_it_skips(spark, bucket, listed):  # noqa: F811
    skipped = Observation()
    rows = bedrock.read(spark, bucket, "logs", "2024-01-15", "2024-01-15", skipped)
    assert {r.request_id for r in rows.collect()} == {"a", "big", "far", "gone", "loose"}
    # of the lines of the 15th and the loose one: blank, no json, [1] and a wrong number, and no time
    assert skipped.get == {"lines": 10, "blank": 1, "too_long": 0, "malformed": 3, "bad_time": 1}
    assert not any(p.endswith(("/01/15", "/01/16")) for p in listed)
    assert bedrock.read(spark, bucket, "logs", "1999-01-01", "1999-01-02").select("request_id").collect()[0].request_id == "loose"


def test_empty_bucket(spark, tmp_path):
    (tmp_path / "a/2024/01/01").mkdir(parents=True)
    assert bedrock.read(spark, str(tmp_path), "logs", "2023-01-01", "2023-01-02").collect() == []
    assert azure.read_storage(spark, str(tmp_path), "2023-01-01", "2023-01-02").collect() == []


def test_resource_logs(spark, tmp_path):
    line = lambda time, **more: json.dumps({"time": time, "category": "RequestResponse", "properties": {}} | more)
    path = tmp_path / "r/y=2024/m=01/d=15/h=10/m=00/PT1H.json"
    path.parent.mkdir(parents=True)
    path.write_text("\n".join([line("2024-01-15T10:00:00Z"), line("2024-01-20T10:00:00Z"), line("2024-01-15T10:00:00Z", category="Audit"), line("never"), "{", "", line("2024-01-15T10:30:00Z")]))
    skipped = Observation("of-storage")
    assert azure.read_storage(spark, str(tmp_path), "2024-01-15", "2024-01-15", skipped).count() == 2
    assert skipped.get == {"lines": 7, "blank": 1, "too_long": 0, "malformed": 1, "no_time": 1, "other_category": 1, "outside_window": 1}
