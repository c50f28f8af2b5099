"""Fingerprints without ids, and what a deeper tree costs."""

import numpy as np
import pytest

from tests.llm.test_llm import rows
from tracewell.llm import simhash


def test_links_run_through_rows_without_ids(spark, monkeypatch):
    prints = [(9, 0), (None, 0b111), (5, 0b111111), (None, 1 << 40 | 0b111 << 50)]
    monkeypatch.setattr(simhash, "fingerprints", lambda df, *_: df.selectExpr("doc_id as id", "cast(text as long) as fp"))
    df = spark.createDataFrame([(i, str(fp)) for i, fp in prints], "doc_id long, text string")
    got = rows(simhash.near_duplicates(df), "doc_id", "component_id")
    assert sorted(got, key=str) == sorted([(9, 5), (None, 5), (5, 5), (None, None)], key=str)


@pytest.mark.parametrize("depth,most", [(6, 10), (9, 20), (12, 40)])
def test_copies_of_a_fingerprint_over_shards(depth, most):
    """Random fingerprints, the worst case: rows sent for one grow by less than 1.3 a level of both trees."""
    rng = np.random.default_rng(depth)
    fps = rng.integers(0, 2**64 - 1, 1 << 16, dtype=np.uint64)
    sent, largest = 0, 0
    for half in simhash.halves(fps):
        nodes = simhash.grow(half[: simhash.SAMPLED << depth])
        members = np.zeros(sum(n[0] is None for n in nodes), int)
        for shard, at, member in simhash.route(nodes, half, simhash.RADIUS // 2):
            sent += len(at)
            members[shard] += member.sum()
        assert members.sum() == len(fps)
        largest = max(largest, members.max() * 2**depth / len(fps))
    print(depth, sent / len(fps), largest)
    assert sent / len(fps) < most
    assert largest < 8
