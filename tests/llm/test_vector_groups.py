"""Dense groups, vectors of several lengths, and intervals that do not follow the partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import vectors


def near(rng, centre, n, spread):
    return centre + rng.normal(size=(n, len(centre))) * spread


@pytest.mark.parametrize("leaf", [4, 64])
def test_tiles_hold_every_pair(monkeypatch, leaf):
    monkeypatch.setattr(vectors, "LEAF", leaf)
    rng = np.random.default_rng(5)
    x = vectors._units(np.vstack([near(rng, c, 40, 0.1) for c in rng.normal(size=(5, 10))] + [rng.normal(size=(60, 10))]))
    axes = np.linalg.qr(rng.normal(size=(10, 8)))[0]
    order = np.lexsort((x @ axes).T[::-1])
    x = x[order]
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.9), strict=True) if i < j}
    got = [(i + r, k + c) for i, k, hits in vectors.join_sequences(x, x, x @ axes, x @ axes, 0.9, True) for r, c in zip(*np.nonzero(hits), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want
    y = x[:100]
    got = [(i + r, k + c) for i, k, hits in vectors.join_sequences(x, y, x @ axes, y @ axes, 0.9, False) for r, c in zip(*np.nonzero(hits), strict=True)]
    assert sorted(got) == sorted(zip(*np.nonzero(x @ y.T >= 0.9), strict=True))


def test_dense_tiles_connect_like_their_hits():
    rng = np.random.default_rng(1)
    for density in (0.0, 0.01, 0.3, 1.0):
        hits = rng.random((50, 40)) < density
        hits[:20, 10:] = False
        hits[20:, :10] = False
        r, c, c2, c3 = vectors.tile_edges(hits)
        a, b = np.nonzero(hits)
        want = dict(zip(*vectors._forest(a, 100 + b), strict=True)) if len(a) else {}
        got = dict(zip(*vectors._forest(np.concatenate([r, 100 + c2]), 100 + np.concatenate([c, c3])), strict=True)) if len(r) else {}
        assert got == want


def test_one_group_of_twenty_thousand_near_copies(spark):
    rng = np.random.default_rng(3)
    x = near(rng, rng.normal(size=16), 20_000, 0.05)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    got = vectors.near_duplicates(df).agg(F.sum("n_links"), F.max("component_id"), F.count_if("kept")).first()
    u = vectors._units(x.astype(np.float32))
    want = sum(int((u[i : i + 2000] @ u.T >= 0.9).sum()) for i in range(0, 20_000, 2000)) - 20_000
    assert tuple(got) == (want, 0, 1) and want > 3e8


def test_intervals_do_not_follow_partitions(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(rng.normal(size=(5000, 8)))], "id long, n long, embedding array<double>")
    axes, seen = np.eye(8), {}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("8", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            blocks = vectors._blocks(df.repartition(int(partitions)), axes, 0.4, 2048)
            seen[partitions] = (blocks.select("interval").distinct().count(), blocks.selectExpr("sum(length(ids)) / 8").first()[0], vectors._interval_pairs(blocks, 0.4, 8).count())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen["8"] == seen["211"] == (3, 5000, 6)


def test_lengths_do_not_mix(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.001]), (5, []), (6, [1e-300, 0.0]), (7, [1e300, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in vectors.near_duplicates(df).collect())
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 3, 1, False), (7, 3, 1, False)]
