"""Phrases go to the shards where they occur, however common the words in them."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.test_llm import key, removal_brute, rows
from tracewell.llm import phrases


def test_phrases_around_common_words(spark, monkeypatch):
    """Two hundred passages, each in two texts, all around the same eight words, whose hash is less than any beside it."""
    rng = random.Random(5)
    some = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    many = some(20000)
    grams = phrases._Shard(pa.table({"text": [" ".join(many)], "shard": [0]}))._grams()
    common = many[int(grams.argmin()) :][: phrases.GRAM]
    passages = [some(20) + common + some(40) for _ in range(200)]
    data = [(i, " ".join(some(9) + passages[i % 200] + some(9))) for i in range(400)]
    sent, real = [], phrases._sent

    def counted(*args):
        out = real(*args)
        sent.append(out.agg(F.sum(F.octet_length("phrases"))).first()[0] // (8 * phrases.WINDOW))
        return out

    monkeypatch.setattr(phrases, "_sent", counted)
    got = rows(phrases.dedupe(spark.createDataFrame(data, "doc_id long, text string").repartition(4)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(got, key=key) == sorted(removal_brute([(i, t, None) for i, t in data]), key=key)
    assert 200 <= sent[0] < 1500
