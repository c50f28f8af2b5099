"""Periodic runs against brute force, on odd rows and on a long periodic text."""

import random

import numpy as np
import pytest

from tracewell.llm import periods
from tracewell.llm.queries import op13_periodic_runs

from .test_llm import WORDS, documents, odd


def brute(words, least=6, exponent=4):
    """Every maximal stretch for every period, of equal ends the smallest."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check(df, **more):
    for r in periods.periodic_runs(df, **more).join(df.select("doc_id", "text"), "doc_id").collect():
        words = WORDS.findall(r.text or "")
        want = brute(words, more.get("least", 6), more.get("exponent", 4))
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(words), want, collapsed(words, want))


def texts(spark, given):
    return spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")


def test_random_texts_of_few_words(spark):
    rng = random.Random(5)
    made = [" ".join(rng.choice("ab" if n % 2 else "abc") for _ in range(n)) for n in range(0, 120)]
    for p in (1, 2, 3, 5, 8, 13):
        unit = [rng.choice("abcde") for _ in range(p)]
        made += [" ".join(["x"] * k + (unit * 9)[: 4 * p + k] + ["y"] * (k % 3) + (unit * 9)[:k]) for k in range(0, 2 * p + 3)]
    check(texts(spark, made))
    check(texts(spark, made), least=4, exponent=3)


def test_runs_end_where_texts_end(spark):
    check(texts(spark, ["a a a", "a a a a", "a a a a a a", "b a b a b a b", "a b a b a b a b", "a a a a a b"] * 3))


def test_long_periods_and_levels(spark):
    unit = [f"w{i}" for i in range(257)]
    check(texts(spark, [" ".join(unit * 4), " ".join((unit * 6)[5:1400]), " ".join(unit * 3), " ".join(["z"] * 3000), " ".join((["q", "r"] * 700) + unit * 4)]))


def test_odd_rows(spark, tiny):
    df = odd(spark)
    rows = periods.periodic_runs(df).collect()
    assert len(rows) == df.count() and all(not r.runs and r.n_words == len(r.collapsed.split(" ")) * bool(r.collapsed) for r in rows)
    assert periods.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="exponent"):
        periods.periodic_runs(df, exponent=2)
    check(documents(spark, tiny))


def test_candidates_in_blocks(monkeypatch):
    words = np.tile(np.arange(3), 500)
    whole = periods.find(words, np.zeros(1500, int), 1500)
    monkeypatch.setattr(periods, "BLOCK", 7)
    assert [x.tolist() for x in periods.find(words, np.zeros(1500, int), 1500)] == [x.tolist() for x in whole] == [[0], [1500], [3]]


def test_query_keeps_every_document(spark, tiny):
    rows = op13_periodic_runs(spark, tiny).collect()
    assert len(rows) == documents(spark, tiny).count() and any(r.n_runs and r.exponent_milli >= 4000 for r in rows)
