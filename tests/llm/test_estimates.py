"""The robust estimates of op 2 against exhaustive restarts, the mix on repeated rows, and texts with very many secrets."""

import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_llm import base_brute, key, rows
from tracewell.llm import mixing, quality, secrets


def mcd_brute(x, tries=300):
    """The least log-determinant over random starts of exact concentration steps."""
    rng, h, best = np.random.default_rng(0), int(np.ceil(quality.SUPPORT * len(x))), np.inf
    factor = quality.SUPPORT / quality.chi2_cdf(quality.chi2_quantile(quality.SUPPORT, quality.K), quality.K + 2)
    for _ in range(tries):
        at = rng.choice(len(x), 5, replace=False)
        for _ in range(30):
            spread = quality._regular(np.cov(x[at].T, bias=True) * factor)
            d = x - x[at].mean(0)
            new = np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(spread), d), kind="stable")[:h]
            if set(new) == set(at):
                break
            at = new
        best = min(best, np.linalg.slogdet(quality._regular(np.cov(x[at].T, bias=True) * factor))[1])
    return best


def test_least_determinants(spark):
    rng = np.random.default_rng(8)
    groups = {}
    for name, share in (("clean", 0.0), ("some", 0.1), ("much", 0.2)):
        x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) * 0.5
        bad = rng.random(400) < share
        x[bad] = rng.normal(size=(bad.sum(), 4)) * 0.3 + 6
        groups[name] = np.round(x * quality.SCALE).astype(int)
    groups["constant"] = np.tile([256, 0, 0, 0], (50, 1))
    df = spark.createDataFrame([(k, *map(int, r)) for k, x in groups.items() for r in x], "key string, " + ", ".join(f"{f} long" for f in quality.FEATURES))
    got = {r.key: r for r in quality.models(df).collect()}
    for name, x in groups.items():
        ours = np.linalg.slogdet(quality._regular(np.array(got[name].scatter).reshape(4, 4)))[1]
        assert abs(ours - mcd_brute(x / quality.SCALE)) < 0.1, name
        assert got[name].rows == len(x)
    again = {r.key: r for r in quality.models(df.repartition(7)).collect()}
    assert got == again


def test_repeated_rows_are_mixed_as_often_as_the_mix_says(spark):
    data = [(1, "a b c d e", "x")] * 40 + [(2, "f g", "x"), (2, "h i", "x")] * 5 + [(i, "w " * (i % 7), "y") for i in range(3, 60)] + [(None, f"t{i % 3} u v", "z") for i in range(30)] + [(None, None, None)] * 3
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumns({"id": F.lit("clash"), "key": F.lit(1), "row": F.lit(2)})
    copies = Counter()
    for r in mixing.mix(df).collect():
        copies[(r.doc_id, r.source, r["size"])] += r.copies
    for parts in (1, 5):
        got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixing.taken(df.repartition(parts), tuple(df.columns)).collect())
        assert got == +copies
    assert mixing.taken(df.limit(0), tuple(df.columns)).collect() == []


def test_very_many_matches(spark):
    rng = random.Random(2)
    hexes = ["".join(rng.choices("0123456789abcdef", k=30)) for _ in range(20_000)]
    texts = [" é ".join(hexes), "é".join(f"token={h}" for h in hexes[:700]), ("password: " + hexes[0] + "\n") * 257]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"base": F.lit("clash"), "found": F.lit("kept")})
    began = time.time()
    found = secrets.scan(df)
    got = rows(found.select("doc_id", "found", secrets.spelled(F.col("base")).alias("b"), secrets.redacted(F.col("text"), F.col("spans")).alias("r")), "doc_id", "found", "b", "r")
    assert time.time() - began < 60
    for doc_id, kept, base, redacted in sorted(got, key=key):
        assert kept == "kept" and base.split(",") == base_brute(texts[doc_id])
        marks = ["[secret]"] * (20_000, 700, 257)[doc_id]
        assert redacted == (" é ".join(marks), "é".join(marks), "[secret]\n" * 257)[doc_id]
    assert secrets.scan(df.limit(0)).collect() == []
