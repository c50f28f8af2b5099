"""Secrets in alphabets of one case, and runs that touch a base span."""

import random
import string
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.test_llm import rows
from tracewell.llm import secrets

ALPHABETS = {"HEX": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "base36": string.digits + string.ascii_lowercase}


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return dict(rows(secrets.scan(df).select("doc_id", secrets.spelled(F.col("spans")).alias("s")), "doc_id", "s"))


def test_alphabets_of_one_case(spark):
    rng = random.Random(3)
    planted = [(name, n, "".join(rng.choices(letters, k=n))) for name, letters in ALPHABETS.items() for n in (20, 24, 32, 40, 64) for _ in range(20)]
    planted = [x for x in planted if any(c.isdigit() for c in x[2]) and not secrets.ACCESS[:4] in x[2]]
    words = "the internal session number of some component is written into every release name before order section".split()
    plain = ["".join(rng.choices(words, k=rng.randrange(5, 12)))[:70] for _ in range(300)]
    plain = [(t if len(t) >= 20 else t * 3) + str(rng.randrange(1, 2030)) for t in plain]
    plain = [t.upper() if i % 2 else t for i, t in enumerate(plain)]
    numbers = ["".join(rng.choices(string.digits, k=22)) + "E" for _ in range(40)]
    got = spans(spark, [f"é words {x[2]} and more" for x in planted] + [f"é words {t} and more" for t in plain + numbers])
    found = Counter((x[0], x[1]) for i, x in enumerate(planted) if f"random:8:{8 + x[1]}" in got[i].split(","))
    there = Counter((x[0], x[1]) for x in planted)
    share = {k: found[k] / n for k, n in there.items()}
    assert all(v >= 0.9 for k, v in share.items() if k[1] >= 24) and min(share.values()) >= 0.5, share
    false = [t for i, t in enumerate(plain + numbers, len(planted)) if got[i]]
    assert len(false) <= 0.01 * len(planted), false


def test_rest_of_a_run_beside_a_base_span(spark):
    rng = random.Random(5)
    letters = string.ascii_letters + string.digits
    parts = [("".join(rng.choices(letters, k=40)) + "+", "".join(rng.choices("0123456789abcdef", k=32)), "+" + "".join(rng.choices(letters, k=40))) for _ in range(30)]
    got = spans(spark, [f"é {a}{b}{c} x" for a, b, c in parts])
    want = {f"random:2:{2 + 41}", "hex:43:75", "random:75:116"}
    exact = [{*got[i].split(",")} for i in range(30)]
    assert sum(want == e for e in exact) >= 20 and all(any(x.startswith("hex") for x in e) for e in exact)
