"""Quality verdicts in groups of few documents."""

import random

from tests.llm.test_llm import rows
from tracewell.llm import quality


def test_junk_in_small_groups_goes(spark):
    rng = random.Random(1)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(500)]
    clean = lambda: " ".join(rng.choices(vocab, k=rng.randrange(15, 400)))
    junk = lambda: " ".join(w + rng.choice(["###", "%%%"]) for w in rng.choices(vocab, k=80))
    groups = [("en", f"s{i}") for i in range(12)] + [("xx", "s"), (None, None), ("en", None)]
    data = [(make(), *g, make is clean) for g in groups for make in (clean,) * 8 + (junk,)] + [(clean(), "en", "large", True) for _ in range(200)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "doc_id long, text string, lang string, source string, good boolean")
    kept = {r[0] for r in rows(quality.judge(df).where("kept"), "doc_id")}
    assert kept == {i for i, x in enumerate(data) if x[3]}
    # a table of few rows is judged too: eight clean ones and one of junk
    assert {r[0] for r in rows(quality.judge(df.where("doc_id < 9")).where("kept"), "doc_id")} == set(range(8))
