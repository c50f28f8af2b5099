"""The near-dup stage against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_llm import WORDS, documents, odd, rows

from tracewell.llm import similar

STAGE = dict(cp.STAGES)


def shingles(text):
    ws = [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORDS.findall(text or "")]
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def brute(texts):
    """Groups of indices of texts that links of similarity 0.8 connect; wordless texts are equal."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def planted():
    """Texts with near copies of 0.8 to 1 similarity, far ones below, and a large group around one text."""
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    out = []
    for n in (8, 30, 120, 500) * 12:
        base = words(n)
        out.append(base)
        for changes in (1, 2, max(1, n // 60), n // 25, n // 12):
            copy = list(base)
            for at in rng.sample(range(n), changes):
                copy[at] = "new" + str(rng.random())
            out.append(copy)
    base = words(200)
    for _ in range(150):
        out.append(base[:])
        out[-1][rng.randrange(200)] = "x" + str(rng.random())
    return [" ".join(x) for x in out]


def check(spark, df):
    before = df.select("doc_id", "text").collect()
    label = brute([r.text for r in before])
    want = {}
    for r, group in zip(before, label, strict=True):
        mine = (r.doc_id is None, r.doc_id or 0)
        want[group] = min(want.get(group, mine), mine)
    got = rows(STAGE["near_dup"](spark, df, ""), "doc_id")
    assert sorted((x[0] is None, x[0] or 0) for x in got) == sorted(want.values())


def test_near_copies_of_tables_and_odd_rows(spark, tiny):
    check(spark, documents(spark, tiny))
    check(spark, odd(spark))
    check(spark, odd(spark).limit(0))


def test_planted_near_copies(spark):
    data = [(i, t, "en", "s", len(t)) for i, t in enumerate(planted())]
    check(spark, spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(7))


def test_no_near_copies_are_left_after_dedup(spark, tiny):
    left = documents(spark, tiny)
    for name, stage in cp.STAGES:
        if name in ("secrets", "mixing", "packing"):
            break
        left = spark.createDataFrame(stage(spark, left, "").collect(), left.select(*cp.COLUMNS).schema)
    assert left.count() > 100 and sorted(brute([r.text for r in left.collect()])) == list(range(left.count()))


def test_rows_count_and_not_ids(spark):
    """Unlike texts of one id both stay; of equal rows one stays; a null id stays alone and goes beside a row with an id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    data = [(1, a), (1, b), (2, a), (None, c), (None, c), (None, b), (3, None), (4, " "), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in data], "doc_id long, text string, lang string, source string, n_chars long, uid string")
    got = STAGE["near_dup"](spark, df.repartition(4), "")
    assert sorted(rows(got, "doc_id", "text"), key=str) == sorted([(1, a), (1, b), (None, c), (3, None)], key=str) and got.columns == list(cp.COLUMNS)


def template_pages(n, changed, seed):
    """A text of 400 words and n - 1 variants of it with that many words replaced."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    out = [base]
    for _ in range(n - 1):
        out.append(list(base))
        for at in rng.sample(range(2, 398), changed):
            out[-1][at] = "x" + str(rng.random())
    return [" ".join(x) for x in out]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


@pytest.mark.parametrize("changed", [8, 20])
def test_a_star_of_variants(spark, changed):
    """Variants with 8 words replaced link to the template (0.817) and not to each other (0.689); with 20 nothing links."""
    check(spark, table(spark, template_pages(600, changed, changed)))


def test_a_chain_and_a_dense_group(spark):
    rng, text, out = random.Random(8), [f"c{i}" for i in range(120)], []
    for _ in range(80):
        text = list(text)
        text[rng.randrange(120)] = "y" + str(rng.random())
        out.append(" ".join(text))
    check(spark, table(spark, out + template_pages(150, 3, 9) + ["a b c d e f"] * 40))


@pytest.mark.parametrize(("listed", "block"), [(64, 256), (3, 5), (10**6, 256)])
def test_second_pass_alone_finds_every_link(spark, monkeypatch, listed, block):
    """Without the first pass, by pairs only and by small blocks."""
    monkeypatch.setattr(similar, "LISTED", listed)
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "_bunches", lambda classes: classes.limit(0).select(F.col("uid").alias("bunch"), "uid"))
    rng = random.Random(2)
    passage = " ".join(f"licence{i}" for i in range(60))
    shared = [passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 90))) for _ in range(80)]
    check(spark, table(spark, template_pages(70, 8, 5) + shared + planted()[:80] + ["one two", "one two", "a b c d e", "a b c d f"]))


def family(n, words, shared, seed):
    """Texts of so many words that all share a passage of some, and have no more in common."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(shared))
    return [passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(words - shared)) for _ in range(n)]


def test_sketches_drop_no_link():
    """Against exact similarity, for sets of one and of two widths of sketches."""
    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (3, 4), (32, 33), (60, 70), (500, 500), (500, 530), (520, 640), (4000, 4100)):
        for both in range(max(0, min(n, m) - 40 - n // 3), min(n, m) + 1, 1 + n // 50):
            h = rng.integers(0, 2**63, n + m - both, dtype=np.int64).view(np.uint64)
            x, y = (np.frombuffer(similar._sketch(s), np.uint64)[None] for s in (h[:n], h[n - both :]))
            may = bool(similar._may_link(x, np.array([n]), y, np.array([m]))[0])
            assert may or 9 * both < 4 * (n + m)
            assert not may or n < 60 or both > 0.6 * min(n, m)


def test_sets_of_a_family_are_not_sent_for_each_pair(spark, monkeypatch, tmp_path):
    """A hundred texts that share half their words, unlinked, are 4,950 pairs. No shingle counts as common, as where a sample misses them."""
    monkeypatch.setattr(similar, "COMMON", 10**6)
    sent = tmp_path / "sent"
    for name in {"_confirmed", "_compared", "_decided"} & set(dir(similar)):
        f = getattr(similar, name)

        def seen(*args, f=f):
            members = args[-1]

            def run(batches):
                for batch in batches:
                    with sent.open("a") as out:
                        out.write("x" * batch.num_rows)
                    yield batch

            return f(*args[:-1], members.mapInArrow(run, members.schema))

        monkeypatch.setattr(similar, name, seen)
    check(spark, table(spark, family(100, 200, 100, 3) + template_pages(3, 2, 1)))
    assert not sent.exists() or sent.stat().st_size < 500
