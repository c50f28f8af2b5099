"""Every stage of the pipeline on its own input, and the whole, against brute force."""

from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_llm import check_packing, documents, key, odd, rows, stats_of
from tracewell.llm import mixing, packing, quality, queries, secrets

STAGE = dict(cp.STAGES)
PIECES = [x.split()[0] for x in packing.PIECES.split(", ")]


@pytest.fixture(scope="module", params=["tiny", "odd", "empty"])
def docs(request, spark, tiny):
    df = {"tiny": documents(spark, tiny), "odd": odd(spark), "empty": odd(spark).limit(0)}[request.param]
    return df.cache()


def plain(df):
    return sorted(rows(df, *cp.COLUMNS), key=key)


def test_quality(spark, docs):
    got = plain(STAGE["quality"](spark, docs, ""))
    good = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    passes = lambda s: s[0] >= 10 and 100 * s[4] <= 20 * s[0]
    assert got == [r for r in plain(docs) if passes(stats_of(r[1] or "")) and r[0] in good]


def test_secrets(spark, docs):
    want = []
    for r in secrets.scan(docs).collect():
        text, at = "", 0
        for start, _, end in r.spans:
            text += (r.text[at:start] + "[secret]") if start >= at else ""
            at = max(at, end)
        text = None if r.text is None else text + r.text[at:]
        want.append((r.doc_id, text, r.lang, r.source, None if text is None else len(text)))
    assert plain(STAGE["secrets"](spark, docs, "")) == sorted(want, key=key)


def test_mixing(spark, docs):
    docs = docs.dropDuplicates(["doc_id"]).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    got = plain(STAGE["mixing"](spark, docs, ""))
    assert Counter(got) == Counter({r: copies[r[0]] for r in plain(docs) if copies[r[0]]})
    assert got == plain(STAGE["mixing"](spark, docs.repartition(5), ""))


def test_whole(spark, tiny):
    """run() against the stages one after the other, and its pieces against the tokenizer."""
    left = documents(spark, tiny)
    for name, stage in cp.STAGES[:-1]:
        left = stage(spark, left, tiny)
        assert left.columns == list(cp.COLUMNS), name
        left = spark.createDataFrame(left.collect(), left.schema)
    tok = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    copies = Counter(r.doc_id for r in left.collect())
    ids = {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, queries.PACK_END] for r in left.collect()}
    got = rows(cp.run(spark, tiny), *PIECES)
    tokens = Counter()
    for doc_id, _, length, *_ in got:
        tokens[doc_id] += length
    assert tokens == Counter({i: len(ids[i]) * n for i, n in copies.items()})
    once = spark.createDataFrame(left.dropDuplicates(["doc_id"]).collect(), left.schema)
    check_packing(rows(STAGE["packing"](spark, once.coalesce(1), tiny), *PIECES), ids)
