"""Packing of rows without ids, of repeated ids and rows, and of an empty table, as an operator and as a stage."""

from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_llm import odd, rows
from tracewell.llm import packing, queries


def test_packing_of_odd_rows(spark):
    df = odd(spark).unionByName(odd(spark).where("doc_id is null or doc_id in (3, 8)")).withColumns({"start": F.lit("clash"), "length": F.lit(1), "sequence_id": F.lit("x")})
    path = public_tokenizers.path(queries.TOKENIZER)
    tok = Tokenizer.from_file(path)
    want, tokens = Counter(), Counter()
    for r in df.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
        want[r.doc_id, n] += n
        tokens[r.doc_id] += n
    for made in (packing.pack_documents(df, path, queries.PACK_END), dict(cp.STAGES)["packing"](spark, df, "")):
        got, by_key, at = Counter(), Counter(), {}
        for key, start, length, total, seq, offset in rows(made, "doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"):
            assert 0 < length and start + length <= total
            got[key, total] += length
            by_key[key] += length
            at.setdefault(seq, []).append((offset, length))
        assert got == want and by_key == tokens
        for pieces in at.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= packing.TOKENS
        assert made.where("false").columns == made.columns
    assert dict(cp.STAGES)["packing"](spark, df.limit(0), "").collect() == []
