"""Ranked full-text search (BM25) without an index: one pass over the texts for a query's terms."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.sources.scratch import written

#: Fixed values of the ranking: saturation of term counts and weight of lengths.
K1, B = 1.2, 0.75


def terms_of(query: str) -> list[str]:
    """The distinct words of a query: runs of a-z after lower-casing, in order."""
    return list(dict.fromkeys(re.findall("[a-z]+", query.lower())))


def bm25(texts: DataFrame, query: str, text_col: str = "text", limit: int = 10) -> DataFrame:
    """The limit best rows of texts for query, with score; ties fall to the smaller values of the other columns, in their order.

    Words are as in terms_of, without stemming or stop words. Lengths and term counts of every row are counted once, in one
    reading of the texts, and written; only those numbers are read for the totals and scores. Rows without any term are no
    results; a query without words finds nothing. Null texts have no words.
    """
    terms, keys = terms_of(query), [c for c in texts.columns if c != text_col]
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    found = [F.regexp_count(text, F.lit(f"(?<![a-z]){t}(?![a-z])")).cast("double").alias(f"tf_{i}") for i, t in enumerate(terms)]
    counted = written(texts.select(F.struct(*keys).alias("key"), F.regexp_count(text, F.lit("[a-z]+")).alias("dl"), *found).where("dl > 0"), "terms")
    totals = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))))
    length = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    score = sum((F.log((F.col("n") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5) + 1) * F.col(f"tf_{i}") * (K1 + 1) / (F.col(f"tf_{i}") + length) for i in range(len(terms))), F.lit(0.0))
    any_ = F.lit(False)
    for i in range(len(terms)):
        any_ = any_ | (F.col(f"tf_{i}") > 0)
    # one row of totals
    ranked = counted.where(any_).join(F.broadcast(totals)).select("key.*", F.round(score, 6).alias("score"))
    return ranked.orderBy(F.col("score").desc(), *keys).limit(limit)
