"""An inverted index for ranked search (BM25), written once as Parquet and asked many times.

A block is BLOCK texts that follow each other. The index holds, for every word and block, the texts of the block that have
the word, how often, how long they are, and the largest share of a score that the word gives any of them. Rows lie in
folders by the word's hash, sorted by word, so a query opens its words' folders only. It first reads the shares: their sum,
weighed by the words' rarity, is the most that a text of a block can score. The blocks that promise most are scored,
which tells what the last result must reach, and of the others only those that promise as much are read at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.search import K1, B, terms_of
from tracewell.sources.scratch import written

BLOCK = 1024
FOLDERS = 64
#: Of so many texts, one task sorts the rows of a folder.
SLICE = 1_000_000
#: Blocks that are scored before the others are compared with them.
FIRST = 16
#: Scores are rounded to so many digits, and promises held to be reached if they are this near.
DIGITS, NEAR = 6, 1e-6
WORDS = "word string, block long, found array<struct<id: long, share: double>>, most double, texts long, folder int"


def _postings(block: int):
    """Batches (id, length, words), by id, to a row (word, block, at, times, lengths) for each word of each block of texts."""

    def of_block(rows: pa.Table, number: int) -> pa.RecordBatch:
        words = rows["words"].combine_chunks()
        coded = words.flatten().dictionary_encode()
        n = len(rows)
        # pairs of a word and a text, by word, then text
        pairs, times = np.unique(coded.indices.to_numpy().astype(np.int64) * n + pc.list_parent_indices(words).to_numpy(), return_counts=True)
        word, text = pairs // n, pairs % n
        begins = np.flatnonzero(np.diff(word, prepend=-1))
        offsets = pa.array(np.append(begins, len(pairs)).astype(np.int32))
        lists = ((rows["id"].to_numpy() - number * block)[text], times, rows["length"].to_numpy()[text])
        numbers = pa.array(np.full(len(begins), number, np.int64))
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(word[begins])), numbers, *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in lists)], ["word", "block", "at", "times", "lengths"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            numbers = held["id"].to_numpy() // block
            # the last block may go on in the next batch
            cuts = [0, *np.flatnonzero(np.diff(numbers)) + 1]
            for first, end in pairwise(cuts):
                yield of_block(held.slice(first, end - first), int(numbers[first]))
            held = held.slice(cuts[-1])
        if held is not None and len(held):
            yield of_block(held, held["id"][0].as_py() // block)

    return counted


def build(texts: DataFrame, path: str, text_col: str = "text") -> None:
    """Writes the index of texts to the new folder path; the other columns are kept as keys of the results.

    Words are as in search.terms_of. Null texts have no words. A block's texts are read by one task, which counts their words,
    so what is shuffled, once, is one row for each word of each block, with places, counts and lengths as whole numbers.
    """
    spark = texts.sparkSession
    keys = F.struct(*(c for c in texts.columns if c != text_col)).alias("key")
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    rows = texts.select(F.monotonically_increasing_id().alias("id"), keys, words.alias("words")).withColumn("length", F.size("words")).where("length > 0")
    # numbers of texts follow each other within what a task reads
    rows.select("id", "key", "length").sortWithinPartitions("id").write.parquet(f"{path}/texts")
    lengths = spark.read.parquet(f"{path}/texts").agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("mean"))
    lengths.coalesce(1).write.json(f"{path}/totals")
    n, mean = lengths.first()
    counted = rows.select("id", "length", "words").mapInArrow(_postings(BLOCK), "word string, block long, at array<int>, times array<int>, lengths array<int>")
    share = lambda times, length: times * (K1 + 1) / (times + K1 * (1 - B + B * length / mean))
    found = F.transform("at", lambda at, i: F.struct((F.col("block") * BLOCK + at).alias("id"), share(F.get("times", i), F.get("lengths", i)).alias("share")))
    # a folder is sorted by a task for every SLICE texts
    dealt = counted.withColumn("folder", F.pmod(F.xxhash64("word"), F.lit(FOLDERS)).cast("int")).repartition("folder", F.pmod(F.xxhash64("block"), F.lit(1 + n // SLICE)))
    blocks = dealt.sortWithinPartitions("folder", "word", "block").select("word", "block", found.alias("found"), F.size("at").cast("long").alias("texts"), "folder")
    blocks.select("word", "block", "found", F.array_max("found.share").alias("most"), "texts", "folder").write.option("compression", "zstd").partitionBy("folder").parquet(f"{path}/words")


@dataclass
class Reading:
    """How many rows of the index (a word in a block) a query's words have, and how many of them were read."""

    rows: int
    read: int


def search(spark: SparkSession, path: str, query: str, limit: int = 10) -> tuple[DataFrame, Reading]:
    """(the limit best texts by score with their keys, what was read) of the index at path.

    Ties fall to the smaller keys, in the order of their columns. Texts without any word of the query are no results; a query
    without words finds nothing. The results equal those of search.bm25 over the texts.
    """
    terms = terms_of(query)
    totals = spark.read.json(f"{path}/totals").first()
    texts = spark.read.parquet(f"{path}/texts")
    index = spark.read.schema(WORDS).parquet(f"{path}/words")
    folders = [r[0] for r in spark.createDataFrame([(t,) for t in terms] or [("",)], "word string").select(F.pmod(F.xxhash64("word"), F.lit(FOLDERS))).distinct().collect()]
    mine = index.where(F.col("folder").isin(folders) & F.col("word").isin(terms))
    # a row per word of the query
    held = {r["word"]: r for r in mine.groupBy("word").agg(F.sum("texts").alias("texts"), F.count("*").alias("rows")).collect()}
    n = totals["n"]
    rarity = F.lit(None).cast("double")
    for word, r in held.items():
        rarity = F.when(F.col("word") == word, F.log((F.lit(n) - r["texts"] + 0.5) / (F.lit(r["texts"]) + 0.5) + 1)).otherwise(rarity)
    promised = written(mine.groupBy("block").agg(F.sum(rarity * F.col("most")).alias("promise"), F.count("*").alias("rows")), "promised")

    def scored(blocks: DataFrame) -> DataFrame:
        found = mine.join(blocks.select("block"), "block", "left_semi").select(rarity.alias("rarity"), F.explode("found").alias("f"))
        return found.groupBy(F.col("f.id").alias("id")).agg(F.round(F.sum(F.col("rarity") * F.col("f.share")), DIGITS).alias("score"))

    first = promised.orderBy(F.desc("promise"), "block").limit(FIRST)
    least = scored(first).orderBy(F.desc("score")).limit(limit).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    reach = least["least"] - NEAR if least["n"] == limit else float("-inf")
    open_ = promised.where(F.col("promise") >= reach)
    read = open_.agg(F.sum("rows")).first()[0] or 0
    results = scored(open_)
    results = written(results.where(F.col("score") >= reach), "results")
    last = results.orderBy(F.desc("score")).limit(limit).agg(F.min("score")).first()[0]
    best = results.where(F.col("score") >= F.lit(last)).join(texts.select("id", "key"), "id").select("key.*", "score")
    return best.orderBy(F.col("score").desc(), *(c for c in best.columns if c != "score")).limit(limit), Reading(sum(r["rows"] for r in held.values()), read)
