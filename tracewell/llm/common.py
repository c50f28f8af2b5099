"""The words of texts, tables by name and connected components; the shared folder as the operators call it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.scratch import scratch, shared_dir, written  # noqa: F401

#: Bytes that end a word: space and \x09-\x0D. The same set in Java's and RE2's regex syntax.
WORD = r"[^\x20\x09-\x0D]+"

#: A key with more than this share of the rows is hot, so there are fewer than a thousand; a hot key is split so many ways.
HOT = 1 / 1000
WAYS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_keys(counts: DataFrame, key: str, rows: int) -> list[int]:
    """Hashes of the hot keys of counts (key, n: rows with it); rows is how many there are in all, so the list is bounded."""
    return [r[0] for r in counts.where(F.col("n") > F.lit(rows * HOT)).select(F.xxhash64(key)).collect()]


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, hot: list[int], by: Column, how: str = "inner") -> DataFrame:
    """rows joined to keyed (one row a key) by key; rows of a hot key are dealt WAYS ways by the hash by, and its one row is copied."""
    is_hot = F.xxhash64(key).isin(hot) if hot else F.lit(False)
    dealt = rows.withColumn("_way", F.when(is_hot, F.pmod(by, F.lit(WAYS)).cast("int")).otherwise(F.lit(0)))
    copied = keyed.withColumn("_way", F.explode(F.sequence(F.lit(0), F.when(is_hot, F.lit(WAYS - 1)).otherwise(F.lit(0)))))
    return dealt.join(copied, [key, "_way"], how).drop("_way")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (src, dst: long); component is the smallest node reachable.

    Alternates large-star and small-star rounds until every edge leads from a node straight to its component's smallest
    node. Every round is two pre-aggregated minima and two joins, so a node with very many neighbours is never one task's
    group, and no link reaches the driver. Null ends and loops are ignored. Raises if it has not settled after max_rounds
    (the rounds grow with the logarithm of the diameter).
    """
    edges = written(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        # stars: no node leads to two, and none that leads to another is led to
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if not ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1 and out > 0").take(1):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.where("u <> v").distinct(), "edges")
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
