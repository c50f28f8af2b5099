"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source's documents get whole copies floor(target / source size) for certain. The rest of the target is a sample of
fixed size without replacement: every document has an inclusion probability lambda and a uniform number u, and those with
the smallest [u / (1 - u)] / [lambda / (1 - lambda)] are taken, until the words wanted are reached. lambda is unequal: it
falls with the fourth root of a document's size, so that one long document displaces fewer short ones.

Scale: only (source, id, size) is shuffled. The order inside a source is cut into BUCKETS ranges of the rank; sums of
ranges are accumulated per source (BUCKETS rows at most) and then within a range, so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Fixed values of the mix: weights in turn over the sources, and the most copies of a source.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BUCKETS = 4096
#: The order of a source's rows; h is a hash of the row.
ORDER = ("rank", "id", "size", "h")
#: Copies of one row that one row of a shuffle stands for.
CHUNK = 1000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*keys: Column) -> Column:
    """A reproducible number in (0, 1) with 52 bits from the md5 of keys; null is spelled as an empty string."""
    text = F.concat_ws(":", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, damp, target) of sizes (source, size, ...).

    All words are shared by weight; a target stops at most times its source's size and the excess is shared by weight
    among the others. Sorted by limit / weight, a source stops exactly if its limit is under what the weight gets of all
    that the sources before it leave. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.pow(F.greatest("size", F.lit(1)).cast("double"), F.lit(-0.25))).alias("damp"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), ((turn % len(weights)) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * most)
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", left / weights_left).withColumn("full", F.col("most") / F.col("weight") <= F.col("level"))
    # the level of the first source that does not stop holds for all after it
    level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * level)
    return per.select("source", "source_size", (F.col("damp") / F.greatest("source_size", F.lit(1))).alias("damp"), target.alias("target"))


def _ranked(docs: DataFrame, shared: DataFrame, seed: int) -> DataFrame:
    """docs (id, source, size, h, ...) with its source's sizes and target, whole copies, words needed beyond them, and rank in (0, 1)."""
    docs = docs.join(shared.withColumnRenamed("source", "key"), F.col("source").eqNullSafe(F.col("key"))).drop("key")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    docs = docs.withColumn("whole", F.floor(F.round(ratio, 9)).cast("long"))
    docs = docs.withColumn("need", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    share = F.when(F.col("source_size") > 0, F.col("need") / F.col("source_size")).otherwise(0.0)
    p = F.least(F.greatest(share * F.pow(F.greatest("size", F.lit(1)).cast("double"), F.lit(-0.25)) / F.greatest(F.col("damp"), F.lit(1e-12)), F.lit(0.001)), F.lit(0.999))
    # rows without an id draw by their content, so that they do not stand together
    drawn = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("h"), F.col("h").cast("string")))
    docs = docs.withColumn("u", uniform(F.lit(seed), drawn)).withColumn("p", p)
    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    return docs.withColumn("rank", rank / (1 + rank))


def _sampled(docs: DataFrame) -> DataFrame:
    """_ranked rows with more: whether the sample beyond the whole copies takes them."""
    docs = docs.withColumn("bucket", F.floor(F.col("rank") * BUCKETS).cast("int"))
    sums = docs.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select(F.col("source").alias("key"), F.col("bucket").alias("at"), (F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).alias("below"))
    docs = docs.join(sums, F.col("source").eqNullSafe(F.col("key")) & (F.col("bucket") == F.col("at")))
    run = Window.partitionBy("source", "bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("below") + F.sum("size").over(run) - F.col("size") / 2
    return docs.withColumn("more", (F.col("need") > 0) & (middle <= F.col("need")))


def _copies(more: Column) -> Column:
    return F.least(F.col("whole") + more.cast("long"), F.lit(MOST_COPIES).cast("long"))


def mix(documents: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: Column | None = None, seed: int = 7) -> DataFrame:
    """(id_col, source, size, source_size, target, copies, taken) for every row of documents.

    size defaults to the words of text_col. Null text has size 0; null source is a source of its own, after all others; a
    source without words has target 0 and no copies. Rows that share an id share u; rows with a null id draw by their text.
    Rows equal in all that orders them keep an arbitrary but interchangeable order. An empty table gives an empty
    result. Other columns do not matter, whatever their names.
    """
    size = n_words(F.col(text_col)) if size is None else size
    docs = documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), F.xxhash64(text_col).alias("h"))
    docs = _sampled(_ranked(docs, source_targets(docs), seed)).withColumn("copies", _copies(F.col("more")))
    return docs.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def taken(documents: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7) -> DataFrame:
    """columns of documents, every row as often as mix takes it; only ids, sizes and hashes are shuffled, not texts.

    The sample of a source is a prefix of its ORDER, so its last member decides for every row where it lies. Of rows equal
    to the last one, as many are taken as the sample has: they are told by number and copied from one of them. Null, empty
    and repeated rows and empty tables are as in mix.
    """
    source, size, h = F.col(source_col), n_words(F.col(text_col)), F.xxhash64(text_col)
    docs = written(documents.select(F.col(id_col).alias("id"), source.alias("source"), size.alias("size"), h.alias("h")), "sizes")
    shared = written(source_targets(docs), "targets")
    counted = _sampled(_ranked(docs, shared, seed)).where("more").groupBy("source", *ORDER).agg(F.count("*").alias("n"))
    last = counted.groupBy("source").agg(F.max(F.struct(F.struct(*ORDER).alias("at"), "n")).alias("last"))
    last = written(shared.join(last.withColumnRenamed("source", "key"), F.col("source").eqNullSafe(F.col("key")), "left").drop("key"), "targets")

    rows = documents.select(F.struct(*columns).alias("row"), F.col(id_col).alias("id"), source.alias("source"), size.alias("size"), h.alias("h"))
    more = F.coalesce(F.struct(*ORDER) < F.col("last.at"), F.lit(False))
    copies = _ranked(rows, last, seed).withColumn("copies", _copies(more)).where("copies > 0")
    once = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row")
    # the rows at the border itself, found by id and hash before their words are counted
    border = last.where("last is not null").select(F.col("source").alias("key"), F.col("last.at.id").alias("last_id"), F.col("last.at.h").alias("last_h"), F.col("last.n").alias("n"))
    edge = documents.select(F.struct(*columns).alias("row"), F.col(id_col).alias("id"), source.alias("source"), h.alias("h"))
    edge = edge.join(border, F.col("source").eqNullSafe(F.col("key")) & F.col("id").eqNullSafe(F.col("last_id")) & (F.col("h") == F.col("last_h")))
    edge = edge.groupBy("key").agg(F.first("row").alias("row"), F.first("n").alias("n"))
    edge = edge.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))).repartition("key", "chunk")
    edge = edge.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK).cast("long"), F.col("n") - F.col("chunk") * CHUNK)))).select("row")
    return once.unionByName(edge).select("row.*")
