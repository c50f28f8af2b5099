"""Hot keys are dealt over many tasks, and what is joined, written or fitted does not change."""

from collections import Counter

from pyspark.sql import functions as F

from tracewell.llm import urls, warc
from tracewell.llm.common import WAYS, hot_keys, join_spread


def test_rows_of_a_hot_key_are_dealt(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 5990, F.concat(F.lit("k"), "id")).alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, "key", 6000)
    assert len(hot) == 2 and len(hot) < 1000  # "hot" and null
    made = join_spread(rows, counts, "key", hot, F.xxhash64("id"), "left")
    got = made.collect()
    assert len(got) == 6000 and Counter(r.n for r in got) == {2000: 2000, 1: 3993, None: 7} and made.columns == ["key", "id", "n"]
    ways = rows.where("key = 'hot'").select(F.pmod(F.xxhash64("id"), F.lit(WAYS)).alias("way")).groupBy("way").count().collect()
    assert len(ways) == WAYS and max(r["count"] for r in ways) < 3 * 2000 / WAYS
    assert join_spread(rows, counts, "key", [], F.xxhash64("id")).count() == 5993
    assert hot_keys(counts.limit(0), "key", 0) == []


def test_copies_of_one_page(spark):
    """A third of the pages are one text, some have ids of their own only, one id stands twice, one is null."""
    given = [(i, f"u{i}", "" if i % 3 == 0 else f"page {i}") for i in range(600)] + [(599, "twice", "page 599"), (None, None, None), (None, "n", "page 1")]
    pages = spark.createDataFrame(given, "page_id long, url string, html string")
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read(warc.write(pages)).collect())
    largest = {}
    for i, _, body in given:
        largest[body or ""] = max(largest.get(body or "", -1), -1 if i is None else i)
    want = Counter((i, *(("response", None) if i == largest[b or ""] else ("revisit", largest[b or ""]))) for i, _, b in given)
    assert got == want


def test_the_sample_is_a_range_of_hashes(spark):
    rows = spark.range(3000).select("id", F.concat(F.lit("http://h"), "id", F.when(F.col("id") % 2 == 0, ".com").otherwise(".org"), F.when(F.col("id") % 3 == 0, "/a").otherwise("/")).alias("url"), (F.col("id") % 2).cast("int").alias("label"))
    rows = rows.withColumn("host", urls.host(F.col("url"))).withColumn("path", urls.path(F.col("url")))
    featured = urls.with_features(rows)
    assert featured.count() == 3000 and featured.where("label = 1").agg(F.min("suffix_rate")).first()[0] > 0.9
    model = urls.train(featured, rows=500)
    wrong = urls.score(featured, model).where((F.col("block_score") > 0.5) != (F.col("label") == 1)).count()
    assert wrong == 0
