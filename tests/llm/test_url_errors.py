"""The trees of op 6 on labelled pages that they have not seen."""

from pyspark.sql import functions as F

from tracewell.llm import urls


def test_held_out_error_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = pages.select(F.col("page_id").alias("id"), "url").withColumn("host", urls.host(F.col("url"))).withColumn("path", urls.path(F.col("url")))
    verdict = urls.rule_of(F.col("host"), F.col("path"))["verdict"]
    featured = urls.with_features(rows.withColumn("label", F.when(verdict == "block", 1).when(verdict.isNotNull(), 0))).cache()
    labelled = featured.where("label is not null")
    share = labelled.agg(F.avg("label")).first()[0]
    assert labelled.count() > 200 and 0.1 < share < 0.9
    error = urls.held_out_error(featured)
    print("held-out error", error, "base rate", min(share, 1 - share))
    assert error < min(share, 1 - share) / 2


def test_own_labels_are_in_no_feature(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.x{i}/p{i}", f"h{i}.x{i}", f"/p{i}", i % 2) for i in range(40)], "id long, url string, host string, path string, label int")
    assert {r[0] for r in urls.with_features(df).select(F.array("suffix_rate", "head_rate").cast("string")).collect()} == {"[0.5, 0.5]"}
