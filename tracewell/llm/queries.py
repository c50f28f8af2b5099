"""The registered queries of the ten operators and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, packing, periods, phrases, pii, prefixes, quality, secrets, simhash, tokenfile, urls, vectors, warc
from .common import WORD, table

TOKENIZER = "byte_bpe_50k.json"
#: End ids of a document in the token files and in packed sequences.
FILE_END = 2
PACK_END = 0


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = tokenfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), FILE_END)
    return tokenfile.read(shards).withColumnRenamed("id", "doc_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), columns=("doc_id",))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secrets.spelled(F.col("base")), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), PACK_END)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op10_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.dedupe(table(spark, sf_dir, "documents"))


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.identifiers(table(spark, sf_dir, "documents"))
    # a second parameter of the function would be the place in the array
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(secrets.spelled(F.col("base"), pii.KINDS), 256).alias("base_sha256"), secrets.spelled(F.col("spans"), pii.KINDS).alias("spans"))


def private_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op 11 that SQL can express."""
    return op11_private_data(spark, sf_dir).select("doc_id", *(f"n_{kind}" for kind in pii.KINDS))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return prefixes.rebuilt_trie(table(spark, sf_dir, "conversations"), F.crc32(c.cast("string").cast("binary")) % 9, c - c % 5)


def _made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by the CRC of their ids, with their words repeated from some place on."""
    crc = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    split = crc.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))).withColumn("n", F.size("words"))
    split = split.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.col("g") % F.greatest("n", F.lit(1))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)
    repeated = F.transform("words", lambda _, i: F.get("words", at(i).cast("int")))
    return split.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(_made_periodic(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("under"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    shown = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.before"), F.col("best.length"), -F.col("best.under")
    return shown.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op 2 that SQL can express."""
    return op2_quality_rules(spark, sf_dir).select("doc_id", *quality.STATS, "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op 6 that SQL can express."""
    return op6_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def queries() -> dict:
    import corpus_pipeline

    ops = (op1_token_file, op2_quality_rules, op3_vector_links, op4_source_mix, op5_warc, op6_url_filter, op7_secret_scan, op8_simhash, op9_packing, op10_repeated_phrases, op11_private_data, op12_prefix_trie, op13_periodic_runs)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run, "quality_base": quality_base, "url_rules": url_rules, "private_counts": private_counts}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return dict(ORACLES)
