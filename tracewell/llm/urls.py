"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the URLs that no rule fits.

The trees are Spark ML's, fitted on at most TRAIN_ROWS labelled URLs (a bounded sample in hash order). Statistics of
suffixes and of the first segments of paths cover all labelled URLs; a labelled URL gets those of the other FOLDS - 1 folds, so its own label is in none of its
features. Features are native expressions.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_spread, written

#: Fixed values of the filter: (rule, verdict); the host is what stands before the first slash.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
TRAIN_ROWS = 20_000
TREES = 12
DEPTH = 3
FOLDS = 5
FEATURES = ("length", "host_length", "labels", "depth", "digits", "entropy", "parameters", "hyphens", "suffix_rate", "head_rate")
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def _lower_ascii(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def host(url: Column) -> Column:
    return F.coalesce(_lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host_: Column, path_: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null. rules: a short list, checked one by one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        on, _, under = rule.partition("/")
        fits = ((host_ == on) | host_.endswith("." + on)) & path_.startswith("/" + under)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(url: Column, host_: Column, path_: Column) -> list[Column]:
    """Length, depth, digit ratio, entropy of characters, counts of parameters, labels and hyphens."""
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    shares = F.transform(F.array_distinct(F.split(url, "")), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return [
        F.length(url).cast("double").alias("length"), F.length(host_).cast("double").alias("host_length"), F.regexp_count(host_, F.lit(r"[^.]+")).cast("double").alias("labels"),
        F.regexp_count(path_, F.lit("/")).cast("double").alias("depth"), (F.regexp_count(url, F.lit("[0-9]")) / n).alias("digits"), entropy.alias("entropy"),
        F.regexp_count(url, F.lit("[?&][^&#]")).cast("double").alias("parameters"), F.regexp_count(host_, F.lit("-")).cast("double").alias("hyphens"),
    ]


def suffix(host_: Column) -> Column:
    return F.substring_index(host_, ".", -1)


def head(path_: Column) -> Column:
    """The first segment of the path."""
    return F.get(F.split(path_, "/"), F.lit(1))


def with_features(urls: DataFrame) -> DataFrame:
    """urls (id, url, host, path, label: 1 block, 0 allow, null unknown) with FEATURES.

    The rate of a suffix, or of a path's head, is its share of blocked URLs among labelled ones, drawn towards one half by five
    pseudo-rows: among all of them for an unlabelled URL, among those of other folds for a labelled one. Equal URLs are of
    one fold. Rows of a frequent suffix or head are dealt over many tasks.
    """
    out = urls.select("*", *lexical(F.col("url"), F.col("host"), F.col("path"))).withColumn("suffix", suffix(F.col("host"))).withColumn("head", F.coalesce(head(F.col("path")), F.lit("")))
    out = out.withColumn("fold", F.when(F.col("label").isNotNull(), F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")))
    own = lambda n: F.coalesce(F.element_at(F.array(*(F.col(f"{n}_{i}") for i in range(FOLDS))), F.col("fold") + 1), F.lit(0))
    rate = (F.col("blocked") - own("b") + 2.5) / (F.col("seen") - own("n") + 5)
    counts = [f(F.when(F.col("fold") == i, F.col("label"))).alias(f"{n}_{i}") for i in range(FOLDS) for n, f in (("b", F.sum), ("n", F.count))]
    rows = urls.count()
    for by in ("suffix", "head"):
        hot = hot_keys(out.groupBy(by).agg(F.count("*").alias("n")), by, rows)
        folds = out.where("label is not null").groupBy(by).agg(F.sum("label").alias("blocked"), F.count("label").alias("seen"), *counts)
        out = join_spread(out, folds, by, hot, F.xxhash64("id", "url"), "left").withColumn(f"{by}_rate", F.coalesce(rate, F.lit(0.5))).drop("blocked", "seen", *(f"{n}_{i}" for n in "bn" for i in range(FOLDS)))
    return out


def assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def train(featured: DataFrame, rows: int = TRAIN_ROWS) -> GBTClassificationModel | float:
    """Trees fitted on at most so many labelled URLs, or on the one label there is (0.0 without labels).

    They are the first in hash order of a range of hashes that holds about as many, so few more are ever sorted.
    """
    labelled = featured.where("label is not null")
    share = rows / max(1, labelled.count())
    if share < 1:
        labelled = labelled.where(F.xxhash64("id", "url") < F.lit(int(share * (1 << 64)) - (1 << 63)))
    sample = labelled.select("label", *FEATURES, "url").orderBy(F.xxhash64("url"), "url").limit(rows).drop("url")
    sample = written(sample.withColumn("label", F.col("label").cast("double")), "urls")
    seen = [r[0] for r in sample.select("label").distinct().collect()]
    if len(seen) < 2:
        return seen[0] if seen else 0.0
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=7, stepSize=0.3).fit(assembled(sample))


def held_out_error(featured: DataFrame, fold: int = 0) -> float | None:
    """The share of labelled URLs of a fold that trees fitted on the other folds get wrong; None without any."""
    model = train(featured.where(F.col("fold") != fold))
    wrong = score(featured.where(F.col("fold") == fold), model).select(F.avg(((F.col("block_score") > 0.5) != (F.col("label") == 1)).cast("double")))
    return wrong.first()[0]


def score(featured: DataFrame, model: GBTClassificationModel | float) -> DataFrame:
    """featured with block_score, the probability of block."""
    if isinstance(model, float):
        return featured.withColumn("block_score", F.lit(model))
    scored = model.transform(assembled(featured))
    return scored.withColumn("block_score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(id_col, host, path, rule, verdict, block_score) of every row.

    Verdicts of rules are the labels; URLs without a rule are judged by the trees. Null URLs and those without :// have an
    empty host and path and are judged like others. Repeated rows get equal verdicts; an empty table gives an empty result.
    Other columns do not matter, whatever their names.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rows = rows.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("label", F.when(F.col("ruled.verdict") == "block", 1).when(F.col("ruled").isNotNull(), 0))
    featured = with_features(rows)
    scored = score(featured, train(featured))
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), F.round("block_score", 6).alias("block_score"))
