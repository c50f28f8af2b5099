"""Azure OpenAI request-response logs: resource logs exported to storage, and rows of a log table. Both share one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.functions.envelopes import session_of, valid_json
from tracewell.functions.rows import once
from tracewell.sources import listing
from tracewell.sources.dates import window

#: Names under which property bags carry each value, in the order in which they are tried.
REQUEST_KEYS = ("requestBody", "RequestBody", "request", "input")
RESPONSE_KEYS = ("responseBody", "ResponseBody", "response", "output")
MODEL_KEYS = ("modelDeploymentName", "DeploymentName", "modelName", "model")
CALLER_KEYS = ("callerObjectId", "objectId", "oid", "callerId", "identity")
CATEGORY = "RequestResponse"

LINE = "time string, resourceId string, operationName string, category string, resultSignature string, durationMs string, correlationId string, callerIpAddress string, properties variant, broken string"
USAGE = "struct<usage: struct<prompt_tokens: bigint, completion_tokens: bigint, prompt_tokens_details: struct<cached_tokens: bigint>>>"
#: Longer lines are skipped.
LONGEST_LINE = 10 << 20


def _s(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def path_hour(path: Column) -> Column:
    """The hour of a .../y=2024/m=01/d=15/h=10/... path, whose month is the m= before d=; null without one."""
    part = lambda i: F.regexp_extract(path, r"/y=(\d+)/m=(\d+)/d=(\d+)/h=(\d+)/", i)
    return F.try_to_timestamp(F.concat(part(1), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"), F.lpad(part(3), 2, "0"), F.lit(" "), F.lpad(part(4), 2, "0")), F.lit("yyyy-MM-dd HH"))


def bag(properties: Column) -> Column:
    """map<lower-case name, variant> of a JSON object's text; empty for anything else. Of names equal but for case, the first in order of names counts."""
    entries = F.array_sort(F.transform(F.map_entries(F.from_json(properties, "map<string, variant>")), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value"))))

    def known(entries: Column) -> Column:
        names = F.transform(entries, lambda e: F.lower(e["key"]))
        first = F.filter(entries, lambda e, i: F.array_position(names, F.lower(e["key"])) == i + 1)
        return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))

    # the text is parsed once: known() names its argument once for each entry
    parsed = F.get(F.transform(F.array(entries), known), F.lit(0))
    return F.when(F.ltrim(properties).startswith("{"), F.coalesce(parsed, F.create_map().cast("map<string, string>"))).otherwise(F.create_map().cast("map<string, string>"))


def _first(props: Column, names: tuple[str, ...]) -> Column:
    """JSON text of the first of names that is there and not null."""
    return F.coalesce(*(F.nullif(F.try_element_at(props, F.lit(n.lower())), F.lit("null")) for n in names))


def _plain(json: Column) -> Column:
    """What a JSON string says, else null."""
    return F.when(json.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v"))


def _body(json: Column, inner: Column) -> Column:
    """A body of a property bag, of its member and what that says: JSON as it is (keys sorted), or what a string holds if that is JSON; empty without one."""
    return F.coalesce(F.when(valid_json(inner), inner), json, F.lit(""))


def error_code(response: Column, status: Column) -> Column:
    """error.code of the response if it is a string, else HTTP and the status unless that is empty or starts with 2."""
    code = F.try_variant_get(F.try_parse_json(response), "$.error.code", "variant")
    named = F.when(F.schema_of_variant(code) == "STRING", F.try_variant_get(code, "$", "string"))
    return F.coalesce(F.nullif(named, F.lit("")), F.when((status != "") & ~status.startswith("2"), F.concat(F.lit("HTTP "), status)), F.lit(""))


def _records(rows: DataFrame) -> DataFrame:
    """Invocations of rows (at, operation, status, request_id, latency, resource, resource_group, caller_ip, properties)."""
    rows = once(rows, props=bag(F.col("properties")))
    rows = once(rows, asked=_first(F.col("props"), REQUEST_KEYS), answered=_first(F.col("props"), RESPONSE_KEYS))
    rows = once(rows, asked_says=_plain(F.col("asked")), answered_says=_plain(F.col("answered")))
    rows = once(rows, input_body=_body(F.col("asked"), F.col("asked_says")), output_body=_body(F.col("answered"), F.col("answered_says")))
    rows = once(rows, u=F.when(F.ltrim("output_body").startswith("{"), F.from_json("output_body", USAGE)["usage"]))
    group = F.coalesce(F.nullif(text.arm_segment(F.col("resource"), "resourcegroups"), F.lit("")), F.col("resource_group"))
    extra = F.create_map(F.lit("subscription"), text.arm_segment(F.col("resource"), "subscriptions"), F.lit("resourceGroup"), group, F.lit("callerIp"), F.col("caller_ip"))
    count = lambda c: F.coalesce(F.col(f"u.{c}"), F.lit(0)).cast("long")
    return rows.select(
        F.unix_micros("at").alias("ts"), F.coalesce(F.date_format("at", "yyyyMMdd"), F.lit("")).alias("day"), F.xxhash64("request_id", "at", "properties").alias("n"), F.lit("azure").alias("provider"), "request_id", _s(_plain(_first(F.col("props"), CALLER_KEYS))).alias("principal"), "operation",
        _s(_plain(_first(F.col("props"), MODEL_KEYS))).alias("model_id"), "status", error_code(F.col("output_body"), F.col("status")).alias("error_code"), F.coalesce(F.col("latency").try_cast("double").try_cast("long"), F.lit(0).cast("long")).alias("latency_ms"), F.map_filter(extra, lambda k, v: v != "").alias("extra"),
        count("prompt_tokens").alias("input_tokens"), count("completion_tokens").alias("output_tokens"), count("prompt_tokens_details.cached_tokens").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_write_tokens"), "input_body", "output_body", session_of(F.lit("openai"), F.col("input_body")).alias("session_id"),
    )


#: Why lines of resource logs are skipped, in the order in which it is looked for.
SKIPPED = ("blank", "too_long", "malformed", "no_time", "other_category", "outside_window")


def read_storage(spark: SparkSession, root: str, start: str = "", end: str = "", skipped: Observation | None = None) -> DataFrame:
    """Invocations of the exported resource logs under root (JSON lines in .json files) of the days start to end (YYYY-MM-DD, both included).

    Files are chosen by the hour of their path, and folders of other hours are not listed; files without an hour are read
    as well. Then lines are filtered by their own time. Blank and malformed lines, lines of other categories and lines
    without a time are skipped; skipped gets the number of lines and of those skipped (SKIPPED) from the job that reads.
    """
    first, last = window(start, end)
    lines = listing.texts(spark, listing.paths(spark, root, listing.HOURS, first, last), pathGlobFilter="*.json")
    # recursive lookup leaves y= and the like in the path alone; they are no columns
    hour = path_hour(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    if first:
        lines = lines.where(hour.isNull() | (hour >= F.lit(first)))
    if last:
        lines = lines.where(hour.isNull() | (hour < F.lit(last)))
    long = F.octet_length("value") > LONGEST_LINE
    r = F.when(~long, F.from_json("value", LINE, {"columnNameOfCorruptRecord": "broken"}))
    rows = lines.withColumn("r", r).withColumn("at", F.try_to_timestamp("r.time"))
    outside = (F.lit(False) if first is None else F.col("at") < F.lit(first)) | (F.lit(False) if last is None else F.col("at") >= F.lit(last))
    malformed = F.col("r.broken").isNotNull() | ~F.ltrim("value").startswith("{")
    why = listing.reason(("blank", F.trim("value") == ""), ("too_long", long), ("malformed", malformed), ("no_time", F.col("at").isNull()), ("other_category", ~F.lower(_s(F.col("r.category"))).isin("", CATEGORY.lower())), ("outside_window", outside))
    rows = listing.counted(rows.withColumn("reason", why), SKIPPED, skipped)
    f = lambda c: _s(F.col(f"r.{c}"))
    given = F.to_json("r.properties")
    return _records(rows.select("at", f("operationName").alias("operation"), f("resultSignature").alias("status"), f("correlationId").alias("request_id"), f("durationMs").alias("latency"), f("resourceId").alias("resource"), F.lit("").alias("resource_group"), f("callerIpAddress").alias("caller_ip"), F.coalesce(F.when(given.startswith('"'), _plain(given)).otherwise(given), F.lit("")).alias("properties")))


def from_table(rows: DataFrame, start: str = "", end: str = "", resource: str = "", subscription: str = "") -> DataFrame:
    """Invocations of a log table's rows (TimeGenerated, OperationName, DurationMs, ResultSignature, CorrelationId, _ResourceId,
    CallerIPAddress, Category, ResourceGroup, properties_s), of the days start to end, optionally of one resource or subscription.

    Absent columns and nulls are empty. A row without time, request id and both bodies is dropped.
    """
    first, last = window(start, end)
    c = lambda name: _s(F.col(name)) if name in rows.columns else F.lit("")
    at = F.try_to_timestamp(F.col("TimeGenerated").cast("string"))
    kept = rows.where(F.lower(c("Category")).isin("", CATEGORY.lower()))
    kept = kept.where(F.lit(True) if first is None else at >= F.lit(first)).where(F.lit(True) if last is None else at < F.lit(last))
    kept = kept.where(F.contains(F.lower(c("_ResourceId")), F.lit(resource.lower()))) if resource else kept
    kept = kept.where(c("SubscriptionId") == subscription) if subscription else kept
    made = _records(kept.select(at.alias("at"), c("OperationName").alias("operation"), c("ResultSignature").alias("status"), c("CorrelationId").alias("request_id"), c("DurationMs").alias("latency"), c("_ResourceId").alias("resource"), c("ResourceGroup").alias("resource_group"), c("CallerIPAddress").alias("caller_ip"), c("properties_s").alias("properties")))
    return made.where("ts is not null or request_id <> '' or input_body <> '' or output_body <> ''")
