"""Queries over readers, exports and labels: logs and tables of each source made from the star-schema tables, read back, and compared in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.plans.adapters import facts, invocation_bodies
from tracewell.plans.catalog import _CONV, _TURNS, FIVE_MINUTES, query
from tracewell.operators import pairing
from tracewell.sources import azure, bedrock, daily, export, vertex
from tracewell.sources.scratch import scratch


def _events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.withColumn("at", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


_E = "(SELECT *, (props->>'$.k')::BIGINT AS k, strftime(ts, '%Y%m%d') AS day FROM events)"
_SESSION = "CASE WHEN k % 3 = 0 THEN 's' || k ELSE '' END"


def _marker(k):
    return F.when(k % 3 == 0, F.concat(F.lit("user_x_account__session_s"), k.cast("string"))).otherwise(F.lit("user_x"))


@query(f"""SELECT event_id::VARCHAR AS request_id, epoch_us(ts) AS ts, day, event_type AS operation, CASE WHEN event_type = 'error' THEN '429' ELSE '200' END AS status, CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'slow' ELSE 'HTTP 429' END ELSE '' END AS error_code,
 k AS latency_ms, 'gpt-' || user_id % 3 AS model_id, 'u' || user_id AS principal, k AS input_tokens, k * 2 AS output_tokens, k // 4 AS cache_read_tokens, {_SESSION} AS session_id, 'g' || user_id % 5 AS resource_group FROM {_E} e""")
def azure_table_records(spark, sf_dir):
    """Rows of a log table whose property bags hold bodies, model and caller under differing names."""
    e, k = _events(spark, sf_dir), F.col("k")
    model, caller = F.concat(F.lit("gpt-"), (F.col("user_id") % 3).cast("string")), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    asked = F.to_json(F.struct(_marker(k).alias("user")))
    usage = F.struct(k.alias("prompt_tokens"), (k * 2).alias("completion_tokens"), F.struct(F.floor(k / 4).alias("cached_tokens")).alias("prompt_tokens_details"))
    answered = F.to_json(F.struct(usage.alias("usage"), F.when((F.col("event_type") == "error") & (k % 2 == 0), F.struct(F.lit("slow").alias("code"))).alias("error")))
    bag = F.when(k % 2 == 0, F.to_json(F.struct(model.alias("modelDeploymentName"), caller.alias("callerObjectId"), asked.alias("requestBody"), answered.alias("responseBody")))).otherwise(F.to_json(F.struct(model.alias("MODEL"), caller.alias("oid"), asked.alias("Input"), answered.alias("output"))))
    rows = e.select(F.col("at").alias("TimeGenerated"), F.col("event_type").alias("OperationName"), k.cast("string").alias("DurationMs"), F.when(F.col("event_type") == "error", "429").otherwise("200").alias("ResultSignature"), F.col("event_id").cast("string").alias("CorrelationId"), F.concat(F.lit("/subscriptions/s/resourceGroups/g"), (F.col("user_id") % 5).cast("string"), F.lit("/providers/p")).alias("_ResourceId"), F.lit("RequestResponse").alias("Category"), bag.alias("properties_s"))
    made = azure.from_table(rows)
    return made.select("request_id", "ts", "day", "operation", "status", "error_code", "latency_ms", "model_id", "principal", "input_tokens", "output_tokens", "cache_read_tokens", "session_id", F.element_at("extra", "resourceGroup").alias("resource_group"))


@query(f"""SELECT CASE WHEN k % 10 = 0 OR event_id = 0 THEN 'gemini-' || user_id % 3 || '-' || strftime(ts, '%Y%m%dT%H%M%S.%f') || '000Z' ELSE event_id::VARCHAR END AS request_id, epoch_us(ts) AS ts, day, CASE WHEN k % 2 = 0 THEN 'streamGenerateContent' ELSE 'generateContent' END AS operation,
 'gemini-' || user_id % 3 AS model_id, CASE WHEN event_type = 'error' THEN 'BUSY' ELSE '' END AS error_code, CASE WHEN k % 2 = 0 THEN 2 * k ELSE k END AS input_tokens, k AS output_tokens, {_SESSION} AS session_id, 'p' || user_id % 5 AS project FROM {_E} e""")
def vertex_table_records(spark, sf_dir):
    """Rows of a logging table: whole and chunked replies, requests in two pieces, and rows without an id."""
    e, k = _events(spark, sf_dir), F.col("k")
    endpoint = F.concat(F.lit("projects/p"), (F.col("user_id") % 5).cast("string"), F.lit("/locations/l/publishers/google/models/gemini-"), (F.col("user_id") % 3).cast("string"))
    asked = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"))).alias("contents"), F.struct(F.array(F.struct(_marker(k).alias("text"))).alias("parts")).alias("systemInstruction")))
    reply = lambda n: F.to_json(F.struct(F.struct(n.alias("promptTokenCount"), k.alias("candidatesTokenCount")).alias("usageMetadata"), F.when(F.col("event_type") == "error", F.struct(F.lit("BUSY").alias("status"))).alias("error")))
    half = F.floor(F.length(asked) / 2).cast("int")
    rows = e.select(endpoint.alias("endpoint"), F.lit("").alias("deployed_model_id"), F.col("at").alias("logging_time"), F.when(k % 10 == 0, F.lit(0)).otherwise(F.col("event_id")).cast("decimal(20,0)").alias("request_id"), F.when(k % 3 == 1, F.array(F.left(asked, half), F.substr(asked, half + 1))).otherwise(F.array(asked)).alias("request_payload"), F.when(k % 2 == 0, F.array(reply(k), F.lit("broken"), reply(k * 2))).otherwise(F.array(reply(k))).alias("response_payload"))
    made = vertex.records(rows)
    return made.select("request_id", "ts", "day", "operation", "model_id", "error_code", "input_tokens", "output_tokens", "session_id", F.element_at("extra", "project").alias("project"))


@query(f"""SELECT event_id::VARCHAR AS request_id, epoch_us(ts) AS ts, day, 'm' || user_id % 3 AS model_id, CASE WHEN event_type = 'error' THEN 'Throttled' ELSE '' END AS error_code, 'arn-' || user_id AS principal, k AS input_tokens, 2 * k AS output_tokens, {_SESSION} AS session_id, 'r' || user_id % 4 AS region FROM {_E} e""")
def bedrock_log_records(spark, sf_dir):
    """Gzipped JSON lines in the folder of a day, written and read back."""
    e, k = _events(spark, sf_dir), F.col("k")
    root = scratch(spark, "bedrock")
    body = F.struct(F.struct(_marker(k).alias("user_id")).alias("metadata"))
    lines = e.select(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.col("event_id").cast("string").alias("requestId"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("modelId"), F.when(F.col("event_type") == "error", "Throttled").alias("errorCode"), F.struct(F.concat(F.lit("arn-"), F.col("user_id").cast("string")).alias("arn")).alias("identity"), F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("region"), F.struct(body.alias("inputBodyJson"), k.alias("inputTokenCount")).alias("input"), F.struct((2 * k).alias("outputTokenCount")).alias("output"))
    lines.write.option("compression", "gzip").json(f"{root}/AWSLogs/7/2024/01/15/10")
    made = bedrock.read(spark, root, "logs", "2024-01-15", "2024-01-15")
    return made.select("request_id", "ts", "day", "model_id", "error_code", "principal", "input_tokens", "output_tokens", "session_id", F.element_at("extra", "region").alias("region"))


def _exported(spark, sf_dir):
    path = scratch(spark, "export")
    export.write(facts(spark, sf_dir), path, "events")
    return path


@query("SELECT request_id, session_id AS conversation_id, provider, model_id, error_code, input_tokens, cache_write_tokens, thread_id, num_messages FROM {facts} f WHERE session_id <> ''")
def exported_facts(spark, sf_dir):
    """Facts of an export of all invocations, read back; those of sessions, whose conversations are named by them."""
    return export.read(spark, _exported(spark, sf_dir)).where("session_id <> ''").select("request_id", "conversation_id", "provider", "model_id", "error_code", "input_tokens", "cache_write_tokens", "thread_id", "num_messages")


@query("SELECT count(*) AS conversations, sum(invocations)::BIGINT AS invocations, sum(input_tokens)::BIGINT AS input_tokens, sum(cache_write_tokens)::BIGINT AS cache_write_tokens, sum(errors)::BIGINT AS errors, count(DISTINCT day) AS days FROM (" + _CONV.replace("{gap}", FIVE_MINUTES) + ") c")
def export_totals(spark, sf_dir):
    """The totals of an export's manifest."""
    kept = spark.read.json(f"{_exported(spark, sf_dir)}/manifest.json").select("totals.*")
    return kept.select("conversations", "invocations", "input_tokens", "cache_write_tokens", "errors", "days")


@query("SELECT day, count(*) AS conversations, sum(invocations)::BIGINT AS invocations, sum(errors)::BIGINT AS errors FROM (" + _CONV.replace("{gap}", FIVE_MINUTES) + ") c GROUP BY day")
def export_index(spark, sf_dir):
    """The index of days of an export, from its table of conversations."""
    return export.index(spark, _exported(spark, sf_dir)).select("day", "conversations", "invocations", "errors")


@query("""SELECT event_id, CASE WHEN event_id * 37 < 1000 THEN event_id * 37 || 'ms' ELSE printf('%.1fs', event_id * 37 / 1000.0) END AS duration, format('{:,}', event_id * 12345) AS digits, left(event_type || '-' || event_id, 8) AS short, CASE WHEN length(props) > 9 THEN left(props, 9) || '...' ELSE props END AS cut FROM events""")
def labels(spark, sf_dir):
    """Durations, grouped digits, short ids and cut texts as they are shown."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    return e.select("event_id", text.duration_label(n * 37).alias("duration"), text.grouped_digits(n * 12345).alias("digits"), text.short_session(F.concat("event_type", F.lit("-"), n.cast("string"))).alias("short"), text.truncated(F.col("props"), 9).alias("cut"))


@query(f"""WITH t AS {_TURNS}, a AS (SELECT conv_id, max(i) AS late, count(*) AS n FROM t WHERE role = 'assistant' AND i > 0 GROUP BY conv_id)
 SELECT conv_id::VARCHAR AS conversation_id, 'conversations/' || conv_id || '.json' AS file, a.n AS invocations, count(*) AS turns, string_agg(role || ':' || text, chr(10) ORDER BY i) AS told, count(*) FILTER (role = 'assistant' AND i > 0) AS measured,
 (SELECT string_agg(conv_id || '-' || i, ',' ORDER BY i) FROM t s WHERE s.conv_id = t.conv_id AND s.role = 'assistant' AND s.i > 0) AS request_ids FROM t JOIN a USING (conv_id) WHERE i <= late GROUP BY conv_id, a.n""")
def conversation_files(spark, sf_dir):
    """Conversations of an export as files of their own, read back as JSON."""
    path = scratch(spark, "export")
    export.write(invocation_bodies(spark, sf_dir), path, as_files=True)
    c = export.from_files(spark, path)
    told = F.transform("conversation.turns", lambda t: F.concat(t["role"], F.lit(":"), F.array_join(F.transform(t["blocks"], lambda b: b["text"]), "\n\n")))
    measured = F.size(F.filter("conversation.turns", lambda t: t["metrics"].isNotNull()))
    return c.select("conversation_id", "file", F.size("invocations").cast("long").alias("invocations"), F.size("conversation.turns").cast("long").alias("turns"), F.array_join(told, "\n").alias("told"), measured.cast("long").alias("measured"), F.array_join(F.transform("invocations", lambda i: i["request_id"]), ",").alias("request_ids"))


def _daily(spark, sf_dir):
    """The days table of an export that got its days in two overlapping updates."""
    path, rows = scratch(spark, "daily"), facts(spark, sf_dir)
    daily.update(rows.where(F.col("day") < "20240120"), path)
    daily.update(rows.where(F.col("day") >= "20240110"), path)
    return daily.read(spark, path, "days")


@query("SELECT day, count(*) AS invocations, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) FILTER (error_code <> '') AS errors, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT operation) AS operations FROM {facts} f GROUP BY day")
def daily_updates(spark, sf_dir):
    """Days of an export, some of them written twice."""
    return _daily(spark, sf_dir).select("day", "invocations", "input_tokens", "output_tokens", "errors", "first_ts", "last_ts", F.size("by_operation").cast("long").alias("operations"))


@query("""WITH x AS (SELECT count(*) AS n, count(DISTINCT CASE WHEN session_id <> '' THEN provider || chr(0) || session_id END) AS sessions FROM {facts} f)
 SELECT n AS invocations, sessions, true AS sessions_near, true AS p50_near, true AS p90_near, true AS p99_near FROM x""")
def merged_estimates(spark, sf_dir):
    """Estimates from the merged sketches of days, held against exact numbers: within 4 % of sessions, 1 % of ranks."""
    got = daily.totals(_daily(spark, sf_dir)).select("invocations", F.col("sessions").alias("about"), "p50", "p90", "p99")
    key = F.when(F.col("session_id") != "", F.concat_ws("\0", "provider", "session_id"))
    exact = facts(spark, sf_dir).crossJoin(F.broadcast(got.select("p50", "p90", "p99")))
    below = (F.avg(F.when(F.col("output_tokens") < F.col(p), 1.0).otherwise(0.0)) - share <= 0.01 for p, share in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))
    upto = (share - F.avg(F.when(F.col("output_tokens") <= F.col(p), 1.0).otherwise(0.0)) <= 0.01 for p, share in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))
    near = exact.agg(F.count_distinct(key).alias("sessions"), *((b & u).alias(f"{p}_near") for b, u, p in zip(below, upto, ("p50", "p90", "p99"), strict=True)))
    return got.crossJoin(near).select("invocations", "sessions", (F.abs(F.col("about") - F.col("sessions")) <= 0.04 * F.col("sessions")).alias("sessions_near"), "p50_near", "p90_near", "p99_near")


_CHAINS = "(SELECT conv_id AS c, count(*) AS k FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL GROUP BY conv_id)"


@query(f"""WITH c AS {_CHAINS}, b AS (SELECT a.c, a.k, a.c % 3 = 0 OR p.c IS NULL OR p.c % 7 = 0 AS starts FROM c a LEFT JOIN c p ON p.c = a.c - 1),
 t AS (SELECT *, max(CASE WHEN starts THEN c END) OVER (ORDER BY c) AS first FROM b)
 SELECT c || '-' || i AS uuid, first || '-1' AS thread_id, CASE WHEN c % 7 = 0 AND i = k THEN '' ELSE 'm' || c || '-' || i END AS message_id FROM t, unnest(range(1, k + 1)) r(i)""")
def paired_requests(spark, sf_dir):
    """Conversations as chains of requests, two of three continuing the one before; every seventh one's last answer is missing."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant' and conv_id is not null")
    each = c.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("k")).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "k")))
    before = each.select((F.col("c") + 1).alias("c"), F.col("k").alias("before")).distinct()
    text_of = lambda *parts: F.concat(*(p.cast("string") for p in parts))
    dash, at = F.lit("-"), (F.col("c") * 100_000 + F.col("i")) * 10_000_000
    named = F.when(F.col("i") > 1, text_of(F.lit("m"), F.col("c"), dash, F.col("i") - 1)).when(F.col("c") % 3 != 0, text_of(F.lit("m"), F.col("c") - 1, dash, F.col("before")))
    asked = each.join(before, "c", "left").select(text_of(F.col("c"), dash, F.col("i")).alias("uuid"), F.floor(F.col("c") / 30).cast("string").alias("session_id"), F.col("c").cast("string").alias("chain"), F.col("i").cast("int").alias("num_messages"), at.alias("mtime"), F.coalesce(named, F.lit("")).alias("prev_id"), F.lit("m").alias("model"))
    given = each.where("c % 7 <> 0 or i < k").select(text_of(F.lit("m"), F.col("c"), dash, F.col("i")).alias("message_id"), (at + 5_000_000).alias("mtime"), F.lit("m").alias("model"))
    return pairing.threaded(asked, given).select("uuid", "thread_id", "message_id")
