"""Named analytical queries with their SQL equivalents.

Where both engines read the same text, a query is one SQL string over {facts} and the tables; the others are DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import pairing, reconstruct, search, sessionize, text_index
from tracewell.plans.adapters import FACTS_SQL, facts, invocation_bodies, tool_bodies, turns
from tracewell.sources.scratch import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a DataFrame query with its SQL equivalent."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.replace("{facts}", FACTS_SQL)
        return f

    return add


TABLES = ("conversations",)
SHARED = {
    "day_stats": "SELECT day, count(*) AS invocations, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, count(*) FILTER (WHERE error_code <> '') AS errors FROM {facts} f GROUP BY day",
    "run_totals": "SELECT count(*) AS invocations, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) FILTER (WHERE error_code <> '') AS errors, min(ts) AS first_ts, max(ts) AS last_ts FROM {facts} f",
    "day_and_total_grouping_sets": "SELECT coalesce(day, 'all') AS day, count(*) AS invocations, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM {facts} f GROUP BY GROUPING SETS ((day), ())",
    "model_breakdown": "SELECT model_id, count(*) AS invocations FROM {facts} f GROUP BY model_id",
    "op_breakdown": "SELECT day, operation, count(*) AS invocations FROM {facts} f GROUP BY day, operation",
    "spend_by_model": "SELECT provider, model_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(CAST(sum(cache_read_tokens) AS DOUBLE) / nullif(sum(cache_read_tokens + input_tokens), 0), 3) AS cache_hit_ratio FROM {facts} f GROUP BY provider, model_id",
    "spend_by_day": "SELECT day, model_id, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM {facts} f GROUP BY day, model_id",
    "error_rate_by_model": "SELECT model_id, count(*) FILTER (WHERE error_code <> '') AS errors, count(*) AS total, round(CAST(count(*) FILTER (WHERE error_code <> '') AS DOUBLE) / count(*), 4) AS error_rate FROM {facts} f GROUP BY model_id",
    "daily_spend": "SELECT day, CAST(sum(input_tokens + cache_write_tokens) AS BIGINT) AS uncached_input, CAST(sum(cache_read_tokens) AS BIGINT) AS cached_input, CAST(sum(output_tokens) AS BIGINT) AS output FROM {facts} f GROUP BY day",
    "totals_by_model_and_operation": "SELECT CASE WHEN model_id IS NULL THEN 'operation' ELSE 'model' END AS kind, coalesce(model_id, operation) AS name, count(*) AS invocations FROM {facts} f GROUP BY GROUPING SETS ((model_id), (operation))",
    "error_rate": "SELECT provider, count(*) FILTER (WHERE error_code <> '') AS errors, count(*) AS invocations, round(CAST(count(*) FILTER (WHERE error_code <> '') AS DOUBLE) / count(*), 4) AS error_rate FROM {facts} f GROUP BY provider",
    "session_shape": "SELECT provider, session_id, count(*) AS invocations, count(DISTINCT thread_id) AS threads, max(num_messages) AS most_messages FROM {facts} f WHERE session_id <> '' GROUP BY provider, session_id",
    "longest_sessions": "SELECT provider, session_id, max(ts) - min(ts) AS duration_us FROM {facts} f WHERE session_id <> '' GROUP BY provider, session_id ORDER BY duration_us DESC, provider, session_id LIMIT 10",
    "stop_reason_dist": "SELECT stop_reason, count(*) AS n FROM {facts} f WHERE stop_reason <> '' GROUP BY stop_reason",
    "main_vs_sidechain": "SELECT CASE WHEN thread_id = 'main' THEN 'main' ELSE 'sidechain' END AS kind, count(*) AS n, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM {facts} f GROUP BY CASE WHEN thread_id = 'main' THEN 'main' ELSE 'sidechain' END",
    "top_conversations": "SELECT principal, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM {facts} f GROUP BY principal ORDER BY input_tokens DESC, principal LIMIT 20",
    "union_runs": "SELECT run, count(*) AS n FROM (SELECT 'a' AS run, request_id FROM {facts} f WHERE n % 3 <> 0 UNION ALL SELECT 'b', request_id FROM {facts} g WHERE n % 3 <> 1) r GROUP BY run",
    "dedup_overlap": "SELECT request_id, run FROM (SELECT request_id, run, row_number() OVER (PARTITION BY request_id ORDER BY run) AS k FROM (SELECT 'a' AS run, request_id FROM {facts} f WHERE n % 3 <> 0 UNION ALL SELECT 'b', request_id FROM {facts} g WHERE n % 3 <> 1) r) x WHERE k = 1",
    "role_volume": "SELECT role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS characters FROM {conversations} c GROUP BY role",
    "turn_index": "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn_index, role FROM {conversations} c",
}


def _shared(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
        return spark.sql(sql, **given, **({"facts": facts(spark, sf_dir)} if "{facts}" in sql else {}))

    return run


for _name, _sql in SHARED.items():
    QUERIES[_name] = _shared(_sql)
    for _t in TABLES:
        _sql = _sql.replace("{" + _t + "}", _t)
    ORACLES[_name] = _sql.replace("{facts}", FACTS_SQL)

_GAPS = """SELECT request_id, day, provider, model_id, principal, CAST(sum(opened) OVER (PARTITION BY day, provider, model_id, principal ORDER BY ts, n) AS BIGINT) AS gap_seq
FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY day, provider, model_id, principal ORDER BY ts, n) > {gap} THEN 1 ELSE 0 END AS opened FROM {facts} f) x"""
_CONV = """SELECT day, CASE WHEN session_id = '' THEN 1 ELSE 0 END AS is_gap, provider, CASE WHEN session_id = '' THEN model_id ELSE session_id END AS k1, CASE WHEN session_id = '' THEN principal ELSE '' END AS k2, seq,
 count(*) AS invocations, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(cache_write_tokens)::BIGINT AS cache_write_tokens, count(*) FILTER (error_code <> '') AS errors, min(ts) AS start_ts, max(ts) AS end_ts,
 first(session_id ORDER BY ts, n) AS session_id, first(model_id ORDER BY ts, n) AS model_id, first(principal ORDER BY ts, n) AS principal
FROM (SELECT *, CASE WHEN session_id <> '' THEN 0 ELSE sum(opened) OVER (PARTITION BY day, provider, model_id, principal, session_id = '' ORDER BY ts, n) END::BIGINT AS seq
 FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY day, provider, model_id, principal, session_id = '' ORDER BY ts, n) > {gap} THEN 1 ELSE 0 END AS opened FROM {facts} f) x) y GROUP BY 1, 2, 3, 4, 5, 6"""
FIVE_MINUTES, TWO_HOURS = str(sessionize.GAP), str(2 * 3600 * 1_000_000)


@query(_GAPS.replace("{gap}", FIVE_MINUTES))
def gap_sessions(spark, sf_dir):
    return sessionize.gap_sequence(facts(spark, sf_dir)).select("request_id", *sessionize.SCOPE, "gap_seq")


@query(_GAPS.replace("{gap}", TWO_HOURS))
def gap_sessions_2h(spark, sf_dir):
    return sessionize.gap_sequence(facts(spark, sf_dir), int(TWO_HOURS)).select("request_id", *sessionize.SCOPE, "gap_seq")


@query(_CONV.replace("{gap}", FIVE_MINUTES))
def session_rollup(spark, sf_dir):
    return sessionize.conversations(facts(spark, sf_dir))


@query(f"""SELECT day, is_gap, provider, k1, k2, seq, 'conv-' || day || '-' || (row_number() OVER (ORDER BY day, is_gap, provider, k1, k2, seq) - 1) AS display_id,
 CASE WHEN session_id <> '' THEN session_id ELSE substr(sha256(provider || chr(0) || model_id || chr(0) || principal || chr(0) || strftime(make_timestamp(start_ts), '%Y-%m-%dT%H:%M:%SZ') || chr(0)), 1, 16) END AS conversation_id FROM ({_CONV.replace("{gap}", TWO_HOURS)}) c""")
def display_ids(spark, sf_dir):
    return sessionize.with_ids(sessionize.conversations(facts(spark, sf_dir), int(TWO_HOURS))).select(*sessionize.KEY, "display_id", "conversation_id")


@query("SELECT day, count(*) AS conversations, sum(invocations)::BIGINT AS invocations, sum(input_tokens)::BIGINT AS input_tokens, min(start_ts) AS first_ts, max(end_ts) AS last_ts FROM (" + _CONV.replace("{gap}", FIVE_MINUTES) + ") c GROUP BY day")
def index_days(spark, sf_dir):
    return sessionize.conversations(facts(spark, sf_dir)).groupBy("day").agg(F.count("*").alias("conversations"), F.sum("invocations").alias("invocations"), F.sum("input_tokens").alias("input_tokens"), F.min("start_ts").alias("first_ts"), F.max("end_ts").alias("last_ts"))


@query("SELECT a.request_id, b.request_id AS response_id FROM {facts} a JOIN {facts} b ON a.principal = b.principal AND b.n <> a.n AND b.ts BETWEEN a.ts AND a.ts + 600000000")
def terminal_candidates(spark, sf_dir):
    """Responses at most ten minutes after a request: joined on ten-minute slots, each request looking at its slot and the next."""
    slot = 600_000_000
    f = facts(spark, sf_dir).select("request_id", "principal", "n", "ts")
    a = f.withColumn("slot", F.explode(F.array(F.floor(F.col("ts") / slot), F.floor(F.col("ts") / slot) + 1))).alias("a")
    b = f.withColumn("slot", F.floor(F.col("ts") / slot)).alias("b")
    on = (F.col("a.principal") == F.col("b.principal")) & (F.col("a.slot") == F.col("b.slot")) & (F.col("a.n") != F.col("b.n")) & F.col("b.ts").between(F.col("a.ts"), F.col("a.ts") + slot)
    return a.join(b, on).select("a.request_id", F.col("b.request_id").alias("response_id"))


_NAMED = "(SELECT request_id, principal, thread_id, num_messages, ts, n, message_id, coalesce(lag(message_id) OVER (PARTITION BY principal ORDER BY ts, n), '') AS prev_id FROM {facts} f)"
_PAIRS = f"""(SELECT request_id, coalesce(m.message_id, '') AS message_id FROM (SELECT *, lead(prev_id) OVER (PARTITION BY principal, thread_id ORDER BY num_messages, ts, request_id) AS named FROM {_NAMED} a) r LEFT JOIN (SELECT message_id FROM {{facts}} g) m ON r.named = m.message_id)"""


def _requests(spark, sf_dir):
    """Invocations as requests that name the one before of the same principal."""
    prev = F.coalesce(F.lag("message_id").over(Window.partitionBy("principal").orderBy("ts", "n")), F.lit(""))
    return facts(spark, sf_dir).select(F.col("request_id").alias("uuid"), F.col("ts").alias("mtime"), F.col("principal").alias("session_id"), F.col("thread_id").alias("chain"), "num_messages", prev.alias("prev_id"))


def _paired(spark, sf_dir):
    responses = facts(spark, sf_dir).select("message_id")
    return pairing.adjacent(_requests(spark, sf_dir), responses), responses


@query(f"SELECT request_id, coalesce(lead(prev_id) OVER (PARTITION BY principal, thread_id ORDER BY num_messages, ts, request_id), '') AS named, row_number() OVER (PARTITION BY principal, thread_id ORDER BY num_messages, ts, request_id)::INTEGER AS place FROM {_NAMED} a")
def adjacency_lead(spark, sf_dir):
    """What each request's successor in its chain names."""
    return pairing.named(_requests(spark, sf_dir)).select(F.col("uuid").alias("request_id"), F.coalesce("named", F.lit("")).alias("named"), "place")


@query(f"SELECT g.message_id FROM {{facts}} g WHERE NOT EXISTS (SELECT 1 FROM {_NAMED} a WHERE a.prev_id = g.message_id)")
def unclaimed_anti(spark, sf_dir):
    """Responses that no request names."""
    claims = _requests(spark, sf_dir).select(F.col("uuid"), F.col("prev_id").alias("message_id"))
    return pairing.unclaimed(claims, facts(spark, sf_dir)).select("message_id")


def _walk_sql(model: str) -> str:
    """Requests and responses numbered by time within their model, and one walk per model."""
    return f"""WITH RECURSIVE f AS (SELECT *, {model} AS model FROM {{facts}} g), q AS (SELECT request_id, model, ts, row_number() OVER (PARTITION BY model ORDER BY ts, request_id) AS k FROM f WHERE operation = 'error'),
 r AS (SELECT message_id, model, ts, row_number() OVER (PARTITION BY model ORDER BY ts, message_id) AS j FROM f WHERE operation = 'view'),
 walk(model, k, request_id, used) AS (SELECT DISTINCT model, 0::BIGINT, '', 0::BIGINT FROM q UNION ALL
  SELECT q.model, q.k, q.request_id, coalesce((SELECT min(r.j) FROM r WHERE r.model = q.model AND r.j > abs(w.used) AND r.ts >= q.ts AND r.ts <= q.ts + {pairing.WINDOW}), -abs(w.used)) FROM walk w JOIN q ON q.model = w.model AND q.k = w.k + 1)
 SELECT w.request_id, r.message_id FROM walk w JOIN r ON r.model = w.model AND r.j = w.used AND w.used > 0"""


def _by_time(spark, sf_dir, model):
    f = facts(spark, sf_dir).withColumn("model", model)
    asked = f.where("operation = 'error'").select(F.col("request_id").alias("uuid"), F.col("ts").alias("mtime"), "model")
    given = f.where("operation = 'view'").select("message_id", F.col("ts").alias("mtime"), "model")
    return pairing.by_time(asked, given).select(F.col("uuid").alias("request_id"), "message_id")


@query(_walk_sql("'m'"))
def terminal_pairs(spark, sf_dir):
    """Requests paired with responses by time alone, first come first served."""
    return _by_time(spark, sf_dir, F.lit("m"))


@query(_walk_sql("'m' || n % 2"))
def terminal_pairs_by_model(spark, sf_dir):
    """The same with two models, each matched by itself."""
    return _by_time(spark, sf_dir, F.concat(F.lit("m"), F.col("n") % 2))


@query(f"SELECT request_id, message_id FROM {_PAIRS} p")
def adjacent_pairs(spark, sf_dir):
    return _paired(spark, sf_dir)[0].select(F.col("uuid").alias("request_id"), "message_id")


@query(f"SELECT count(*) AS requests, count(*) FILTER (WHERE message_id <> '') AS paired FROM {_PAIRS} p")
def paired_count(spark, sf_dir):
    return _paired(spark, sf_dir)[0].agg(F.count("*").alias("requests"), F.count_if(F.col("message_id") != "").alias("paired"))


@query(f"SELECT message_id FROM {{facts}} f WHERE message_id NOT IN (SELECT message_id FROM {_PAIRS} p)")
def unclaimed_responses(spark, sf_dir):
    return pairing.unclaimed(*_paired(spark, sf_dir)).select("message_id")


@query("SELECT operation, round(quantile_cont(output_tokens, 0.5), 3) AS p50, round(quantile_cont(output_tokens, 0.9), 3) AS p90, round(quantile_cont(output_tokens, 0.99), 3) AS p99 FROM {facts} f GROUP BY operation")
def output_quantiles(spark, sf_dir):
    p = F.percentile("output_tokens", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return facts(spark, sf_dir).groupBy("operation").agg(p.alias("p")).select("operation", *(F.round(F.col("p")[i], 3).alias(n) for i, n in enumerate(("p50", "p90", "p99"))))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY conv_id")
def turn_text(spark, sf_dir):
    kept = turns(spark, sf_dir).where("text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return kept.select("conv_id", F.array_join(F.col("t.text"), "\n\n").alias("text"))


_TURNS = """(SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text FROM conversations)"""
_REBUILT = f"""WITH t AS {_TURNS}, a AS (SELECT conv_id, max(i) AS late FROM t WHERE role = 'assistant' AND i > 0 GROUP BY conv_id)
 SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(i - {{skipped}} AS INTEGER) AS turn_index, role, text, role = 'assistant' AND i > 0 AS has_metrics, CASE WHEN role = 'assistant' AND i > 0 THEN conv_id || '-' || i ELSE '' END AS request_id, {{stop}} AS stop_reason
 FROM t JOIN a USING (conv_id) WHERE i <= late"""
_SHOWN = ("session_id", "turn_index", "role", "text", "has_metrics", "request_id", "stop_reason")


@query(_REBUILT.replace("{skipped}", "0").replace("{stop}", "''"))
def reconstructed_turns(spark, sf_dir):
    return reconstruct.turns(invocation_bodies(spark, sf_dir), ("anthropic",)).select(*_SHOWN)


@query(_REBUILT.replace("{skipped}", "(SELECT count(*) FROM t s WHERE s.conv_id = t.conv_id AND s.role = 'system' AND s.i < t.i)").replace("{stop}", "CASE WHEN role = 'assistant' AND i > 0 THEN 'stop' ELSE '' END") + " AND role <> 'system'")
def reconstructed_turns_openai(spark, sf_dir):
    return reconstruct.turns(invocation_bodies(spark, sf_dir, "openai"), ("openai",)).select(*_SHOWN)


@query(_REBUILT.replace("{skipped}", "0").replace("{stop}", "CASE WHEN role = 'assistant' AND i > 0 THEN 'STOP' ELSE '' END"))
def reconstructed_turns_gemini(spark, sf_dir):
    return reconstruct.turns(invocation_bodies(spark, sf_dir, "gemini"), ("gemini",)).select(*_SHOWN)


@query(f"WITH t AS {_TURNS}, a AS (SELECT conv_id, max(i) AS late FROM t WHERE role = 'assistant' AND i > 0 GROUP BY conv_id) SELECT conv_id::VARCHAR AS session_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY i) FILTER (role = 'system' AND i < late), '') AS system_prompt FROM t JOIN a USING (conv_id) GROUP BY conv_id")
def system_prompt(spark, sf_dir):
    return reconstruct.threads(invocation_bodies(spark, sf_dir, "openai"), ("openai",)).select("session_id", "system_prompt")


@query(f"WITH t AS {_TURNS}, o AS (SELECT length(text) AS n FROM t WHERE role = 'assistant' AND i > 0) SELECT round(quantile_cont(n, 0.5), 3) AS p50, round(quantile_cont(n, 0.9), 3) AS p90, round(quantile_cont(n, 0.99), 3) AS p99 FROM o")
def turn_output_quantiles(spark, sf_dir):
    """Output tokens of assistant turns with metrics, as their replies' usage tells them."""
    made = reconstruct.turns(invocation_bodies(spark, sf_dir, "openai"), ("openai",)).where("role = 'assistant' and has_metrics")
    p = made.agg(F.percentile("output_tokens", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("p"))
    return p.select(*(F.round(F.col("p")[i], 3).alias(n) for i, n in enumerate(("p50", "p90", "p99"))))


@query(f"WITH t AS {_TURNS} SELECT conv_id, i::INTEGER AS turn_index, role, CASE WHEN role = 'assistant' AND i > 0 THEN conv_id || '-' || i END AS request_id FROM t")
def metrics_attach(spark, sf_dir):
    """Every turn of every conversation with the invocation that answered with it, if any."""
    t = turns(spark, sf_dir).select("conv_id", "role", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("turn_index"))
    made = reconstruct.turns(invocation_bodies(spark, sf_dir), ("anthropic",)).where("has_metrics").select(F.col("session_id").cast("long").alias("conv_id"), "turn_index", "request_id")
    return t.join(made, ["conv_id", "turn_index"], "left").select("conv_id", "turn_index", "role", "request_id")


@query(f"WITH t AS {_TURNS}, a AS (SELECT conv_id, i FROM t WHERE role = 'assistant' AND i > 0) SELECT a.conv_id::VARCHAR AS session_id, sum(a.i)::BIGINT AS messages_sent, (max(a.i) + 1)::BIGINT AS turns_kept FROM a GROUP BY a.conv_id")
def resend_dedup(spark, sf_dir):
    """Messages that all requests of a conversation send, and turns that are left of them."""
    bodies = invocation_bodies(spark, sf_dir)
    sent = bodies.groupBy("session_id").agg(F.sum(F.json_array_length(F.get_json_object("input_body", "$.messages"))).cast("long").alias("messages_sent"))
    return sent.join(reconstruct.turns(bodies, ("anthropic",)).groupBy("session_id").agg(F.count("*").alias("turns_kept")), "session_id")


def _as_counted(f: DataFrame) -> DataFrame:
    return f.where("session_id <> ''").withColumn("n_in", F.col("num_messages"))


@query("SELECT day, provider, session_id, thread_id, request_id, num_messages FROM (SELECT *, row_number() OVER (PARTITION BY day, provider, session_id, thread_id ORDER BY num_messages DESC, ts, n) AS k FROM {facts} f WHERE session_id <> '') x WHERE k = 1")
def fullest_request(spark, sf_dir):
    f = _as_counted(facts(spark, sf_dir))
    return reconstruct.chosen(f).select("n").join(f, "n").select(*reconstruct.KEY, "thread_id", "request_id", "num_messages")


@query("SELECT day, provider, session_id, thread_id FROM (SELECT *, row_number() OVER (PARTITION BY day, provider, session_id ORDER BY start_ts, n DESC, thread_id) AS k FROM (SELECT day, provider, session_id, thread_id, min(ts) AS start_ts, count(*) AS n FROM {facts} f WHERE session_id <> '' GROUP BY day, provider, session_id, thread_id) t) x WHERE k = 1")
def main_thread(spark, sf_dir):
    return reconstruct.chosen(_as_counted(facts(spark, sf_dir))).where("is_main").select(*reconstruct.KEY, "thread_id")


@query("SELECT c_mktsegment AS tool, count(*) AS uses FROM customer GROUP BY c_mktsegment")
def tool_use_frequency(spark, sf_dir):
    calls = reconstruct.tool_calls(reconstruct.turns(tool_bodies(spark, sf_dir), ("openai",)))
    return calls.groupBy(F.col("tool_name").alias("tool")).agg(F.count("*").alias("uses"))


@query("""SELECT c_custkey::VARCHAR AS session_id, c_mktsegment AS tool_name, '{"nation":' || c_nationkey || '}' AS tool_input, 1 AS called_at, CASE WHEN c_custkey % 7 <> 0 THEN 2 END AS answered_at, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS result FROM customer""")
def tool_results(spark, sf_dir):
    """Calls with their results; every seventh customer's result has another id."""
    return reconstruct.tool_calls(reconstruct.turns(tool_bodies(spark, sf_dir), ("openai",))).select("session_id", "tool_name", "tool_input", "called_at", "answered_at", "result")


@query(f"WITH t AS {_TURNS}, a AS (SELECT conv_id, max(i) AS late FROM t WHERE role = 'assistant' AND i > 0 GROUP BY conv_id) SELECT 'main' AS thread, count(*) AS turns FROM t JOIN a USING (conv_id) WHERE i <= late")
def thread_volume(spark, sf_dir):
    """Turns of main threads and of sidechains."""
    return reconstruct.turns(invocation_bodies(spark, sf_dir), ("anthropic",)).groupBy(F.when(F.col("thread_id") == "", "main").otherwise("sidechain").alias("thread")).agg(F.count("*").alias("turns"))


@query("SELECT doc_id, substr(text, 1, 80) AS snippet FROM documents")
def snippet(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 80).alias("snippet"))


@query("SELECT page_id, regexp_extract(url, '(?:^|/)en/([^/]+)', 1) AS segment, replace(translate(url, '/\\:', '___'), '..', '__') AS file_name FROM pages")
def url_names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", text.path_segment(F.col("url"), "en").alias("segment"), text.sanitize_filename(F.col("url")).alias("file_name"))


@query("SELECT DISTINCT model_id, regexp_replace(regexp_replace(regexp_replace(model_id, '^.*/', ''), '^[^.]{2}\\.', ''), '-v1$', '') AS short_model FROM {facts} f")
def short_model(spark, sf_dir):
    return facts(spark, sf_dir).select("model_id").distinct().withColumn("short_model", text.short_model(F.col("model_id")))


@query("SELECT doc_id, 'data:text/' || lang || ';base64,' || base64(encode(text)) AS uri, lang AS mime_end, strlen(text) AS decoded FROM documents")
def data_uri_length(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = d.select("doc_id", F.concat(F.lit("data:text/"), "lang", F.lit(";base64,"), F.replace(F.base64(F.encode("text", "utf-8")), F.lit("\r\n"), F.lit(""))).alias("uri")).withColumn("u", text.data_uri(F.col("uri")))
    return d.select("doc_id", "uri", F.regexp_extract("u.mime", "/(.*)$", 1).alias("mime_end"), text.base64_length(F.col("u.payload")).alias("decoded"))


def _bm25_sql(table: str, keys: str, terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""WITH src AS (SELECT row_number() OVER () AS rid, * FROM {table}), w AS (SELECT rid, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM src), d AS (SELECT rid, count(*) AS dl FROM w GROUP BY rid), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
 tf AS (SELECT rid, term, count(*) AS tf FROM w WHERE term IN ({listed}) GROUP BY rid, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 scored AS (SELECT rid, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN d USING (rid), s GROUP BY rid)
 SELECT {keys}, score FROM scored JOIN src USING (rid) ORDER BY score DESC, {keys} LIMIT 10"""


QUERY = "the and tion des ing"


@query(_bm25_sql("documents", "doc_id", search.terms_of(QUERY)))
def bm25_top10(spark, sf_dir):
    return search.bm25(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), QUERY)


def _indexed(spark, texts: DataFrame, query: str) -> DataFrame:
    path = scratch(spark, "index")
    text_index.build(texts, path)
    return text_index.search(spark, path, query)[0]


@query(_bm25_sql("documents", "doc_id", search.terms_of(QUERY)))
def indexed_top10(spark, sf_dir):
    """The same through an index."""
    return _indexed(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), QUERY)


@query(_bm25_sql("conversations", "conv_id, turn, role", search.terms_of("The other die, UND la!")))
def search_turns(spark, sf_dir):
    return _indexed(spark, turns(spark, sf_dir).select("conv_id", "turn", "role", "text"), "The other die, UND la!")
