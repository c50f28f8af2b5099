"""Exports of invocations: a folder of Parquet tables facts, turns and conversations, and a manifest; and their reader.

Every part is written by Spark from the records; nothing is gathered on the driver but the manifest's one row. Turns lie
in their own table beside the conversations, keyed by conversation_id, so a conversation of any length can be written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.functions.envelopes import family, valid_json
from tracewell.operators import reconstruct, sessionize
from tracewell.operators.blocks import BLOCK
from tracewell.sources import files
from tracewell.sources.scratch import written

#: Layout version, and the columns of facts in order with what stands for absent ones.
VERSION = "tracewell.export/1.0"
FACTS = {
    "conversation_id": "", "session_id": "", "provider": "", "model_id": "", "timestamp": None, "request_id": "", "operation": "", "status": "", "error_code": "", "stop_reason": "", "input_tokens": 0, "output_tokens": 0,
    "cache_read_tokens": 0, "cache_write_tokens": 0, "latency_ms": 0, "principal": "", "message_id": "", "prev_message_id": "", "thread_id": "", "request_uuid": "", "num_messages": 0, "extras": "",
}
TABLES = ("facts", "turns", "conversations")
SUMS = ("invocations", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "errors")


def _completed(records: DataFrame) -> DataFrame:
    """records with every column of FACTS; absent ones and nulls are empty strings and zeros."""
    rows = records.withColumnRenamed("prev_id", "prev_message_id") if "prev_id" in records.columns else records
    rows = rows.withColumn("timestamp", F.timestamp_micros("ts"))
    if "extra" in rows.columns:
        kept = F.filter(F.array_sort(F.map_entries("extra")), lambda e: e["key"] != "session_id")
        rows = rows.withColumn("extras", F.coalesce(F.nullif(F.to_json(F.map_from_entries(kept)), F.lit("{}")), F.lit("")))
    for name, empty in FACTS.items():
        if empty is not None and name != "conversation_id":
            kind = {"num_messages": "int"}.get(name, "string" if empty == "" else "long")
            rows = rows.withColumn(name, F.coalesce(F.col(name).cast(kind), F.lit(empty).cast(kind)) if name in rows.columns else F.lit(empty).cast(kind))
    return rows


def facts(records: DataFrame, conversations: DataFrame) -> DataFrame:
    """The FACTS of records, one row each; conversations are sessionize.with_ids of the same records."""
    ids = conversations.select(*(F.col(k).alias(f"in_{k}") for k in sessionize.KEY), F.col("conversation_id").alias("in_id"))
    same = F.lit(True)
    for k in sessionize.KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"in_{k}"))
    return sessionize.keyed(records).join(ids, same).withColumn("conversation_id", F.col("in_id")).select(*FACTS)


def file_names(conversations: DataFrame) -> DataFrame:
    """conversations with file: conversations/<name>.json, name being the safe form of the id; of equal names the later ones in display order get _2, _3, ..."""
    base = text.sanitize_filename(F.col("conversation_id"))
    order = Window.partitionBy("base").orderBy(*sessionize.KEY)
    numbered = conversations.withColumn("base", base).withColumn("k", F.row_number().over(order))
    name = F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("k").cast("string")))
    # a numbered name that is another's base is told apart by the base it came from
    bases = numbered.where("k = 1").select(F.col("base").alias("name"), F.lit(True).alias("taken"))
    made = numbered.withColumn("name", name).join(bases, "name", "left")
    clash = F.col("taken").isNotNull() & (F.col("k") > 1)
    return made.withColumn("file", F.concat(F.lit("conversations/"), F.when(clash, F.concat("name", F.lit("_"), F.substring(F.sha2("base", 256), 1, 8))).otherwise(F.col("name")), F.lit(".json"))).drop("base", "k", "name", "taken")


def _counts(records: DataFrame, column: str) -> DataFrame:
    """One row: how many records each value of column has, as a map; models and operations are few."""
    each = records.groupBy(F.coalesce(column, F.lit("")).alias("name")).agg(F.count("*").alias("n"))
    return each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias(f"by_{column}"))


METRICS = ("request_id", "model_id", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "latency_ms", "first_byte_ms", "stop_reason")
INVOCATION = ("timestamp", "request_id", "request_uuid", "model_id", "operation", "status", "error_code", "principal", "message_id", "stop_reason", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "latency_ms", "extras")


def pieces(records: DataFrame, entries: DataFrame, turns: DataFrame | None, threads: DataFrame | None, embed: bool = False) -> DataFrame:
    """files.PIECES of every conversation: its entry, its invocations by time, and its threads with their turns.

    records are completed ones, entries have sessionize.KEY, file and the columns of conversations. Bodies that are JSON are
    embedded as they are if embed says so, others as a JSON string. Only the file's name is joined to the rows.
    """
    nothing = F.lit("")
    piece = lambda df, part, thread, kind, place, value: df.select("file", F.lit(part).alias("part"), thread.alias("thread"), F.lit(kind).alias("kind"), place.cast("long").alias("place"), value.alias("json"))
    shown = [c for c in entries.columns if c not in (*sessionize.KEY, "file", *SUMS, "turn_count") or c in ("day", "provider")]
    head = F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), *shown, F.struct(*SUMS, "turn_count").alias("stats")))
    out = piece(entries, files.HEAD, nothing, 0, F.lit(0), head)
    names = entries.select(*(F.col(k).alias(f"in_{k}") for k in sessionize.KEY), "file")
    same = F.lit(True)
    for k in sessionize.KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"in_{k}"))
    told = F.to_json(F.struct(*INVOCATION))
    if embed:
        for c in ("input_body", "output_body"):
            value = F.when(valid_json(F.col(c)), F.col(c)).otherwise(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))
            told = F.when(F.col(c).isNull(), told).otherwise(F.concat(told.substr(F.lit(1), F.length(told) - 1), F.lit(f',"{c}":'), value, F.lit("}")))
    asked = sessionize.keyed(records).join(names, same)
    place = F.row_number().over(Window.partitionBy("file", F.floor(F.coalesce("ts", F.lit(0)) / 3_600_000_000)).orderBy("ts", "n"))
    # by the hour, then within it: no window holds a conversation
    hours = F.floor(F.coalesce("ts", F.lit(0)) / 3_600_000_000) * F.lit(1 << 31)
    out = out.unionByName(piece(asked, files.INVOCATION, nothing, 0, hours + place, told))
    if turns is None:
        return out
    of_session = entries.where("is_gap = 0").select("day", "provider", F.col("k1").alias("session_id"), "file")
    key = ["day", "provider", "session_id"]
    turn = F.to_json(F.struct("role", F.from_json("blocks", f"array<{BLOCK}>").alias("blocks"), F.when(F.col("has_metrics"), F.struct("timestamp", *METRICS)).alias("metrics")))
    for main in (True, False):
        part = files.MAIN if main else files.SIDE
        mine = (F.col("thread_id") == "") == F.lit(main)
        about = F.struct("system_prompt", F.col("tools").alias("tools"))
        said = F.to_json(about) if main else F.to_json(F.struct(F.col("thread_id").alias("id"), about.alias("conversation")))
        out = out.unionByName(piece(threads.where(mine).join(of_session, key), part, F.col("thread_id"), files.THREAD, F.lit(0), said))
        out = out.unionByName(piece(turns.where(mine).join(of_session, key), part, F.col("thread_id"), files.TURN, F.col("turn_index"), turn))
    return out


def write(records: DataFrame, path: str, source: str = "", embed: bool = False, as_files: bool = False, skipped: Observation | None = None) -> None:
    """Writes records (columns of the readers) as an export to the new folder path.

    facts are sorted by time, request id and uuid, turns by the place of their conversation, thread and place. Bodies are
    left out unless embed, which adds a table bodies (request_id, request_uuid, input_body, output_body). as_files also writes
    one JSON file per conversation (see pieces), with bodies if embed. The folder must not exist yet. records are read once:
    they are written to the shared folder, from which all tables are made. What the reader counted in skipped on the way goes
    into the manifest.
    """
    records = written(_completed(records), "records")
    counts = skipped.get if skipped is not None else {}
    convs = written(file_names(sessionize.with_ids(sessionize.conversations(records))), "conversations")
    save = lambda df, name: df.write.option("compression", "zstd").parquet(f"{path}/{name}.parquet")
    save(facts(records, convs).orderBy("timestamp", "request_id", "request_uuid"), "facts")
    has_bodies = {"input_body", "output_body"} <= set(records.columns)
    # the kinds of bodies that there are: three at most
    kinds = tuple(r[0] for r in records.select(family(F.col("provider"), F.col("model_id"))).distinct().collect() if r[0] in reconstruct.ENVELOPES)
    turns = threads = None
    if has_bodies:
        made = reconstruct.turns(records, kinds or ("anthropic",))
        save(made.withColumn("conversation_id", F.col("session_id")).withColumn("timestamp", F.timestamp_micros("ts")).drop("ts").orderBy("day", "provider", "session_id", "thread_id", "turn_index"), "turns")
        turns = records.sparkSession.read.parquet(f"{path}/turns.parquet")
        turned = turns.groupBy("day", "provider", F.col("session_id").alias("k1")).agg(F.count("*").alias("turn_count"))
        convs = convs.join(turned.withColumn("is_gap", F.lit(0)), ["day", "provider", "k1", "is_gap"], "left")
        if as_files:
            known = reconstruct.threads(records, kinds or ("anthropic",))
            threads = known.select(*reconstruct.KEY, F.when(F.col("is_main"), "").otherwise(F.col("thread_id")).alias("thread_id"), "system_prompt", "tools")
    else:
        convs = convs.withColumn("turn_count", F.lit(None).cast("long"))
    entry = convs.select(*(k for k in sessionize.KEY if k not in ("day", "provider")), "conversation_id", "display_id", "file", "day", "provider", "model_id", "session_id", "principal", F.timestamp_micros("start_ts").alias("start_time"), F.timestamp_micros("end_ts").alias("end_time"), *SUMS, F.coalesce("turn_count", F.lit(0).cast("long")).alias("turn_count"), F.col("turn_count").isNotNull().alias("reconstructed"))
    save(entry.drop(*(k for k in sessionize.KEY if k not in ("day", "provider"))).orderBy("start_time", "conversation_id"), "conversations")
    if embed and has_bodies:
        save(records.select("request_id", "request_uuid", "input_body", "output_body"), "bodies")
    if as_files:
        files.write(pieces(records, entry, turns, threads, embed and has_bodies), f"{path}/conversations")
    totals = records.sparkSession.read.parquet(f"{path}/conversations.parquet").agg(F.count("*").alias("conversations"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS), F.min("start_time").alias("first"), F.max("end_time").alias("last"), F.count_distinct("day").alias("days"))
    totals = totals.crossJoin(_counts(records, "model_id")).crossJoin(_counts(records, "operation"))  # one row each
    stamp = (F.lit(VERSION).alias("schema_version"), F.current_timestamp().alias("generated_at"), F.lit("tracewell").alias("tool"), F.lit(source).alias("source"), F.lit("embed" if embed else "omit").alias("raw_bodies"))
    told = F.create_map(*(F.lit(x) for item in counts.items() for x in item)) if counts else F.create_map().cast("map<string, bigint>")
    totals.select(*stamp, F.struct("*").alias("totals"), told.alias("skipped")).coalesce(1).write.json(f"{path}/manifest.json")


def manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of an export; ValueError if its major version is another."""
    found = spark.read.json(f"{path}/manifest.json").first().asDict(recursive=True)
    major = found["schema_version"].rpartition("/")[2].partition(".")[0]
    if major != VERSION.rpartition("/")[2].partition(".")[0]:
        raise ValueError(f"export version {found['schema_version']!r} is not readable")
    return found


def read(spark: SparkSession, path: str, table: str = "facts") -> DataFrame:
    """A table of an export, or of all exports that a pattern names; of a request in several, dedup_overlap keeps one."""
    if table not in (*TABLES, "bodies"):
        raise ValueError(f"no table {table!r}")
    return spark.read.parquet(f"{path}/{table}.parquet")


def conversation(spark: SparkSession, path: str, conversation_id: str) -> tuple[DataFrame, DataFrame]:
    """(the entry, the turns in order: main thread first) of one conversation of an export; both empty if there is none."""
    entry = read(spark, path, "conversations").where(F.col("conversation_id") == conversation_id)
    return entry, read(spark, path, "turns").where(F.col("conversation_id") == conversation_id).orderBy("thread_id", "turn_index")


_COUNTS = ", ".join(f"{c}: bigint" for c in (*SUMS, "turn_count"))
_INVOCATION = ", ".join(f"{c}: {'bigint' if c.endswith(('tokens', '_ms')) else 'timestamp' if c == 'timestamp' else 'string'}" for c in INVOCATION)
_METRICS = ", ".join(f"{c}: {'bigint' if c.endswith(('tokens', '_ms')) else 'string'}" for c in METRICS)
_THREAD = f"struct<system_prompt: string, tools: array<struct<name: string, description: string, input_schema: string>>, turns: array<struct<role: string, blocks: array<{BLOCK}>, metrics: struct<timestamp: timestamp, {_METRICS}>>>>"
#: What a conversation's file holds.
DOCUMENT = f"""schema_version string, conversation_id string, display_id string, day string, provider string, model_id string, session_id string, principal string, start_time timestamp, end_time timestamp, reconstructed boolean, stats struct<{_COUNTS}>,
 invocations array<struct<{_INVOCATION}, input_body: string, output_body: string>>, conversation {_THREAD}, sidechains array<struct<id: string, conversation: {_THREAD}>>"""


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, columns of DOCUMENT) of the conversation files of an export; bodies that are embedded come as JSON texts."""
    read = spark.read.schema(DOCUMENT).option("multiLine", True).json(f"{path}/conversations")
    return read.select(F.concat(F.lit("conversations/"), "_metadata.file_name").alias("file"), "*")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, document) of every conversation of an export: its entry, its turns and its sidechains as one JSON text.

    The text is the whole conversation, so its turns meet in one row; the tables hold the same without that.
    """
    turn = F.struct("role", F.from_json("blocks", f"array<{BLOCK}>").alias("blocks"), F.when(F.col("has_metrics"), F.struct("request_id", "model_id", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "latency_ms", "stop_reason")).alias("metrics"))
    each = read(spark, path, "turns").groupBy("day", "provider", "session_id", "thread_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", turn.alias("turn")))), lambda x: x["turn"]).alias("turns"))
    side = F.filter(F.array_sort(F.collect_list(F.struct("thread_id", "turns"))), lambda t: t["thread_id"] != "").alias("sidechains")
    whole = each.groupBy("day", "provider", "session_id").agg(F.max(F.when(F.col("thread_id") == "", F.col("turns"))).alias("turns"), side)
    entries = read(spark, path, "conversations")
    named = entries.join(whole, ["day", "provider", "session_id"], "left")
    return named.select("file", F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), *(c for c in entries.columns if c != "file"), "turns", F.when(F.size("sidechains") > 0, F.col("sidechains")).alias("sidechains"))).alias("document"))


def body(spark: SparkSession, path: str, request_id: str) -> DataFrame:
    """(request_id, request_uuid, input_body, output_body, input_preview, output_preview) of an invocation of an export with bodies."""
    found = read(spark, path, "bodies").where(F.col("request_id") == request_id)
    return found.select("*", text.preview(F.col("input_body")).alias("input_preview"), text.preview(F.col("output_body")).alias("output_preview"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """(day, conversations, invocations, input_tokens, output_tokens, errors, first, last) of an export, a row per day."""
    each = read(spark, path, "conversations").groupBy("day")
    return each.agg(F.count("*").alias("conversations"), *(F.sum(c).alias(c) for c in ("invocations", "input_tokens", "output_tokens", "errors")), F.min("start_time").alias("first"), F.max("end_time").alias("last")).orderBy("day")


def summary(spark: SparkSession, path: str) -> list[str]:
    """The lines that tell about an export when it is written: its place and the manifest's totals, a name and a value each."""
    totals = manifest(spark, path)["totals"]
    return [f"path={path}", *(f"{name}={value}" for name, value in totals.items() if not isinstance(value, dict)), *(f"skipped_{name}={value}" for name, value in (manifest(spark, path).get("skipped") or {}).items())]
