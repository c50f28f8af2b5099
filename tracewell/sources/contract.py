"""What every reader gives: one schema of invocations, and one way to call a reader by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources import azure, bedrock, capture, services, vertex

#: Columns of an invocation. Absent strings are empty, absent counts zero; only ts and bodies may be null.
RECORD = {
    "ts": "long", "day": "string", "n": "long", "provider": "string", "model_id": "string", "operation": "string", "principal": "string", "session_id": "string", "thread_id": "string", "request_id": "string", "request_uuid": "string", "message_id": "string", "prev_id": "string", "status": "string", "error_code": "string", "stop_reason": "string",
    "num_messages": "int", "input_tokens": "long", "output_tokens": "long", "cache_read_tokens": "long", "cache_write_tokens": "long", "latency_ms": "long", "extra": "map<string, string>", "input_body": "string", "output_body": "string",
}
NULLABLE = ("ts", "input_body", "output_body")

#: Readers by name: (spark, where, start, end, **more) with days as YYYY-MM-DD, both included.
#: Those of files also take skipped, an Observation of what they skip.
READERS: dict[str, Callable[..., DataFrame]] = {
    "bedrock": lambda spark, where, start="", end="", bucket="", skipped=None: bedrock.read(spark, where, bucket, start, end, skipped),
    "azure": lambda spark, where, start="", end="", resource="", subscription="": azure.from_table(vertex.table(spark, *where.split(".")), start, end, resource, subscription),
    "azure-service": lambda spark, where, start="", end="", resource="", subscription="", token="", hours="": azure.from_table(services.log_rows(spark, where, start, end, token, resource, subscription, hours), start, end),
    "azure-storage": lambda spark, where, start="", end="", skipped=None: azure.read_storage(spark, where, start, end, skipped),
    "vertex": lambda spark, where, start="", end="": vertex.records(vertex.table(spark, *where.split(".")), start, end),
    "vertex-service": lambda spark, where, start="", end="", table="", location="", token="", hours="": vertex.records(services.table_rows(spark, where, table, start, end, token, location, hours), start, end),
    "claude": lambda spark, where, start="", end="", skipped=None: capture.read(spark, where, start, end, bodies=True, skipped=skipped),
}
#: Kinds whose readers count what they skip.
COUNTED = ("bedrock", "azure-storage", "claude")


def conform(rows: DataFrame) -> DataFrame:
    """rows with exactly the columns of RECORD, in order."""

    def column(name: str, kind: str):
        given = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        if name in NULLABLE:
            return given.alias(name)
        empty = F.create_map().cast(kind) if kind.startswith("map") else F.lit("" if kind == "string" else 0).cast(kind)
        return F.coalesce(given, empty).alias(name)

    return rows.select(*(column(c, k) for c, k in RECORD.items()))


def read(spark: SparkSession, kind: str, where: str, start: str = "", end: str = "", **more) -> DataFrame:
    """Invocations (RECORD) of the source kind at where: a folder, an address, a table name or a service's URL; ValueError for another kind."""
    if kind not in READERS:
        raise ValueError(f"no source {kind!r}")
    return conform(READERS[kind](spark, where, start, end, **more))
