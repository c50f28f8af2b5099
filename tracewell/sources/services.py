"""Log services that are asked over HTTP: Python data sources whose partitions are slices of time.

A slice is one question, asked by the task that has it, so slices are read side by side and a lost task asks again. The window
of the questions is that of the options start and end, narrowed by filters on the time column; Spark evaluates all
filters once more. An answer that is an error fails the read; an answer that was cut is asked for again by halves.
"""

from __future__ import annotations

import datetime as dt
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringContains

from tracewell.sources.azure import CATEGORY
from tracewell.sources.dates import window
from tracewell.sources.vertex import identifiers

#: Seconds that an answer may take, rows of a batch and of a page, and the shortest slice that is halved.
TIMEOUT = 300
BATCH = 1000
PAGE = 1000
SHORTEST = dt.timedelta(seconds=1)
TICK = dt.timedelta(microseconds=1)


class ServiceError(RuntimeError):
    """A service has refused a question or answered with an error."""


@dataclass(frozen=True)
class Slice(InputPartition):
    """[first, last) of a window; None is unbounded."""

    first: dt.datetime | None
    last: dt.datetime | None

    def halves(self) -> list[Slice]:
        """Both halves of a bounded slice, none of one that is too short to cut."""
        if self.first is None or self.last is None or self.last - self.first < 2 * SHORTEST:
            return []
        middle = self.first + (self.last - self.first) / 2
        return [Slice(self.first, middle), Slice(middle, self.last)]


def slices(first: dt.datetime | None, last: dt.datetime | None, hours: float) -> list[Slice]:
    """Slices of so many hours that cover [first, last); one if a bound is missing, none if it is empty."""
    if first is None or last is None:
        return [Slice(first, last)]
    step = dt.timedelta(hours=hours)
    return [Slice(first + i * step, min(last, first + (i + 1) * step)) for i in range(max(0, -(-(last - first) // step)))]


def spelled(at: dt.datetime) -> str:
    return at.astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def asked(url: str, token: str, body: dict | None = None) -> dict:
    """The JSON answer to body (or to a plain GET); ServiceError for a status of 400 or more."""
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), head)
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as error:
        raise ServiceError(f"{url}: {error.code} {error.read(2000).decode(errors='replace')}") from error


class _Reader(DataSourceReader):
    """Reads slices of a window; subclasses ask for a slice and give its rows as tuples of COLUMNS."""

    TIME: str
    COLUMNS: pa.Schema

    def __init__(self, options):
        at = lambda c: dt.datetime.fromisoformat(options[c]) if options.get(c) else None
        self.url, self.token, self.hours = options["url"].rstrip("/"), options.get("token", ""), float(options.get("hours", "24"))
        self.first, self.last = at("start"), at("end")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == (self.TIME,):
                after, before = isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo), isinstance(f, LessThan | LessThanOrEqual | EqualTo)
                if after:
                    self.first = f.value if self.first is None else max(self.first, f.value)
                if before:
                    past = f.value if isinstance(f, LessThan) else f.value + TICK
                    self.last = past if self.last is None else min(self.last, past)
            else:
                self.narrow(f)
            yield f

    def narrow(self, f: Filter) -> None:
        """Takes what a filter on another column says into the questions."""

    def partitions(self) -> list[Slice]:
        return slices(self.first, self.last, self.hours)

    def rows(self, at: Slice) -> Iterator[tuple]:
        raise NotImplementedError

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in self.rows(partition) if partition is not None else ():
            held.append(row)
            if len(held) == BATCH:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.COLUMNS, strict=True)], schema=self.COLUMNS)


#: Columns of a log table, all text but the time.
LOG_COLUMNS = ("TimeGenerated", "OperationName", "DurationMs", "ResultSignature", "ResultType", "CorrelationId", "_ResourceId", "SubscriptionId", "CallerIPAddress", "Category", "ResourceGroup", "properties_s")


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


def _cell(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


class _LogReader(_Reader):
    """Asks a log workspace for its request-response rows."""

    TIME = "TimeGenerated"
    COLUMNS = pa.schema([(c, pa.timestamp("us", "UTC") if c == LOG_COLUMNS[0] else pa.string()) for c in LOG_COLUMNS])

    def __init__(self, options):
        super().__init__(options)
        self.conditions = [f"Category == {_quoted(CATEGORY)}"]
        if options.get("resource"):
            self.conditions.append(f"_ResourceId contains {_quoted(options['resource'])}")
        if options.get("subscription"):
            self.conditions.append(f"SubscriptionId == {_quoted(options['subscription'])}")

    def narrow(self, f: Filter) -> None:
        name = getattr(f, "attribute", ("",))[-1]
        if isinstance(f, StringContains) and name == "_ResourceId":
            self.conditions.append(f"_ResourceId contains {_quoted(f.value)}")
        elif isinstance(f, EqualTo) and name in ("SubscriptionId", "CorrelationId", "OperationName"):
            self.conditions.append(f"{name} == {_quoted(f.value)}")

    def question(self, at: Slice) -> dict:
        """The query of a slice, and its timespan if both bounds are known."""
        bounds = [f"TimeGenerated {sign} datetime({spelled(x)})" for sign, x in ((">=", at.first), ("<", at.last)) if x is not None]
        query = " | ".join(["AzureDiagnostics", *(f"where {c}" for c in self.conditions + bounds), f"project {', '.join(LOG_COLUMNS)}"])
        return {"query": query} | ({"timespan": f"{spelled(at.first)}/{spelled(at.last)}"} if len(bounds) == 2 else {})

    def rows(self, at: Slice) -> Iterator[tuple]:
        answer = asked(f"{self.url}/query", self.token, self.question(at))
        if answer.get("error"):
            halves = at.halves() if answer["error"].get("code") == "PartialError" else []
            if not halves:
                raise ServiceError(f"{self.url}: {json.dumps(answer['error'])[:2000]}")
            for half in halves:
                yield from self.rows(half)
            return
        for table in answer["tables"]:
            place = {c["name"]: i for i, c in enumerate(table["columns"])}
            for row in table["rows"]:
                time, *rest = (row[place[c]] if c in place else None for c in LOG_COLUMNS)
                yield dt.datetime.fromisoformat(time) if time else None, *map(_cell, rest)


class LogService(DataSource):
    """Options url (of the workspace), token, start, end, hours of a slice, resource, subscription."""

    @classmethod
    def name(cls) -> str:
        return "tracewell_log_service"

    def schema(self) -> str:
        return ", ".join(f"`{c}` {'timestamp' if c == _LogReader.TIME else 'string'}" for c in LOG_COLUMNS)

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)


class _TableReader(_Reader):
    """Asks a warehouse for the rows of a request-response logging table, page by page."""

    TIME = "logging_time"
    COLUMNS = pa.schema([("endpoint", pa.string()), ("deployed_model_id", pa.string()), (TIME, pa.timestamp("us", "UTC")), ("request_id", pa.string()), ("request_payload", pa.list_(pa.string())), ("response_payload", pa.list_(pa.string()))])

    def __init__(self, options):
        super().__init__(options)
        self.table, self.location = options["table"], options.get("location", "")

    def question(self, at: Slice) -> dict:
        project, dataset, table = identifiers(*self.table.split("."), count=3)
        bounds = [(name, sign, x) for name, sign, x in (("start", ">=", at.first), ("end", "<", at.last)) if x is not None]
        where = " WHERE " + " AND ".join(f"logging_time {sign} @{name}" for name, sign, _ in bounds) if bounds else ""
        text = ("COALESCE(endpoint, '')", "COALESCE(deployed_model_id, '')", "UNIX_MICROS(logging_time)", "COALESCE(CAST(request_id AS STRING), '')", "request_payload", "response_payload")
        query = f"SELECT {', '.join(f'{x} AS {c}' for x, c in zip(text, self.COLUMNS.names, strict=True))} FROM `{project}.{dataset}.{table}`{where}"
        values = [{"name": name, "parameterType": {"type": "TIMESTAMP"}, "parameterValue": {"value": spelled(x)}} for name, _, x in bounds]
        more = {"location": self.location} if self.location else {}
        return {"query": query, "useLegacySql": False, "parameterMode": "NAMED", "queryParameters": values, "maxResults": PAGE} | more

    def rows(self, at: Slice) -> Iterator[tuple]:
        base = f"{self.url}/projects/{self.table.split('.')[0]}/queries"
        answer = asked(base, self.token, self.question(at))
        while True:
            if answer.get("errors"):
                raise ServiceError(f"{base}: {json.dumps(answer['errors'])[:2000]}")
            for row in answer.get("rows", ()):
                endpoint, model, time, request, *payloads = (c["v"] for c in row["f"])
                moment = None if time is None else dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + int(time) * TICK
                yield endpoint, model, moment, request, *([x["v"] for x in p or ()] for p in payloads)
            done, page = answer.get("jobComplete", True), answer.get("pageToken")
            if done and not page:
                return
            job = answer["jobReference"]
            more = {"maxResults": PAGE} | ({"pageToken": page} if page else {}) | ({"location": job["location"]} if job.get("location") else {})
            answer = asked(f"{base}/{urllib.parse.quote(job['jobId'])}?{urllib.parse.urlencode(more)}", self.token)


class TableService(DataSource):
    """Options url, table (project.dataset.table), location, token, start, end, hours of a slice."""

    @classmethod
    def name(cls) -> str:
        return "tracewell_table_service"

    def schema(self) -> str:
        return "endpoint string, deployed_model_id string, logging_time timestamp, request_id string, request_payload array<string>, response_payload array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _TableReader(self.options)


def _rows(spark: SparkSession, source: type[DataSource], start: str, end: str, **options: str) -> DataFrame:
    """Rows of a source in the days start to end; filters on its columns reach it from here on in this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    first, last = window(start, end)
    bounds = {"start": first and first.isoformat(), "end": last and last.isoformat()}
    return spark.read.format(source.name()).options(**{k: v for k, v in (options | bounds).items() if v}).load()


def log_rows(spark: SparkSession, url: str, start: str = "", end: str = "", token: str = "", resource: str = "", subscription: str = "", hours: str = "") -> DataFrame:
    """Rows (LOG_COLUMNS) of a log workspace, as azure.from_table takes them."""
    return _rows(spark, LogService, start, end, url=url, token=token, resource=resource, subscription=subscription, hours=hours)


def table_rows(spark: SparkSession, url: str, table: str, start: str = "", end: str = "", token: str = "", location: str = "", hours: str = "") -> DataFrame:
    """Rows of a logging table (project.dataset.table) in a warehouse, as vertex.records takes them; ValueError for names that are none."""
    identifiers(*table.split("."), count=3)
    return _rows(spark, TableService, start, end, url=url, table=table, token=token, location=location, hours=hours)
