"""Sources over a transport: time-series history and polling, REST archives, relational traceroutes.

The transport is a picklable object with one method, so that the same readers
run against a server or against local files. Filters that a server can answer
are pushed down to it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, InputPartition, LessThanOrEqual

from pulseframe.sources.datatypes import Datatype, datatype, measured


class Transport(Protocol):
    def fetch(self, request: dict[str, Any]) -> list[tuple]:
        """The rows that answer a request."""


PLAIN = ("value", "lossy")


@dataclass
class FileTransport:
    """Answers from a JSON-lines file of rows, which tests and offline runs can write: {"table", "time_ms", "stream", "value", ...}; documents have "uri" and "ts"."""

    path: str

    def fetch(self, request: dict[str, Any]) -> list[tuple]:
        rows = [json.loads(x) for x in Path(self.path).read_text().splitlines() if x]
        low, high = request.get("after"), request.get("until")
        time_of = lambda r: r["ts"] * 1000 if "uri" in request else r["time_ms"]
        name = "uri" if "uri" in request else "table"
        rows = [r for r in rows if r.get(name) == request[name]]
        rows = [r for r in rows if (low is None or time_of(r) > low) and (high is None or time_of(r) <= high)]
        rows = [r for r in rows if request.get("stream") in (None, r.get("stream"))]
        rows.sort(key=time_of)
        if "uri" in request:
            return [(r["ts"], r["val"]) for r in rows]
        return [(r["stream"], r["time_ms"], *(r.get(f) for f in request.get("fields") or PLAIN)) for r in rows]


@dataclass
class HttpTransport:
    """GETs a query endpoint that answers with JSON rows [stream, time_ms, *fields], or of a document's uri with rows [ts, val]."""

    url: str
    timeout_s: float = 30

    def fetch(self, request: dict[str, Any]) -> list[tuple]:
        from urllib.parse import urlencode
        from urllib.request import urlopen

        asked = {k: ",".join(v) if isinstance(v, (list, tuple)) else v for k, v in request.items() if v is not None}
        with urlopen(f"{self.url}?{urlencode(asked)}", timeout=self.timeout_s) as r:
            return [tuple(x) for x in json.load(r)]


ROW = "stream string, time_ms long, value double, is_lossy boolean"
_SQL = {"int": "long", "float": "double", "bool": "boolean", "string": "string", "rtts": "array<int>"}
_MAKE = {"int": int, "float": float, "bool": bool, "string": str, "rtts": list}


def _kind(options) -> Datatype | None:
    return datatype(options["datatype"], options.get("family") or "amp") if options.get("datatype") else None


def _columns(kind: Datatype) -> dict[str, str]:
    return dict.fromkeys(kind.tags, "string") | kind.fields


@dataclass
class _Range(InputPartition):
    after: int | None
    until: int | None
    stream: str | None = None
    uri: str | None = None


def _ranges(after: int, until: int, n: int, **more) -> list[_Range]:
    """Equal ranges of time, each half open at its start."""
    n = max(1, min(n, until - after))
    ends = [after + (until - after) * i // n for i in range(n + 1)]
    return [_Range(a, b, **more) for a, b in zip(ends, ends[1:], strict=False) if a < b]


def _rows(options, partition: _Range) -> Iterator[tuple]:
    """The rows of a range, fetched where the task runs: plain, of a type's fields, or a document for each endpoint."""
    transport = FileTransport(options["path"]) if options.get("path") else HttpTransport(options["url"])
    request = {"after": partition.after, "until": partition.until, "stream": partition.stream}
    if partition.uri is not None:
        found = transport.fetch(request | {"uri": partition.uri})
        if found:
            yield partition.uri, json.dumps([{"ts": t, "val": v} for t, v in found])
        return
    kind = _kind(options)
    if kind is None:
        for stream, t, value, lossy in transport.fetch(request | {"table": options["table"]}):
            yield str(stream), int(t), None if value is None else float(value), bool(lossy)
        return
    columns = _columns(kind)
    for stream, t, *cells in transport.fetch(request | {"table": kind.table, "fields": list(columns)}):
        yield str(stream), int(t), *(None if c is None else _MAKE[k](c) for c, k in zip(cells, columns.values(), strict=True))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options, self.after, self.until, self.stream = options, _int(options, "after"), _int(options, "until"), None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, GreaterThan) and f.attribute == ("time_ms",):
                self.after = f.value if self.after is None else max(self.after, f.value)
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("time_ms",):
                self.until = f.value if self.until is None else min(self.until, f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("stream",):
                self.stream = f.value
            else:
                yield f

    def partitions(self):
        """Equal ranges of time; one range if an end is open. Of documents, one for each endpoint."""
        if self.options.get("uris"):
            return [_Range(self.after, self.until, uri=u) for u in json.loads(self.options["uris"])]
        n = _int(self.options, "partitions") or 1
        if self.after is None or self.until is None or n == 1:
            return [_Range(self.after, self.until, self.stream)]
        return _ranges(self.after, self.until, n, stream=self.stream)

    def read(self, partition):
        yield from _rows(self.options, partition)


class _StreamReader(DataSourceStreamReader):
    """Follows what is new by ranges of time, read by tasks: nothing is fetched on the driver.

    An offset is the time up to which rows have been asked for, in whole steps
    of ``step`` ms and ``delay`` ms before now, for rows that come late. A
    range is cut into parts of ``range`` ms, at most ``partitions`` of them;
    documents are asked for by endpoint.
    """

    def __init__(self, options):
        self.options = options

    def initialOffset(self):
        return {"after": _int(self.options, "after") or 0}

    def latestOffset(self):
        step = _int(self.options, "step") or 10_000
        now = _int(self.options, "now") or int(time.time() * 1000)
        return {"after": max(self.initialOffset()["after"], (now - (_int(self.options, "delay") or 0)) // step * step)}

    def partitions(self, start, end):
        after, until = start["after"], end["after"]
        if until <= after:
            return []
        if self.options.get("uris"):
            return [_Range(after, until, uri=u) for u in json.loads(self.options["uris"])]
        n = min(_int(self.options, "partitions") or 64, -(-(until - after) // (_int(self.options, "range") or 3_600_000)))
        return _ranges(after, until, n)

    def read(self, partition):
        yield from _rows(self.options, partition)


def _int(options, name: str) -> int | None:
    return int(options[name]) if options.get(name) is not None else None


class History(DataSource):
    """spark.read.format("measurements"): times in (after, until], pushed down.

    Options: path or url; table, or datatype and family for a type's own
    columns, or uris (a JSON list) for documents; after, until, partitions;
    as a stream also delay, step and range.
    """

    @classmethod
    def name(cls):
        return "measurements"

    def schema(self):
        if self.options.get("uris"):
            return "uri string, value string"
        kind = _kind(self.options)
        if kind is None:
            return ROW
        return ", ".join(["stream string, time_ms long", *(f"`{c}` {_SQL[k]}" for c, k in _columns(kind).items())])

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(History)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _given(reader, **options):
    for name, v in options.items():
        reader = reader if v is None else reader.option(name, v)
    return reader


def history(spark: SparkSession, table: str, after_ms: int | None = None, until_ms: int | None = None, partitions: int = 1, **options: str) -> DataFrame:
    register(spark)
    return as_measurements(_given(spark.read.format("measurements"), table=table, partitions=partitions, after=after_ms, until=until_ms, **options).load())


def poll(spark: SparkSession, table: str, after_ms: int = 0, delay_ms: int = 0, **options: str) -> DataFrame:
    register(spark)
    return as_measurements(_given(spark.readStream.format("measurements"), table=table, after=after_ms, delay=delay_ms, **options).load())


def typed(rows: DataFrame, kind: Datatype) -> DataFrame:
    """Rows of a type's own columns as its measurements: with value, is_lossy, datatype and, where it is made of tags, the stream."""
    return measured(rows.withColumn("time", F.timestamp_millis("time_ms")).drop("time_ms"), kind)


def typed_history(spark: SparkSession, kind: Datatype, after_ms: int | None = None, until_ms: int | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A table's history with all the columns of its type; ranges of time are read side by side."""
    register(spark)
    reader = spark.read.format("measurements")
    return typed(_given(reader, datatype=kind.name, family=kind.family, partitions=partitions, after=after_ms, until=until_ms, **options).load(), kind)


def typed_poll(spark: SparkSession, kind: Datatype, after_ms: int = 0, delay_ms: int = 0, **options: str) -> DataFrame:
    register(spark)
    reader = spark.readStream.format("measurements")
    return typed(_given(reader, datatype=kind.name, family=kind.family, after=after_ms, delay=delay_ms, **options).load(), kind)


def archive_documents(spark: SparkSession, uris: list[str], after_ms: int | None = None, until_ms: int | None = None, stream: bool = False, **options: str) -> DataFrame:
    """What each endpoint of a REST archive has in a range of time, or as a stream what is new, as documents for ``files.esmond``; a task an endpoint."""
    register(spark)
    reader = (spark.readStream if stream else spark.read).format("measurements")
    return _given(reader, uris=json.dumps(uris), after=after_ms, until=until_ms, **options).load()


def as_measurements(rows: DataFrame) -> DataFrame:
    return rows.select("stream", F.timestamp_millis("time_ms").alias("time"), F.lit(0).cast("long").alias("seq"), "value", "is_lossy")


# REST archive: which streams there are, and what to ask for next.


def discover(
    archives: DataFrame,
    source: str | None = None,
    destination: str | None = None,
    agent: str | None = None,
    tool: str | None = None,
    event_types: list[str] | None = None,
    summary_type: str | None = None,
    summary_window: int | None = None,
    time_start: int | None = None,
    time_end: int | None = None,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Archive listings (source, destination, measurement_agent, tool_name, event_types with summaries) as time series: base ones and summaries, each uri once.

    ``time_start`` and ``time_end`` bound when an event type was last updated
    (time_updated, epoch seconds). ``limit`` and ``offset`` page the archives
    that the other filters leave, in order of their uri.
    """
    for column, wanted in (("source", source), ("destination", destination), ("measurement_agent", agent), ("tool_name", tool)):
        if wanted is not None:
            archives = archives.where(F.col(column) == wanted)
    if limit is not None or offset:
        archives = archives.orderBy("uri").offset(offset)
        archives = archives if limit is None else archives.limit(limit)
    e = archives.select("source", "destination", F.explode("event_types").alias("e"))
    if event_types:
        e = e.where(F.col("e.event_type").isin(event_types))
    if time_start is not None:
        e = e.where(F.col("e.time_updated") >= time_start)
    if time_end is not None:
        e = e.where(F.col("e.time_updated") <= time_end)
    none = F.lit(None).cast("string").alias("summary_type"), F.lit(None).cast("long").alias("summary_window")
    base = e.select("source", "destination", F.col("e.event_type").alias("event_type"), F.col("e.base_uri").alias("uri"), *none)
    s = e.select("source", "destination", F.col("e.event_type").alias("event_type"), F.explode("e.summaries").alias("s"))
    window = F.col("s.summary_window").cast("long").alias("summary_window")
    more = s.select("source", "destination", "event_type", F.col("s.uri").alias("uri"), F.col("s.summary_type").alias("summary_type"), window)
    if summary_type is not None or summary_window is not None:
        base = base.where("false")
        more = more if summary_type is None else more.where(F.col("summary_type") == summary_type)
        more = more if summary_window is None else more.where(F.col("summary_window") == summary_window)
    return base.unionByName(more).dropDuplicates(["uri"])


def poll_interval(endpoints: int, target_s: float = 600, least_s: float = 1) -> float:
    """Seconds between two requests, so that all endpoints are asked once in the target time."""
    return max(target_s / max(1, endpoints), least_s)


def next_offsets(series: DataFrame) -> DataFrame:
    """From which second each endpoint is to be asked next."""
    return series.groupBy("stream").agg((F.unix_seconds(F.max("time")) + 1).alias("from_s"))


def traceroutes_between(traceroutes: DataFrame, start_s: int, end_s: int, streams: list[DataFrame] | None = None) -> DataFrame:
    """Traceroutes (stream, timestamp in epoch s, ...) in (start, end], of the streams that all filters agree on, with time and is_lossy. The range reaches the scan."""
    rows = traceroutes.where(F.col("timestamp").between(start_s + 1, end_s))
    for s in streams or []:
        rows = rows.join(s.select("stream").distinct(), "stream", "left_semi")
    rtts = F.transform("hop_rtt", lambda x: F.when(x != 0, x))
    return rows.withColumns({"time": F.timestamp_seconds("timestamp"), "hop_rtt": rtts, "is_lossy": F.col("error_type").isNotNull() | F.col("error_code").isNotNull()})
