"""Flows: sources, detectors and sinks described in YAML, built into one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from pulseframe import config
from pulseframe.operators import grouping, runtime, suppress
from pulseframe.operators.detectors import DETECTORS, Detector
from pulseframe.sources import files, remote, sinks
from pulseframe.sources.datatypes import DATATYPES, datatype
from pulseframe.streaming import runtime as streaming

SOURCES = ("influx", "esmond", "latencyts", "nab", "parquet")
SINKS = ("print", "influx", "parquet", "csv")


@dataclass(frozen=True)
class SourceReference:
    name: str
    datatype: str
    filter_lossy: bool = False


@dataclass(frozen=True)
class Instance:
    sources: tuple[SourceReference, ...]
    sinks: tuple[str, ...]
    config: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Flow:
    sources: dict[str, dict[str, Any]]
    sinks: dict[str, dict[str, Any]]
    detectors: dict[str, tuple[str, tuple[Instance, ...]]]


def parse(text: str) -> Flow:
    """A flow from YAML. All three parts must be there, and what is referred to must be declared and known."""
    import yaml

    raw = yaml.safe_load(text) or {}
    for part in ("sources", "sinks", "detectors"):
        if not raw.get(part):
            raise ValueError(f"a flow needs {part}")
    detectors = {}
    for name, d in raw["detectors"].items():
        if d.get("type") not in DETECTORS:
            raise ValueError(f"{name}: no detector {d.get('type')}")
        instances = []
        for i in d["instances"]:
            refs = tuple(SourceReference(s["name"], str(s["datatype"]), bool(s.get("filterLossy", False))) for s in i.get("source") or [])
            if not refs:
                raise ValueError(f"{name}: an instance needs a source")
            instances.append(Instance(refs, tuple(s["name"] for s in i.get("sink") or []), dict(i.get("config") or {})))
        detectors[name] = (d["type"], tuple(instances))
    flow = Flow(raw["sources"], raw["sinks"], detectors)
    for kind, known, declared in (("source", SOURCES, flow.sources), ("sink", SINKS, flow.sinks)):
        for name, s in declared.items():
            if s.get("type") not in known:
                raise ValueError(f"{name}: no {kind} type {s.get('type')}")
    for name, (_, instances) in detectors.items():
        for i in instances:
            for ref, declared in [(s.name, flow.sources) for s in i.sources] + [(s, flow.sinks) for s in i.sinks]:
                if ref not in declared:
                    raise ValueError(f"{name}: {ref} isn't declared")
    return flow


def has_value(family: str, name: str) -> bool:
    """Whether measurements of the type have the scalar that value detectors need."""
    if family in DATATYPES or (family, name) in DATATYPES:
        return DATATYPES[family, name].value is not None
    return name not in ("failure", "href", "histogram", "packettrace", "subinterval", "traceroute") or (family, name) == ("amp2", "traceroute")


class Builder:
    """Builds flows. Sources are made when a detector asks for them, once for each datatype.

    ``tables`` gives DataFrames for source names (tests, or other readers);
    otherwise a source's settings name its path.
    """

    def __init__(self, spark: SparkSession, settings: Mapping[str, Any] | None = None, tables: Mapping[str, Callable[[str], DataFrame]] | None = None, stream: bool = False):
        self.spark, self.settings, self.tables, self.stream = spark, settings or config.DEFAULTS, tables or {}, stream
        self._made: dict[tuple, DataFrame] = {}

    def source(self, flow: Flow, ref: SourceReference) -> DataFrame:
        key = (ref.name, ref.datatype)
        if key not in self._made:
            self._made[key] = self._read(flow.sources[ref.name], ref)
        return runtime.not_lossy(self._made[key]) if ref.filter_lossy else self._made[key]

    def _read(self, spec: Mapping[str, Any], ref: SourceReference) -> DataFrame:
        if ref.name in self.tables:
            return self.tables[ref.name](ref.datatype)
        kind, options = spec["type"], dict(spec.get("config") or {})
        if kind == "parquet":
            reader = self.spark.readStream.schema(self.spark.read.parquet(options["path"]).schema) if self.stream else self.spark.read
            return reader.parquet(options["path"])
        if kind == "influx" and "url" in options:
            kind_ = datatype(ref.datatype, spec.get("subtype", "amp"))
            return (remote.typed_poll if self.stream else remote.typed_history)(self.spark, kind_, url=options["url"])
        if kind == "esmond" and "url" in options:
            documents = remote.archive_documents(self.spark, list(options["uris"]), stream=self.stream, url=options["url"])
            return files.esmond(documents, ref.datatype)
        raw = files.lines(self.spark, options["location"] if "location" in options else options["path"], {"latencyts": "*.series", "nab": "*.csv"}.get(kind), self.stream)
        if kind == "influx":
            return files.line_measurements(raw, datatype(ref.datatype, spec.get("subtype", "amp")))
        if kind == "esmond":
            return files.esmond(raw.withColumnRenamed("file", "uri"), ref.datatype)
        if kind == "nab":
            return files.nab(raw)
        return files.latency_smokeping(raw) if (spec.get("subtype") or ref.datatype) == "smokeping" else files.latency_icmp(raw)

    def detector(self, kind: str, instance: Instance) -> tuple[Detector, bool, float]:
        """(detector, whether it is fed by time windows, their seconds)."""
        shared = dict(self.settings["detector"].get("default", {})) | instance.config
        windowed = str(shared.get("useFlinkTimeWindow", True)).lower() == "true"
        if kind == "distdiff" and windowed:
            kind = "distdiff_windowed"  # it has a form of its own over count windows
        return config.build_detector(kind, self.settings, instance.config), windowed, float(shared.get("windowDuration", 60))

    def events(self, flow: Flow) -> dict[str, DataFrame]:
        """The suppressed events of every sink, as one table each."""
        out: dict[str, list[DataFrame]] = {s: [] for s in flow.sinks}
        filters = tuple(suppress.Frequency(n, **v) for n, v in self.settings["eventGrouping"].get("frequentFilter", {}).items())
        lateness = f"{self.settings['flink']['maxLateness']} seconds"
        for kind, instances in flow.detectors.values():
            for i in instances:
                detector, windowed, seconds = self.detector(kind, i)
                for ref in i.sources:
                    family = {"influx": flow.sources[ref.name].get("subtype", "amp")}.get(flow.sources[ref.name]["type"], flow.sources[ref.name]["type"])
                    if detector.value_needed and not has_value(family, ref.datatype):
                        raise ValueError(f"{ref.datatype} has no value for {kind}")
                rows = runtime.union_all([self.source(flow, ref).select("stream", "time", "seq", "value", "is_lossy") for ref in i.sources])
                # a batch is sorted by time, so time windows give the same events there
                if self.stream:
                    width = seconds if windowed and kind != "distdiff" else None
                    found = streaming.detect_stream(rows, detector, width, lateness, filters)
                else:
                    found = suppress.suppress(runtime.detect(rows, detector), filters)
                for s in i.sinks:
                    out[s].append(found)
        return {s: runtime.union_all(parts) for s, parts in out.items() if parts}

    def groups(self, events: DataFrame) -> DataFrame:
        times = self.settings["eventGrouping"]["time"]
        return grouping.with_uid(grouping.temporal_groups(events, times["maximumEventInterval"], times["maximumGroupDuration"]))

    def _write(self, flow: Flow, name: str, events: DataFrame, out: str) -> None:
        """Events of a batch, or of a part of a stream, to where a sink says."""
        kind, path = flow.sinks[name]["type"], self._path(flow, name, out)
        if kind == "print":
            sinks.show(events)
        elif kind == "parquet":
            events.write.mode("append").parquet(path)
        elif kind == "csv":
            sinks.write_events_csv(events, path)
        else:
            sinks.write_lines(events, f"{path}/events")

    def _write_groups(self, groups: DataFrame, path: str) -> None:
        """Groups as lines, and their events tagged with them."""
        sinks.write_lines(grouping.aggregates(groups), f"{path}/event_groups", "groups")
        sinks.write_lines(grouping.in_group(groups), f"{path}/events_in_groups")

    @staticmethod
    def _path(flow: Flow, name: str, out: str) -> str:
        return f"{(flow.sinks[name].get('config') or {}).get('path', out)}/{name}"

    def run(self, flow: Flow, out: str) -> dict[str, DataFrame]:
        """Runs a batch flow: each sink's events go where it says, influx sinks also get groups, and the events tagged with theirs. Gives the events by sink."""
        if self.stream:
            raise ValueError("a streaming flow is started with start()")
        found = self.events(flow)
        for name, events in found.items():
            self._write(flow, name, events, out)
            if flow.sinks[name]["type"] == "influx":
                self._write_groups(self.groups(events), self._path(flow, name, out))
        return found

    def start(self, flow: Flow, out: str, once: bool = False) -> list[StreamingQuery]:
        """Starts a streaming flow and gives its queries; started again with the same ``out``, it goes on where it was.

        Each sink's events are first written to a table of their own, exactly
        once; one query brings them to the sink, and for influx sinks another
        groups them, so no query has two stateful steps in a row. ``once``
        takes what is there and ends, each query after the one that it follows.
        """
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", streaming.STATE_STORE)
        times = self.settings["eventGrouping"]["time"]
        # events of windows come once the watermark has passed their window, so groups wait for the longest one besides
        widths = [d[2] for kind, instances in flow.detectors.values() for i in instances if (d := self.detector(kind, i))[1] and kind != "distdiff"]
        lateness = f"{2 * self.settings['flink']['maxLateness'] + max(widths, default=0):g} seconds"
        queries: list[StreamingQuery] = []

        def go(df: DataFrame, name: str, write=None) -> None:
            writer = df.writeStream.option("checkpointLocation", f"{out}/checkpoints/{name}").queryName(name).outputMode("append")
            writer = writer.foreachBatch(write) if write else writer.format("parquet").option("path", f"{out}/found/{name}")
            queries.append((writer.trigger(availableNow=True) if once else writer).start())
            if once:
                queries[-1].awaitTermination()

        for name, events in self.events(flow).items():
            go(events, name)
            schema = events.schema
            follow = lambda name=name, schema=schema: self.spark.readStream.schema(schema).parquet(f"{out}/found/{name}")
            go(follow(), f"{name}-sink", lambda part, _, name=name: self._write(flow, name, part, out))
            if flow.sinks[name]["type"] == "influx":
                path = self._path(flow, name, out)
                grouped = streaming.group_stream(follow(), times["maximumEventInterval"], times["maximumGroupDuration"], lateness=lateness)
                go(grouped, f"{name}-groups", lambda part, _, path=path: self._write_groups(grouping.with_uid(streaming.as_groups(part)), path))
        return queries
