"""Detectors, suppression and grouping over streams, by the same steps as over batches.

State is one string of JSON per key in the state store, so it can be looked at
and moved. Rows of a micro-batch are taken in order of time within each key;
windows hold them back until the watermark has passed them, so that later
batches can't bring earlier rows, and drop what comes after that. What is held
lies beside the JSON, by window, as packed columns that are written once and
read once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulseframe.operators import suppress as frequency
from pulseframe.operators.detectors import Detector, Event
from pulseframe.operators.runtime import _RAW, timed

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _frame(events: list[tuple[str, Event]]) -> pd.DataFrame:
    names = ["event_type", "stream", "severity", "_ms", "detection_latency", "description", "tags"]
    return pd.DataFrame([(e.event_type, s, e.severity, e.time_ms, e.latency_ns, e.description, e.tags) for s, e in events], columns=names)


class _Keyed(StatefulProcessor):
    """One string of state; subclasses say how rows change it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle, self._state = handle, handle.getValueState("state", "json string")

    def _load(self, start: Any) -> Any:
        return json.loads(self._state.get()[0]) if self._state.exists() else start

    def _save(self, state: Any) -> None:
        self._state.update((Detector.dump(state),))

    def close(self) -> None:
        pass


PACKED = "ms binary, seq binary, value binary, is_lossy binary"


class _Rows:
    """Rows of one key as columns: ms, seq, value (NaN: null), lossy. Packed, each column is its bytes, numbers little-endian."""

    TYPES = ("<i8", "<i8", "<f8", "?")

    def __init__(self, columns: list[np.ndarray]):
        self.columns = columns

    @classmethod
    def unpacked(cls, parts: list[tuple]) -> _Rows:
        return cls([np.frombuffer(b"".join(map(bytes, c)), t) for c, t in zip(zip(*parts, strict=True) if parts else [()] * 4, cls.TYPES, strict=True)])

    def packed(self) -> tuple:
        return tuple(c.tobytes() for c in self.columns)

    def __len__(self) -> int:
        return len(self.columns[0])

    def taken(self, which: np.ndarray | slice) -> _Rows:
        return _Rows([c[which] for c in self.columns])

    def ordered(self) -> _Rows:
        return self.taken(np.lexsort((self.columns[1], self.columns[0])))

    def slices(self, size: int = 10_000) -> Iterator[Iterator[tuple]]:
        """(ms, value or None, lossy), a slice at a time."""
        for i in range(0, len(self), size):
            t, _, v, x = (c[i : i + size].tolist() for c in self.columns)
            yield zip(t, (None if y != y else y for y in v), x, strict=True)


def packed(rows: DataFrame) -> DataFrame:
    """Rows (stream, ms, seq, value, is_lossy) with those of one stream in an Arrow batch packed as one, since what goes to a stateful step goes row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("stream", pa.string()), *((c, pa.binary()) for c in ("ms", "seq", "value", "is_lossy"))])
        for b in batches:
            names = b.column(0).dictionary_encode(null_encoding="encode")
            codes = names.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            fills = (None, None, float("nan"), False)
            columns = [(c if f is None else c.fill_null(f)).to_numpy(zero_copy_only=False).astype(t)[order] for c, f, t in zip(b.columns[1:], fills, _Rows.TYPES, strict=True)]
            cuts = [0, *(np.flatnonzero(np.diff(codes[order])) + 1).tolist(), len(codes)]
            spans = [(i, j) for i, j in zip(cuts, cuts[1:]) if i < j]
            first = names.dictionary.take(pa.array(codes[order][[i for i, _ in spans]]))
            yield pa.RecordBatch.from_arrays([first.cast(pa.string()), *(pa.array([c[i:j].tobytes() for i, j in spans], pa.binary()) for c in columns)], schema=schema)

    return rows.mapInArrow(run, "stream string, " + PACKED)


class DetectorProcessor(_Keyed):
    """A detector over one stream, and on request the suppression of its frequent events, which goes by the same key."""

    BLOCK = 200_000  # rows that are put by window at once

    def __init__(self, detector: Detector, window_ms: int = 0, configs=None):
        self._detector, self._window, self._configs = detector, window_ms, configs

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        if self._window:
            self._held = handle.getMapState("held", "end long, part int", PACKED)

    def _fresh(self) -> dict:
        """``held`` has the number of parts by the end of their window."""
        return {"d": self._detector.start(), "held": {}, "f": None if self._configs is None else frequency.start(self._configs)}

    def _step(self, saved: dict, rows: _Rows, key) -> Iterator[pd.DataFrame]:
        for part in rows.ordered().slices():
            out = []
            for t, v, x in part:
                found = self._detector.step(saved["d"], t, v, x)
                if found and self._configs is not None:
                    found = sorted(found, key=lambda e: (e.time_ms, e.event_type, e.description))
                    found = [y for e in found for y in frequency.step(saved["f"], e, self._configs)]
                out += found
            if out:
                yield _frame([(key[0], e) for e in out])

    def _hold(self, held: dict, rows: _Rows, passed: int) -> None:
        """Puts rows by window, with one timer a window; what is late goes."""
        ends = (rows.columns[0] // self._window + 1) * self._window
        for end in np.unique(ends[ends > passed]).tolist():
            n = held.get(str(end), 0)
            self._held.updateValue((end, n), rows.taken(ends == end).packed())
            held[str(end)] = n + 1
            if not n:
                self._handle.registerTimer(end)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        saved, arrived, n = self._load(self._fresh()), [], 0
        for f in rows:
            arrived += f[["ms", "seq", "value", "is_lossy"]].itertuples(index=False, name=None)
            if self._window:
                n += sum(len(x) for x in f["is_lossy"])
                if n >= self.BLOCK:
                    self._hold(saved["held"], _Rows.unpacked(arrived), timerValues.getCurrentWatermarkInMs())
                    arrived, n = [], 0
        if self._window:
            self._hold(saved["held"], _Rows.unpacked(arrived), timerValues.getCurrentWatermarkInMs())
        else:
            yield from self._step(saved, _Rows.unpacked(arrived), key)
        self._save(saved)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        saved = self._load(self._fresh())
        for end in sorted(int(e) for e in saved["held"] if int(e) <= expiredTimerInfo.getExpiryTimeInMs()):
            parts = [(end, i) for i in range(saved["held"].pop(str(end)))]
            rows = _Rows.unpacked([tuple(self._held.getValue(p)) for p in parts])
            for p in parts:
                self._held.removeKey(p)
            yield from self._step(saved, rows, key)
        self._save(saved)


def detect_stream(measurements: DataFrame, detector: Detector, window_s: float | None = None, lateness: str = "20 seconds", configs=None) -> DataFrame:
    """The detector's events over a stream of measurements. ``window_s`` holds rows back by event-time windows; without, they go as they arrive.

    With ``configs`` the events of each stream are suppressed by frequency as
    they are found, in the same step, so no second stateful step is needed.
    The session needs the RocksDB state store (``STATE_STORE``).
    """
    rows = measurements.where("time is not null").withWatermark("time", lateness)
    value = F.col("value") if "value" in measurements.columns else F.lit(None).cast("double")
    rows = packed(rows.select("stream", F.unix_millis("time").alias("ms"), "seq", value.alias("value"), "is_lossy"))
    processor = DetectorProcessor(detector, round((window_s or 0) * 1000), configs)
    mode = "EventTime" if window_s else "None"
    return timed(rows.groupBy("stream").transformWithStateInPandas(statefulProcessor=processor, outputStructType=_RAW, outputMode="Append", timeMode=mode))


class SuppressProcessor(_Keyed):
    def __init__(self, configs):
        self._configs = configs

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._load(frequency.start(self._configs))
        arrived = [(int(r.ms), r.event_type, r.description, r) for f in rows for r in f.itertuples()]
        out = []
        for ms, kind, text, r in sorted(arrived, key=lambda x: x[:3]):
            event = Event(kind, int(r.severity), ms, int(r.detection_latency), text, json.loads(r.tags))
            out += [(key[0], e) for e in frequency.step(state, event, self._configs)]
        self._save(state)
        if out:
            yield _frame(out)


def suppress_stream(events: DataFrame, configs=frequency.DEFAULTS) -> DataFrame:
    rows = events.select("stream", "event_type", "severity", F.unix_millis("time").alias("ms"), "detection_latency", "description", F.to_json("tags").alias("tags"))
    return timed(rows.groupBy("stream").transformWithStateInPandas(statefulProcessor=SuppressProcessor(configs), outputStructType=_RAW, outputMode="Append", timeMode="None"))


GROUPS = "key string, start_ms long, end_ms long, events string"


class GroupProcessor(StatefulProcessor):
    """Groups by gap and longest duration.

    Events wait until the watermark has passed them, so that groups are made
    in order of time whichever batch brings an event; a group is closed when
    nothing more can join it. What waits and the members of the open group are
    lists in the state store, which a batch only adds to.
    """

    def __init__(self, gap_ms: int, longest_ms: int):
        self._gap, self._longest = gap_ms, longest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "began long, event string")
        self._span = handle.getValueState("span", "start long, end long")
        self._members = handle.getListState("members", "event string")

    def close(self) -> None:
        pass

    def _closed(self, key, start: int, end: int) -> pd.DataFrame:
        events = sorted((json.loads(m[0]) for m in self._members.get()), key=lambda e: (e["began_ms"], e["stream"], e["event_type"]))
        self._members.clear()
        self._span.clear()
        return pd.DataFrame([(key[0], start, end, json.dumps(events))], columns=["key", "start_ms", "end_ms", "events"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            self._waiting.appendList([(int(began), event) for began, event in zip(f["began"], f["event"], strict=True)])  # one call for all
        self._wake(timerValues)
        return iter(())

    def _join(self, events: list) -> None:
        if events:
            self._members.appendList(events)

    def _wake(self, timerValues) -> None:
        """One timer a batch: it goes off as soon as the watermark moves."""
        self._handle.registerTimer(timerValues.getCurrentWatermarkInMs() + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [(int(w[0]), w[1]) for w in self._waiting.get()]
        due = sorted(w for w in waiting if w[0] < now)
        if due:
            later = [w for w in waiting if w[0] >= now]
            self._waiting.clear()
            if later:
                self._waiting.appendList(later)
        span = self._span.get() if self._span.exists() else None
        span = None if span is None else (int(span[0]), int(span[1]))
        joined = []  # of the open group, added in one call
        for began, event in due:
            if span and (began > span[1] + self._gap or began - span[0] > self._longest):
                self._join(joined)
                joined = []
                yield self._closed(key, *span)
                span = None
            span = (min(span[0], began), max(span[1], began)) if span else (began, began)
            joined.append((event,))
        self._join(joined)
        open_ = span is not None
        if open_ and min(span[1] + self._gap, span[0] + self._longest) < now:
            yield self._closed(key, *span)
            open_ = False
        elif open_:
            self._span.update(span)
        if open_ or len(due) < len(waiting):
            self._wake(timerValues)


MEMBER = "array<struct<event_type:string,stream:string,severity:int,time_ms:bigint,detection_latency:bigint,description:string,tags:map<string,string>>>"


def group_stream(events: DataFrame, gap_s: float = 10, longest_s: float = 7200, key: str | None = None, lateness: str = "20 seconds") -> DataFrame:
    """Groups of events of a stream: key, start_time, end_time, events (JSON). Without a key all events make one sequence, as the operator asks.

    ``events`` must come from a source, not from another stateful step of the
    same query: what is found is first written, and followed from there.
    """
    began = F.unix_millis("time") - F.floor(F.col("detection_latency") / 1_000_000)
    member = F.struct("event_type", "stream", "severity", F.unix_millis("time").alias("time_ms"), began.alias("began_ms"), "detection_latency", "description", "tags")
    name = (F.lit("") if key is None else F.col(key)).alias("key")
    rows = events.withWatermark("time", lateness).select("time", name, began.alias("began"), F.to_json(member).alias("event"))
    processor = GroupProcessor(round(gap_s * 1000), round(longest_s * 1000))
    raw = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=GROUPS, outputMode="Append", timeMode="EventTime")
    return raw.select("key", F.timestamp_millis("start_ms").alias("start_time"), F.timestamp_millis("end_ms").alias("end_time"), "events")


def as_groups(rows: DataFrame) -> DataFrame:
    """What group_stream gives, with events as the batch operator has them."""
    members = F.from_json("events", MEMBER)
    one = lambda e: F.struct(e["event_type"].alias("event_type"), e["stream"].alias("stream"), e["severity"].alias("severity"), F.timestamp_millis(e["time_ms"]).alias("time"), e["detection_latency"].alias("detection_latency"), e["description"].alias("description"), F.coalesce(e["tags"], F.create_map().cast("map<string,string>")).alias("tags"))
    return rows.select("start_time", "end_time", F.transform(members, one).alias("events"))
