"""Suppression of frequent events: beyond a rate, a stream's events give way to one bulk event."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators.detectors import Event
from pulseframe.operators.runtime import _RAW, batch_of, timed


@dataclass(frozen=True)
class Frequency:
    """More than ``count`` events in ``interval`` seconds suppress, until ``cooldown`` seconds have passed without."""

    name: str
    interval: float
    count: int
    cooldown: float
    severity: int


DEFAULTS = (Frequency("small", 60, 5, 120, 25), Frequency("medium", 120, 15, 240, 50), Frequency("large", 360, 100, 720, 75))


def start(configs: tuple[Frequency, ...] = DEFAULTS) -> dict:
    return {"times": [], "off": {c.name: None for c in configs}}


def step(state: dict, event: Event, configs: tuple[Frequency, ...] = DEFAULTS) -> list[Event]:
    """The bulk events that this one sets off, then the event itself if no configuration suppresses it."""
    now, longest = event.time_ms, max((c.interval for c in configs), default=0)
    times = state["times"]  # in order, so that what lies inside an interval is found by halving
    insort(times, now)
    del times[: bisect_left(times, now - longest * 1000)]
    out = []
    for c in configs:
        inside = bisect_right(times, now) - bisect_right(times, now - c.interval * 1000)
        triggered, off = inside > c.count, state["off"][c.name]
        if triggered and off is None:
            out.append(Event(f"bulk_{event.event_type}", c.severity, now, 0, f'Frequent events of type {event.event_type} - configuration name "{c.name} ({c.count} events in {c.interval:g} seconds)"'))
        if triggered:
            state["off"][c.name] = now
        elif off is not None and off < now - c.cooldown * 1000:
            state["off"][c.name] = None
    return out + ([event] if all(x is None for x in state["off"].values()) else [])


def suppress(events: DataFrame, configs: tuple[Frequency, ...] = DEFAULTS) -> DataFrame:
    """Events and bulk events of each stream, in order of time, type and description. A task holds the times of one stream's longest interval."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, state, first = None, None, True
        for b in batches:
            out = []
            for r in b.to_pylist():
                if first or r["stream"] != stream:
                    stream, state, first = r["stream"], start(configs), False
                event = Event(r["event_type"], r["severity"], r["ms"], r["detection_latency"], r["description"], dict(r["tags"] or []))
                out += [(stream, e) for e in step(state, event, configs)]
            if out:
                yield batch_of(out)

    rows = events.select("event_type", "stream", "severity", F.unix_millis("time").alias("ms"), "detection_latency", "description", "tags")
    return timed(rows.repartition("stream").sortWithinPartitions("stream", "ms", "event_type", "description").mapInArrow(run, _RAW))
