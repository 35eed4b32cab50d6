"""Detectors over batches: one shuffle by stream, a sort within it, and the step function over the sorted rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.operators.detectors import Detector, Event
from pulseframe.schemas import EVENT

_ARROW = pa.schema([("event_type", pa.string()), ("stream", pa.string()), ("severity", pa.int32()), ("_ms", pa.int64()), ("detection_latency", pa.int64()), ("description", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))])
_RAW = EVENT.replace("time timestamp", "_ms long")


def canonical(df: DataFrame, stream: Column, time: Column, value: Column, lossy: Column | None = None, seq: Column | None = None) -> DataFrame:
    """Any table as measurements; ``seq`` breaks ties of time."""
    lossy = F.lit(False) if lossy is None else F.coalesce(lossy, F.lit(False))
    return df.select(stream.cast("string").alias("stream"), time.cast("timestamp").alias("time"), (F.lit(0) if seq is None else seq).cast("long").alias("seq"), value.cast("double").alias("value"), lossy.alias("is_lossy"))


def not_lossy(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_lossy"))


def valued(df: DataFrame) -> DataFrame:
    return df.where("value is not null")


def of_type(df: DataFrame, datatype: str) -> DataFrame:
    return df.where(F.col("datatype") == datatype)


def batch_of(events: list[tuple[str, Event]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"event_type": e.event_type, "stream": s, "severity": e.severity, "_ms": e.time_ms, "detection_latency": e.latency_ns, "description": e.description, "tags": list(e.tags.items())} for s, e in events], schema=_ARROW)


def timed(raw: DataFrame) -> DataFrame:
    """Events whose time is still in ms as proper events."""
    return raw.select("event_type", "stream", "severity", F.timestamp_millis("_ms").alias("time"), "detection_latency", "description", "tags")


def _stretches(batches: Iterator[pa.RecordBatch], detector: Detector) -> Iterator[tuple]:
    """(stream, state, times, values, lossy) of each batch's stretch of one stream."""
    stream, state, first = None, None, True
    for b in batches:
        names, *columns = (b.column(i).to_pylist() for i in (0, 1, 3, 4))
        i = 0
        for s, same in groupby(names):
            n = sum(1 for _ in same)
            if first or s != stream:
                stream, state, first = s, detector.start(), False
            yield s, state, *(c[i : i + n] for c in columns)
            i += n


def detect(measurements: DataFrame, detector: Detector) -> DataFrame:
    """The detector's events over each stream in order of time, then seq.

    Streams are hashed to partitions, sorted there and read as they come, so
    a task holds the state of one stream and a batch, however long the stream
    is. What is not needed is projected away first, and filters on the input
    stay above the shuffle. Rows with a null time are dropped, since they have
    no place; a null stream is a stream of its own.
    """
    if "value" not in measurements.columns and detector.value_needed:
        raise ValueError(f"{detector.name} needs measurements with a value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, state, t, v, lossy in _stretches(batches, detector):
            out = [(s, e) for e in detector.steps(state, t, v, lossy)]
            if out:
                yield batch_of(out)

    value = F.col("value") if "value" in measurements.columns else F.lit(None).cast("double")
    rows = measurements.where("time is not null").select("stream", F.unix_millis("time").alias("ms"), "seq", value.alias("value"), "is_lossy")
    return timed(rows.repartition("stream").sortWithinPartitions("stream", "ms", "seq").mapInArrow(run, _RAW))


DETAIL = "stream string, time timestamp, detail map<string,double>"


def details(measurements: DataFrame, detector: Detector) -> DataFrame:
    """What the detector saw at each step that it evaluated, beside its events: names and numbers of its ``describe``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("stream", pa.string()), ("_ms", pa.int64()), ("detail", pa.map_(pa.string(), pa.float64()))])
        for s, state, t, v, lossy in _stretches(batches, detector):
            found = []
            detector.steps(state, t, v, lossy, lambda times, columns: found.append((times, columns)))  # noqa: B023
            if found:
                names, n = list(found[0][1]), sum(len(times) for times, _ in found)
                keys = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(len(names), dtype=np.int32), n)), pa.array(names)).cast(pa.string())
                numbers = np.concatenate([np.column_stack([columns[c] for c in names]) for _, columns in found]).ravel().astype(float)
                detail = pa.MapArray.from_arrays(pa.array(np.arange(0, len(numbers) + 1, len(names), dtype=np.int32)), keys, pa.array(numbers))
                yield pa.RecordBatch.from_arrays([pa.array([s] * n, pa.string()), pa.array(np.concatenate([times for times, _ in found]).astype(np.int64)), detail], schema=schema)

    rows = measurements.where("time is not null").select("stream", F.unix_millis("time").alias("ms"), "seq", "value", "is_lossy")
    raw = rows.repartition("stream").sortWithinPartitions("stream", "ms", "seq").mapInArrow(run, DETAIL.replace("time timestamp", "_ms long"))
    return raw.select("stream", F.timestamp_millis("_ms").alias("time"), "detail")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
